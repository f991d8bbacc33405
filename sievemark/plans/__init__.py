"""Composed jobs: preparation, ground truth, retrieval, model comparison."""
