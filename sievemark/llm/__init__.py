"""Operators of a training-data pipeline: decontamination, dedup, extraction, scoring, mixing."""
