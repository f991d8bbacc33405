"""Operators: DataFrame in, DataFrame out, lazy unless said otherwise."""
