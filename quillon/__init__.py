"""Sparse and dense matrix analytics as DataFrame and SQL plans."""

__version__ = "0.1.0"
