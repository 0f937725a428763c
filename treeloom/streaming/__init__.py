"""Incremental counts over streams of observations."""

from .counts import count_stream, fold_counts

__all__ = ["count_stream", "fold_counts"]
