"""Operators on count matrices, cell tables, labels, splits, batches and metrics."""
