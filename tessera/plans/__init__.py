"""Pipelines of operators and the queries that the entry module registers."""
