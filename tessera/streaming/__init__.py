"""Structured Streaming forms of the scoring pipeline."""
