"""Estimators and their training."""
