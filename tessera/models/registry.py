"""Model families by name."""

from __future__ import annotations

FAMILIES = {"logistic": "linear", "svm": "linear", "gbt": "trees", "mlp": "network", "autoencoder": "network"}


def require(model_type: str) -> str:
    if model_type not in FAMILIES:
        raise ValueError(f"unknown model type {model_type!r}; known: {sorted(FAMILIES)}")
    return FAMILIES[model_type]
