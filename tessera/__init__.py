"""Count-matrix analytics and corpus preparation on Spark.

The names below are loaded when they are first used, so that a worker that needs one module
doesn't import them all."""

from importlib import import_module

__version__ = "0.3.0"

_EXPORTS = {
    "train": "tessera.plans.inference", "run_inference": "tessera.plans.inference", "evaluate_and_save": "tessera.plans.inference", "save": "tessera.plans.inference", "load": "tessera.plans.inference",
    "Results": "tessera.plans.inference", "Trained": "tessera.plans.inference", "prepare": "tessera.plans.prepare", "optimize": "tessera.models.study", "FAMILIES": "tessera.models.registry",
}
__all__ = [*_EXPORTS, "__version__"]


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module 'tessera' has no attribute {name!r}")
    return getattr(import_module(_EXPORTS[name]), name)
