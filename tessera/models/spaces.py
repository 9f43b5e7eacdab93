"""Search spaces with conditions: what a parameter may be, and when there is such a parameter at all.

A space is a list of parameters in order; one may stand under conditions on earlier ones, all of
which must hold.  The sampler and the validator walk the same list, so what can't be
combined can neither be drawn nor passed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Param:
    """``kind``: real, log (real, on a logarithmic scale), int or choice.  ``when``: (earlier parameter, values that it
    must have) pairs."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 0.0
    choices: tuple = ()
    when: tuple[tuple[str, tuple], ...] = ()

    def holds(self, known: dict) -> bool:
        return all(k in known and known[k] in values for k, values in self.when)

    def check(self, value) -> None:
        if self.kind == "choice":
            ok = any(value == c and isinstance(value, bool) == isinstance(c, bool) for c in self.choices)
        elif self.kind == "int":
            ok = isinstance(value, int) and not isinstance(value, bool) and self.low <= value <= self.high
        else:
            ok = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and self.low <= value <= self.high
        if not ok:
            raise ValueError(f"{self.name}: {value!r} is outside its range")


def real(name: str, low: float, high: float, *when) -> Param:
    return Param(name, "real", low, high, when=when)


def log(name: str, low: float, high: float, *when) -> Param:
    return Param(name, "log", low, high, when=when)


def integer(name: str, low: int, high: int, *when) -> Param:
    return Param(name, "int", low, high, when=when)


def choice(name: str, *choices, when: tuple = ()) -> Param:
    return Param(name, "choice", choices=choices, when=when)


def drawn(space: list[Param], suggest: Callable[[Param], object]) -> dict:
    """A value for each parameter whose conditions hold, from ``suggest``."""
    out: dict = {}
    for p in space:
        if p.holds(out):
            out[p.name] = suggest(p)
    return out


def validate(space: list[Param], params: dict) -> dict:
    """``params`` if they are a combination that could be drawn, else ValueError."""
    seen: dict = {}
    for p in space:
        if p.holds(seen):
            if p.name not in params:
                raise ValueError(f"{p.name} is missing")
            p.check(params[p.name])
            seen[p.name] = params[p.name]
    if extra := sorted(set(params) - set(seen)):
        raise ValueError(f"not in this combination: {extra}")
    return params


# The ranges of each family's parameters.

EPOCHS = 30
SAMPLERS = ("balanced_labels", "balanced_types", "random")
AUXILIARY = ("none", "tissue_type", "imputed_labels", "tissue_type,imputed_labels")
SCHEDULERS = ("ReduceLROnPlateau", "OneCycleLR", "StepLR", "CosineAnnealingLR", "ConstantLR", "NoScheduler")


def scheduler() -> list[Param]:
    """The learning-rate schedule, and what each kind of it has besides."""
    of = lambda kind: ("lr_scheduler_type", (kind,))
    plateau, cycle, step, cosine = map(of, SCHEDULERS[:4])
    return [
        choice("lr_scheduler_type", *SCHEDULERS),
        log("lr_factor", 0.1, 0.7, plateau), integer("lr_patience", 3, 15, plateau), log("lr_min_lr", 1e-7, 1e-5, plateau),
        real("lr_warmup_ratio", 0.05, 0.3, cycle),
        integer("lr_step_size", 5, 20, step), log("lr_gamma", 0.1, 0.7, step),
        integer("lr_t_max", EPOCHS, 2 * EPOCHS, cosine), log("lr_eta_min", 1e-7, 1e-5, cosine),
    ]


def layers(name: str, most: int, least: int, *units: int) -> list[Param]:
    """The number of layers, and the units of each that there is."""
    count = f"{name}num_layers"
    return [integer(count, least, most), *[choice(f"{name}layer_{k}_units", *units, when=((count, tuple(range(k + 1, most + 1))),)) for k in range(most)]]


SOFT = ("use_soft_loss", (True,))
ADAM = [real("adam_beta1", 0.8, 0.95), real("adam_beta2", 0.95, 0.999)]

MLP = [
    choice("use_log_transform", True, False), log("init_learning_rate", 1e-5, 1e-3), choice("train_batch_size", 2048, 4096), real("dropout_rate", 0.1, 0.3),
    *layers("", 5, 2, 512, 1024, 2048, 4096), log("weight_decay", 1e-5, 1e-2), real("mask_rate", 0.05, 0.3), log("noise_std", 1e-5, 1e-3), real("positives_weight", 0.1, 10.0),
    choice("sampler_type", *SAMPLERS), log("cat_loss_weight", 0.1, 10.0), *scheduler(), *ADAM, choice("aux_categorical_types", *AUXILIARY),
    choice("use_soft_loss", True, False), real("soft_loss_beta", 0.5, 10.0, SOFT), integer("soft_loss_start_epoch", 0, EPOCHS - 1, SOFT),
]

AUTOENCODER = [
    choice("use_log_transform", True, False), log("init_learning_rate", 1e-6, 1e-3), choice("train_batch_size", 2048, 4096), choice("sampler_type", *SAMPLERS), *scheduler(), *ADAM,
    choice("model_type", "standard", "fork"), choice("loss_type", "mse", "nb", "zinb"), choice("latent_dim", 16, 32, 64, 128),
    log("recon_loss_weight", 0.1, 10.0), log("cls_loss_weight", 0.1, 10.0), log("cat_loss_weight", 0.1, 10.0), real("mask_rate", 0.05, 0.5), log("noise_std", 1e-5, 1e-3),
    real("positives_weight", 0.1, 10.0), *layers("encoder_", 3, 1, 32, 64, 128, 256, 512, 1024), *layers("decoder_", 3, 1, 32, 64, 128, 256, 512, 1024), *layers("classifier_", 2, 1, 16, 32, 64),
    real("dropout_rate", 0.1, 0.5), log("l1_lambda", 1e-5, 1e-2), log("weight_decay", 1e-6, 1e-3), choice("aux_categorical_types", *AUXILIARY),
    choice("use_soft_loss", True, False), real("soft_loss_beta", 0.5, 10.0, SOFT), integer("soft_loss_start_epoch", 0, EPOCHS - 1, SOFT),
    log("ridge_lambda", 1e-4, 1e-1, ("loss_type", ("zinb",))),
]

LINEAR = [
    choice("use_log_transform", True, False), choice("penalty", "l2", "elasticnet"), log("alpha", 1e-6, 1e-1), log("tol", 1e-6, 1e-3), choice("class_weight", "balanced", None),
    choice("batch_size", 512, 1024, 2048), choice("sampler_type", *SAMPLERS), log("init_learning_rate", 1e-5, 1e-2), choice("learning_rate", "optimal", "constant", "invscaling", "adaptive"),
    log("eta0", 1e-3, 1.0), real("power_t", 0.25, 0.75), *scheduler(), choice("warm_start", True, False), choice("average", True, False), integer("n_iter_no_change", 3, 10),
    real("validation_fraction", 0.05, 0.2), choice("fit_intercept", True, False), choice("shuffle", True, False), real("mask_rate", 0.0, 0.3), log("noise_std", 1e-5, 1e-3),
    real("soft_loss_beta", 0.5, 10.0), real("l1_ratio", 0.1, 0.9, ("penalty", ("elasticnet",))),
]

TREES = [
    choice("use_log_transform", True, False), choice("use_zscore_norm", True, False), integer("num_leaves", 15, 127), integer("max_depth", 3, 12), log("learning_rate", 1e-3, 0.1),
    integer("n_estimators", 50, 300), integer("min_child_samples", 5, 100), log("reg_alpha", 1e-8, 10.0), log("reg_lambda", 1e-8, 10.0), choice("class_weight", "balanced", None),
    real("feature_fraction", 0.7, 0.95), real("bagging_fraction", 0.7, 0.95), real("min_split_gain", 0.0, 1.0), log("min_child_weight", 1e-3, 10.0), choice("boosting_type", "gbdt", "dart", "goss"),
    choice("objective", "binary"), choice("metric", "binary_logloss", "auc"),
]

SPACES: dict[str, list[Param]] = {"logistic": LINEAR, "svm": LINEAR, "gbt": TREES, "mlp": MLP, "autoencoder": AUTOENCODER}


def restricted(space: list[Param], **narrower) -> list[Param]:
    """A space with some choices narrowed to those named, all of which it must have."""
    out = []
    for p in space:
        if p.name in narrower:
            if p.kind != "choice" or not set(narrower[p.name]) <= set(p.choices):
                raise ValueError(f"{p.name} can't be narrowed to {narrower[p.name]!r}")
            p = choice(p.name, *narrower[p.name], when=p.when)
        out.append(p)
    if unknown := set(narrower) - {p.name for p in space}:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return out


#: What the trainers of this library take of the spaces: sampled rates by batch and trees without dropped trees.
TRAINABLE = {
    "logistic": restricted(LINEAR, learning_rate=("optimal", "constant", "invscaling")), "svm": restricted(LINEAR, learning_rate=("optimal", "constant", "invscaling")),
    "gbt": restricted(TREES, boosting_type=("gbdt", "goss")),
}


def trainer_params(family: str, values: dict):
    """(parameters of the family's trainer, use_log) of drawn values: ``SgdParams`` or ``LeafwiseParams``."""
    from tessera.models import sgd, trees

    v = validate(TRAINABLE[family], values) if family in TRAINABLE else None
    if v is None:
        raise ValueError(f"{family} is not trained from this space")
    if family == "gbt":
        same = ("num_leaves", "max_depth", "learning_rate", "n_estimators", "min_child_samples", "reg_alpha", "reg_lambda", "feature_fraction", "bagging_fraction", "min_split_gain", "min_child_weight")
        return trees.LeafwiseParams(boosting=v["boosting_type"], balanced=v["class_weight"] == "balanced", **{k: v[k] for k in same}), v["use_log_transform"]
    made = sgd.SgdParams(
        loss=sgd.LOSSES[family], penalty=v["penalty"], alpha=v["alpha"], l1_ratio=v.get("l1_ratio", 0.0), learning_rate=v["learning_rate"], eta0=v["eta0"], power_t=v["power_t"],
        batch_size=v["batch_size"], n_epochs=EPOCHS, patience=v["n_iter_no_change"], sampler=v["sampler_type"], balanced=v["class_weight"] == "balanced", relayout=int(v["shuffle"]),
    )
    return made, v["use_log_transform"]
