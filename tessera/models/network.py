"""Networks: a multilayer perceptron and an autoencoder, in NumPy inside tasks.

Inference sends the weights to the executors (their size is that of the model) and runs the
forward pass on Arrow batches.  Training is synchronous: each step broadcasts weights, tasks
return one summed gradient each, the driver adds a few arrays and takes an AdamW step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.training import lr_schedule


@dataclass(frozen=True)
class MlpParams:
    layers: tuple[int, ...] = (64, 32)
    epochs: int = 20
    lr: float = 1e-2
    schedule: str = "cosine"
    weight_decay: float = 1e-4
    positives_weight: float = 1.0
    optimizer: str = "adamw"
    clip: float = 10.0
    patience: int = 5
    aux: tuple[tuple[str, int], ...] = ()  # categorical targets and their numbers of categories
    aux_weight: float = 0.1
    soft_start: int | None = None  # the epoch from which soft labels are the target; None: never
    seed: int = 1


@dataclass(frozen=True)
class AeParams:
    hidden: tuple[int, ...] = (64,)
    latent: int = 16
    loss: str = "mse"  # or "nb", "zinb": on counts, column ``t``
    classifier_weight: float = 1.0
    epochs: int = 20
    lr: float = 1e-2
    weight_decay: float = 1e-4
    positives_weight: float = 1.0
    clip: float = 10.0
    seed: int = 1


@dataclass
class Dense:
    """Layers of weights: input norm, then linear, norm, GELU, and a linear head of one logit."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def init(cls, n_in: int, layers: tuple[int, ...], seed: int) -> Dense:
        rng, w, before = np.random.default_rng(seed), {}, n_in
        for k, n in enumerate((*layers, 1)):
            w[f"w{k}"] = rng.normal(0, math.sqrt(2 / before), (before, n))
            w[f"b{k}"] = np.zeros(n)
            before = n
        return cls(w)

    def with_heads(self, aux: tuple[tuple[str, int], ...], seed: int) -> Dense:
        """Adds a softmax head on the last hidden layer for each categorical target."""
        rng, n = np.random.default_rng(seed + 1), self.weights[f"w{depth_of(self.weights) - 1}"].shape[0]
        for name, k in aux:
            self.weights[f"wa:{name}"], self.weights[f"ba:{name}"] = rng.normal(0, math.sqrt(1 / n), (n, k)), np.zeros(k)
        return self


def depth_of(w: dict[str, np.ndarray]) -> int:
    return sum(k[0] == "w" and k[1:].isdigit() for k in w)


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x Phi(x) and its derivative."""
    cdf = 0.5 * (1 + _erf(x / math.sqrt(2)))
    return x * cdf, cdf + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    sd = np.sqrt(x.var(axis=1, keepdims=True) + eps)
    return (x - x.mean(axis=1, keepdims=True)) / sd, sd


def layer_norm_back(g: np.ndarray, y: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return (g - g.mean(axis=1, keepdims=True) - y * (g * y).mean(axis=1, keepdims=True)) / sd


def forward(w: dict[str, np.ndarray], x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of rows; ``keep`` takes what the backward pass needs."""
    depth = depth_of(w)
    h, sd = layer_norm(x)
    if keep is not None:
        keep.append((None, h, sd, None))
    for k in range(depth - 1):
        z, sd = layer_norm(h @ w[f"w{k}"] + w[f"b{k}"])
        out, slope = gelu(z)
        if keep is not None:
            keep.append((h, z, sd, slope))
        h = out
    if keep is not None:
        keep.append((h, None, None, None))
    return (h @ w[f"w{depth - 1}"] + w[f"b{depth - 1}"])[:, 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, pos: float, aux: dict[str, np.ndarray] | None = None, aux_weight: float = 0.1) -> tuple[float, dict[str, np.ndarray]]:
    """Summed weighted cross-entropy of rows (labels may be soft), that of categorical targets
    added, and its gradient.  A category of -1 is unknown and counts for nothing."""
    keep: list = []
    logit = forward(w, x, keep)
    loss = pos * y * np.logaddexp(0, -logit) + (1 - y) * np.logaddexp(0, logit)
    g = ((1 - y) * sigmoid(logit) - pos * y * sigmoid(-logit))[:, None]
    depth, out = depth_of(w), {}
    h = keep[-1][0]
    out[f"w{depth - 1}"], out[f"b{depth - 1}"] = h.T @ g, g.sum(axis=0)
    g, total = g @ w[f"w{depth - 1}"].T, float(loss.sum())
    for name, codes in (aux or {}).items():
        known = np.flatnonzero(codes >= 0)
        share = softmax(h @ w[f"wa:{name}"] + w[f"ba:{name}"])
        total += aux_weight * float(-np.log(np.maximum(share[known, codes[known]], 1e-12)).sum())
        ga = np.zeros_like(share)
        ga[known] = share[known]
        ga[known, codes[known]] -= 1
        ga *= aux_weight
        out[f"wa:{name}"], out[f"ba:{name}"] = h.T @ ga, ga.sum(axis=0)
        g = g + ga @ w[f"wa:{name}"].T
    for k in range(depth - 2, -1, -1):
        h, z, sd, slope = keep[k + 1]
        g = layer_norm_back(g * slope, z, sd)
        out[f"w{k}"], out[f"b{k}"] = h.T @ g, g.sum(axis=0)
        g = g @ w[f"w{k}"].T
    return total, out


OPTIMIZERS = ("adamw", "adam", "sgd")


class Optimizer:
    """AdamW (decoupled decay), Adam (decay in the gradient) or SGD with momentum, after a clip
    of the whole gradient's norm; biases don't decay."""

    def __init__(self, decay: float, kind: str = "adamw"):
        if kind not in OPTIMIZERS:
            raise ValueError(f"unknown optimizer {kind!r}; known: {OPTIMIZERS}")
        self.decay, self.kind, self.t, self.m, self.v = decay, kind, 0, {}, {}

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], lr: float, clip: float) -> None:
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, clip / (norm + 1e-12))
        self.t += 1
        for k, x in g.items():
            decay = 0 if k.startswith("b") else self.decay
            x = x * scale + (0 if self.kind == "adamw" else decay * w[k])
            if self.kind == "sgd":
                self.m[k] = 0.9 * self.m.get(k, 0) + x
                w[k] -= lr * self.m[k]
                continue
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            step = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            w[k] -= lr * (step + (decay * w[k] if self.kind == "adamw" else 0))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch[name].to_pylist(), dtype=float).reshape(batch.num_rows, -1)


def predict(spark: SparkSession, rows: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(cell_id, p) of rows (cell_id, x)."""
    sent = spark.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.nan_to_num(sigmoid(forward(sent.value, _matrix(batch, "x"))), nan=0.5, posinf=1.0, neginf=0.0) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["cell_id"], pa.array(p)], names=["cell_id", "p"])

    return rows.select("cell_id", "x").mapInArrow(work, "cell_id long, p double")


def _sums(spark: SparkSession, rows: DataFrame, weights: dict[str, np.ndarray], step, columns: tuple[str, ...] = ("x", "y")) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss, rows and gradient, summed over tasks: one small row from each."""
    sent = spark.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, {k: np.zeros_like(v) for k, v in sent.value.items()}
        for batch in batches:
            if batch.num_rows:
                more, g = step(sent.value, {c: _matrix(batch, c) for c in columns})
                loss, n = loss + more, n + batch.num_rows
                for k in total:
                    total[k] += g[k]
        flat = np.concatenate([total[k].ravel() for k in sorted(total)])
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["loss", "n", "g"])

    parts = rows.select(*columns).mapInArrow(work, "loss double, n long, g array<double>")
    summed = parts.select("loss", "n", F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    got = summed.orderBy("i").collect()  # as many rows as the model has weights
    sent.unpersist()
    flat, out, at = np.array([r["g"] for r in got]), {}, 0
    for k in sorted(weights):
        size = weights[k].size
        out[k] = flat[at : at + size].reshape(weights[k].shape)
        at += size
    return got[0]["loss"], got[0]["n"], out


def train_mlp(spark: SparkSession, rows: DataFrame, params: MlpParams = MlpParams()) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights and the loss of each epoch, from rows (x array<double>, y), and as parameters
    say y_soft (the hard label where there is none) and ``<name>_code`` of each aux target."""
    n_in = len(rows.select("x").first()["x"])
    net = Dense.init(n_in, params.layers, params.seed).with_heads(params.aux, params.seed)
    opt, log = Optimizer(params.weight_decay, params.optimizer), []
    codes = tuple(f"{name}_code" for name, _ in params.aux)
    if params.soft_start is not None:
        soft = F.coalesce("y_soft", F.col("y").cast("double")) if "y_soft" in rows.columns else F.col("y").cast("double")
        rows = rows.withColumn("y_soft", soft)
    best, kept, wait = math.inf, None, 0
    for epoch in range(params.epochs):
        label = "y_soft" if params.soft_start is not None and epoch >= params.soft_start else "y"

        def step(w: dict, c: dict, label: str = label) -> tuple:
            aux = {name: c[f"{name}_code"][:, 0].astype(int) for name, _ in params.aux}
            return gradient(w, c["x"], c[label][:, 0], params.positives_weight, aux, params.aux_weight)

        loss, n, g = _sums(spark, rows, net.weights, step, ("x", label, *codes))
        log.append(loss / n)
        if log[-1] < best:
            best, kept, wait = log[-1], {k: v.copy() for k, v in net.weights.items()}, 0
        else:
            wait += 1
            if wait >= params.patience:
                break
        opt.step(net.weights, {k: v / n for k, v in g.items()}, lr_schedule(params.schedule, epoch, params.epochs, params.lr), params.clip)
    return kept, log


# -- Autoencoder --------------------------------------------------------------------------


LOSSES = ("mse", "nb", "zinb")


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log Gamma for positive x: recurrence up to 8, then the asymptotic series."""
    out, x = np.zeros_like(x), x.astype(float).copy()
    for _ in range(8):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def count_loss(raw: np.ndarray, t: np.ndarray, theta_raw: np.ndarray, pi_raw: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray | None]:
    """Negative log-likelihood of counts, averaged over genes and summed over rows, and its
    gradients by the raw mean, dispersion and dropout: negative binomial, zero-inflated if
    there is a dropout."""
    eps, n = 1e-8, t.shape[1]
    mu, theta = softplus(raw) + eps, softplus(theta_raw) + 1e-4
    both = theta + mu
    ll = theta * np.log(theta / both) + t * np.log(mu / both) + _lgamma(t + theta) - _lgamma(theta) - _lgamma(t + 1)
    d_mu = t / mu - (t + theta) / both
    d_theta = np.log(theta / both) + 1 - (t + theta) / both + digamma(t + theta) - digamma(np.broadcast_to(theta, t.shape))
    d_pi = None
    if pi_raw is not None:
        pi, zero = sigmoid(pi_raw), t == 0
        nb0 = np.exp(np.minimum(ll, 0))
        mix = pi + (1 - pi) * nb0 + eps
        part = np.where(zero, (1 - pi) * nb0 / mix, 1.0)
        d_pi = np.where(zero, (1 - nb0) / mix, -1 / (1 - pi + eps)) * pi * (1 - pi)
        ll = np.where(zero, np.log(mix), np.log(1 - pi + eps) + ll)
        d_mu, d_theta = d_mu * part, d_theta * part
        d_pi = -d_pi.sum(axis=0) / n
    return -float(ll.sum()) / n, -d_mu * sigmoid(raw) / n, -(d_theta * sigmoid(theta_raw)).sum(axis=0) / n, d_pi


def ae_init(n_in: int, p: AeParams) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    sizes = [n_in, *p.hidden, p.latent]
    w = {}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        w[f"we{k}"], w[f"be{k}"] = rng.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b)
    back = sizes[::-1]
    for k, (a, b) in enumerate(zip(back, back[1:], strict=False)):
        w[f"wd{k}"], w[f"bd{k}"] = rng.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b)
    if p.loss not in LOSSES:
        raise ValueError(f"unknown loss {p.loss!r}; known: {LOSSES}")
    if p.loss != "mse":  # dispersion of each gene, and its chance of a dropout
        w["btheta"] = np.ones(n_in)
    if p.loss == "zinb":
        w["bpi"] = np.full(n_in, -2.0)
    w["wc"], w["bc"] = rng.normal(0, math.sqrt(1 / p.latent), (p.latent, 1)), np.zeros(1)
    return w


def _stack(w: dict[str, np.ndarray], h: np.ndarray, part: str, keep: list) -> np.ndarray:
    depth = sum(k.startswith(f"w{part}") and k[2:].isdigit() for k in w)
    for k in range(depth):
        z = h @ w[f"w{part}{k}"] + w[f"b{part}{k}"]
        out, slope = gelu(z) if k < depth - 1 else (z, np.ones_like(z))
        keep.append((h, slope))
        h = out
    return h


def _stack_back(w: dict[str, np.ndarray], g: np.ndarray, part: str, keep: list, out: dict[str, np.ndarray]) -> np.ndarray:
    for k in range(len(keep) - 1, -1, -1):
        h, slope = keep[k]
        g = g * slope
        out[f"w{part}{k}"], out[f"b{part}{k}"] = h.T @ g, g.sum(axis=0)
        g = g @ w[f"w{part}{k}"].T
    return g


def ae_forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors, reconstructions and class probabilities."""
    z = _stack(w, x, "e", [])
    return z, _stack(w, z, "d", []), sigmoid((z @ w["wc"] + w["bc"])[:, 0])


def ae_gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, p: AeParams, t: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Reconstruction loss (of x, or of counts ``t``) plus weighted cross-entropy, and gradient."""
    enc, dec, out = [], [], {}
    z = _stack(w, x, "e", enc)
    r = _stack(w, z, "d", dec)
    logit = (z @ w["wc"] + w["bc"])[:, 0]
    pos = p.positives_weight
    bce = (pos * y * np.logaddexp(0, -logit) + (1 - y) * np.logaddexp(0, logit)).sum()
    if p.loss == "mse":
        recon, gr = ((r - x) ** 2).mean(axis=1).sum(), 2 * (r - x) / x.shape[1]
    else:
        recon, gr, out["btheta"], d_pi = count_loss(r, t, w["btheta"], w.get("bpi"))
        if d_pi is not None:
            out["bpi"] = d_pi
    loss = recon + p.classifier_weight * bce
    gz = _stack_back(w, gr, "d", dec, out)
    gc = p.classifier_weight * ((1 - y) * sigmoid(logit) - pos * y * sigmoid(-logit))[:, None]
    out["wc"], out["bc"] = z.T @ gc, gc.sum(axis=0)
    _stack_back(w, gz + gc @ w["wc"].T, "e", enc, out)
    return float(loss), out


def train_ae(spark: SparkSession, rows: DataFrame, params: AeParams = AeParams()) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights and losses, from rows (x, y) and for count losses the counts ``t``."""
    w = ae_init(len(rows.select("x").first()["x"]), params)
    opt, log = Optimizer(params.weight_decay), []
    columns = ("x", "y") if params.loss == "mse" else ("x", "y", "t")
    for epoch in range(params.epochs):
        loss, n, g = _sums(spark, rows, w, lambda a, c: ae_gradient(a, c["x"], c["y"][:, 0], params, c.get("t")), columns)
        log.append(loss / n)
        opt.step(w, {k: v / n for k, v in g.items()}, lr_schedule("cosine", epoch, params.epochs, params.lr), params.clip)
    return w, log


def ae_predict(spark: SparkSession, rows: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(cell_id, p, mse): class probability and mean squared reconstruction error."""
    sent = spark.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x")
                _, r, p = ae_forward(sent.value, x)
                yield pa.RecordBatch.from_arrays([batch["cell_id"], pa.array(np.nan_to_num(p, nan=0.5)), pa.array(((r - x) ** 2).mean(axis=1))], names=["cell_id", "p", "mse"])

    return rows.select("cell_id", "x").mapInArrow(work, "cell_id long, p double, mse double")
