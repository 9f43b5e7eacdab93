"""Column functions with the defined edge cases of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET_SUM = 1e4
CLIP = 6.0
EPS = 1e-10


def scaling_factor(total: Column, target: float = TARGET_SUM) -> Column:
    """target / total, and 1 where the total isn't positive."""
    return F.when(total > 0, F.lit(target) / total).otherwise(F.lit(1.0))


def clip(x: Column, low: float = -CLIP, high: float = CLIP) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def zscore(x: Column, mu: Column, sigma: Column, eps: float = EPS, bound: float | None = CLIP) -> Column:
    z = (x - mu) / (sigma + eps)
    return z if bound is None else clip(z, -bound, bound)


def inverse_zscore(z: Column, mu: Column, sigma: Column, eps: float = EPS) -> Column:
    return z * (sigma + eps) + mu


def inverse_log(x: Column, bound: float = 10.0) -> Column:
    return F.expm1(clip(x, -bound, bound))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def theta_activation(x: Column) -> Column:
    return clip(softplus(x), 1e-4, 1e3)


def hard_label(expansion: Column) -> Column:
    """1 for 'expanded', 0 for all else, null included."""
    return F.when(expansion == "expanded", 1).otherwise(0)


def soft_label(size: Column, median: Column, beta: float = 1.0, ratio: float = 1.5) -> Column:
    """sigmoid(beta (size / median - ratio)); a median that isn't positive counts as 1, NaN or null gives 0."""
    safe = F.when(median > 0, median).otherwise(F.lit(1.0))
    out = sigmoid(beta * (size / safe - ratio))
    return F.coalesce(F.nanvl(out, F.lit(0.0)), F.lit(0.0))


def r6(x: Column) -> Column:
    """Six decimals, never a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def bce(y: Column, p: Column, weight: float = 1.0) -> Column:
    """Binary cross-entropy of a row, positives weighted."""
    safe = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return -(weight * y * F.ln(safe) + (1 - y) * F.ln(1 - safe))


def finite(x: Column) -> Column:
    """Zero in place of NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def squared_error(y: Column, p: Column) -> Column:
    """Null (so no part of a mean) where the target is NaN or null.  A prediction that isn't a number
    stays: a broken model shows as a loss of NaN."""
    return F.when(~F.isnan(y), F.pow(y - p, F.lit(2.0)))


def lgamma(x: Column) -> Column:
    """log Gamma for positive x: Stirling's series at x + 8, taken back by the product."""
    z = x + 8
    up = F.ln(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = (z - 0.5) * F.ln(z) - z + F.lit(0.9189385332046727) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return series - up


def nb_log_likelihood(x: Column, mu: Column, theta: Column, eps: float = 1e-8) -> Column:
    """Negative binomial log-likelihood of a count, with bounded arguments."""
    mu, theta, x = F.least(mu, F.lit(1e6)), F.least(theta, F.lit(1e4)), F.least(x, F.lit(1e6))
    g = lambda v: lgamma(F.least(v, F.lit(1e3)))
    norm = F.ln(theta + mu + eps)
    return theta * (F.ln(theta + eps) - norm) + x * (F.ln(mu + eps) - norm) + g(x + theta) - g(theta) - g(x + 1)


def zinb_log_likelihood(x: Column, mu: Column, theta: Column, pi: Column, eps: float = 1e-8) -> Column:
    """Zero-inflated negative binomial: zeros come from either part."""
    nb = nb_log_likelihood(x, mu, theta, eps)
    return F.when(x < eps, F.ln(pi + (1 - pi) * F.exp(nb) + eps)).otherwise(F.ln(1 - pi + eps) + nb)
