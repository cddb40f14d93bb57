"""Evidence heads and losses on arrays of doubles, one row for each pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import softmax, total

ACTIVATIONS = {
    "softplus": lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "exp": lambda x: F.exp(F.least(x, F.lit(10.0))),
}


def evidence(logits: Column, kind: str = "softplus") -> Column:
    return F.transform(logits, ACTIVATIONS[kind])


def moments(alpha: Column, p: Column, tau: Column) -> tuple[Column, Column, Column]:
    """Mean, variance and vacuity of the flexible Dirichlet with concentration alpha, allocation p and dispersion tau."""
    a0, k = total(alpha) + tau, F.size(alpha)
    mean = F.zip_with(alpha, p, lambda a, q: (a + tau * q) / a0)
    var = F.zip_with(mean, p, lambda m, q: m * (1 - m) / (a0 + 1) + tau * tau * q * (1 - q) / (a0 * (a0 + 1)))
    return mean, var, k / a0


def dissonance(alpha: Column) -> Column:
    """Conflict among well supported classes: belief-weighted balance of each class with the others."""
    s = total(alpha)
    belief = F.transform(alpha, lambda a: (a - 1) / s)

    def term(b: Column, i: Column) -> Column:
        others = F.filter(belief, lambda x, j: j != i)
        balance = lambda x: 1 - F.abs(b - x) / (b + x + 1e-9)
        return b * total(F.transform(others, lambda x: x * balance(x))) / (total(others) + 1e-9)

    return total(F.transform(belief, term))


def one_hot(label: Column, k: int) -> Column:
    """Array of k; all zero for 255, which is no label."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def squared_error(target: Column, p: Column) -> Column:
    return total(F.zip_with(target, p, lambda t, q: (t - q) * (t - q)))


def brier(target: Column, mean: Column, var: Column) -> Column:
    return squared_error(target, mean) + total(var)


def digamma(x: Column) -> Column:
    """For x > 0: six steps of the recurrence, then the asymptotic series (error below 1e-10)."""
    z = x + 6
    r = 1 / (z * z)
    series = F.ln(z) - 1 / (2 * z) - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return series - sum((1 / (x + k) for k in range(1, 6)), 1 / x)


def lgamma(x: Column) -> Column:
    """For x > 0: six steps of the recurrence, then Stirling's series."""
    z = x + 6
    r = 1 / (z * z)
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z
    return series - sum((F.ln(x + k) for k in range(1, 6)), F.ln(x))


def mse_loss(target: Column, alpha: Column) -> Column:
    s = total(alpha)
    p = F.transform(alpha, lambda a: a / s)
    return squared_error(target, p) + total(F.transform(p, lambda q: q * (1 - q) / (s + 1)))


def log_loss(target: Column, alpha: Column) -> Column:
    s = total(alpha)
    return total(F.zip_with(target, alpha, lambda t, a: t * (F.ln(s + 1e-9) - F.ln(a + 1e-9))))


def digamma_loss(target: Column, alpha: Column) -> Column:
    s = total(alpha)
    return total(F.zip_with(target, alpha, lambda t, a: t * (digamma(s) - digamma(a))))


def kl_to_uniform(alpha: Column) -> Column:
    s, k = total(alpha), F.size(alpha).cast("double")
    spread = total(F.transform(alpha, lambda a: (a - 1) * (digamma(a) - digamma(s)) - lgamma(a)))
    return spread + lgamma(s) - lgamma(k)


def kl_regulariser(target: Column, alpha: Column) -> Column:
    """Divergence of the evidence for wrong classes from none."""
    return kl_to_uniform(F.zip_with(target, alpha, lambda t, a: t + (1 - t) * a))


def allocation(logits: Column) -> tuple[Column, Column]:
    """p and tau as the flexible head makes them of its logits: a softmax, and a softplus with a floor."""
    return softmax(logits), ACTIVATIONS["softplus"](logits[0]) + 1e-3
