"""Scalar functions over columns: uncertainty, kernels, costs. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def mean_of_millionths(x: Column) -> Column:
    """Aggregate: the mean of values of at most six decimals, to six decimals. Whole millionths are summed, so the order of rows doesn't matter."""
    return F.round(F.sum(F.round(x * 1e6).cast("long")) / F.count(x)) / 1e6


def total(a: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def argmax(a: Column) -> Column:
    """Index from 0 of the largest entry, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def vacuity(evidence: Column) -> Column:
    """K / sum(e + 1), between 0 and 1; 1 without evidence."""
    k = F.size(evidence)
    return F.when(k == 0, 1.0).otherwise(clamp(k / (total(evidence) + k)))


def entropy(p: Column) -> Column:
    """Shannon entropy over its maximum ln K."""
    h = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 1e-10, x * F.ln(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, h / F.ln(F.size(p).cast("double"))).otherwise(0.0)


def observation_uncertainty(distance: Column, most: float, w_range: float = 0.5) -> Column:
    return clamp(w_range * distance / most)


def total_uncertainty(parts: list[Column], weights: list[float]) -> Column:
    return clamp(sum((p * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0)))


def normalised(weights: list[Column]) -> tuple[list[Column], Column]:
    """Weights over their sum (as they are if that isn't above 0), and whether they summed to 1 before."""
    whole = sum(weights[1:], weights[0])
    return [F.when(whole > 0, w / whole).otherwise(w) for w in weights], F.abs(whole - 1) < 0.001


def sparse_kernel(d: Column, length: Column, scale: float = 1.0) -> Column:
    """Compact kernel: 1 at 0, 0 from length on."""
    r, turn = d / length, 2 * math.pi
    return F.when(d >= length, 0.0).otherwise(scale * ((2 + F.cos(turn * r)) * (1 - r) / 3 + F.sin(turn * r) / turn))


def rbf_kernel(d: Column, length: Column) -> Column:
    return F.exp(-0.5 * F.pow(d / length, F.lit(2.0)))


def uncertainty_kernel(u: Column, threshold: float = 0.7, low: float = 0.3, gamma: float = 2.0) -> Column:
    return F.when(u >= threshold, 0.0).otherwise(F.exp(-gamma * F.pow(u - low, F.lit(2.0))))


def reachability_kernel(reachable: Column, d: Column, rate: float = 1.0) -> Column:
    return F.when(reachable, 1.0).otherwise(F.exp(-rate * d))


def adaptive_length(trace: Column, most: float, u: Column, low: float = 0.1, high: float = 0.5) -> Column:
    base = low + (high - low) * clamp(F.cbrt(trace / most))
    return F.least(F.greatest(base * F.least(F.greatest(F.exp(-1 + 3 * u), F.lit(0.5)), F.lit(2.0)), F.lit(low)), F.lit(2 * high))


def confidence_weight(u: Column, beta: float = 2.0) -> Column:
    return F.pow(1 - u, F.lit(beta))


def entropy_weight(u: Column, entropy_: Column, most: float, beta: float = 2.0, gamma: float = 1.0) -> Column:
    """confidence_weight() times (1 - entropy / most) ** gamma."""
    return confidence_weight(u, beta) * F.pow(1 - entropy_ / most, F.lit(gamma)) if most > 1e-10 else confidence_weight(u, beta)


def filter_kernel(keep: Column) -> Column:
    return F.when(keep, 1.0).otherwise(0.0)


def semantic_uncertainty(given: Column, evidence: Column) -> Column:
    """The given value if it lies in [0, 1], else the vacuity of the evidence, else 1."""
    return F.when(given.between(0, 1), given).when(F.size(evidence) > 0, vacuity(evidence)).otherwise(1.0)


def log_odds(p: Column, prior: float) -> Column:
    return F.ln(clamp(p, 1e-6, 1 - 1e-6) / prior)


def dirichlet_mean(alpha: Column) -> Column:
    return F.transform(alpha, lambda a: a / total(alpha))


def dirichlet_variance(alpha: Column) -> Column:
    s = total(alpha)
    return F.transform(alpha, lambda a: a * (s - a) / (s * s * (s + 1)))


def inflation_cost(d: Column, radius: float, rate: float = 10.0) -> Column:
    return F.when(d < radius, (100 * F.exp(-rate * d / radius)).cast("int")).otherwise(0)


def utility(gain: Column, distance: Column, reduction: Column, most: float, weights=(1.0, 0.3, 0.5)) -> Column:
    return weights[0] * gain - weights[1] * distance / most + weights[2] * reduction


#: Masses of no more than this sum are none.
TINY = 1e-10


def _shares(p: Column, otherwise: float | None = None) -> Column:
    """p over its sum; where that isn't above TINY, p as it is or times `otherwise`."""
    rest = lambda e: e["p"] if otherwise is None else F.transform(e["p"], lambda x: x * otherwise)
    return F.transform(F.array(F.struct(p.alias("p"), total(p).alias("s"))), lambda e: F.when(e["s"] > TINY, F.transform(e["p"], lambda x: x / e["s"])).otherwise(rest(e)))[0]


def fuse_masses(p: Column, u: Column, q: Column, v: Column) -> tuple[Column, Column]:
    """Dempster-Shafer fusion of beliefs scaled by their certainty: normalised masses, and the conflict."""
    a, b = F.transform(_shares(p, 0.0), lambda x: x * (1 - u)), F.transform(_shares(q, 0.0), lambda x: x * (1 - v))
    agree = F.zip_with(a, b, lambda x, y: x * y)
    conflict = F.least(total(a) * total(b) - total(agree), F.lit(1 - TINY))
    return _shares(F.zip_with(a, b, lambda x, y: x * y + x * v + u * y)), conflict


def remap(c: Column, relevant: list[int]) -> Column:
    """Position among the sorted relevant classes; the next number for all others."""
    order = sorted(set(relevant))
    out = F.lit(len(order))
    for k, v in enumerate(order):
        out = F.when(c == v, k).otherwise(out)
    return out.cast("int")


def spread(c: Column, confidence: Column, classes: int) -> Column:
    """A distribution with the confidence at class c and the rest shared equally."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.round(F.when(k == c, confidence).otherwise((1 - confidence) / (classes - 1)), 6))


def observation_length(u: Column, base: float = 0.3, beta: float = 0.5, gamma: float = 3.0) -> Column:
    """Length scale of one observation: the surer, the longer."""
    return F.greatest(base * beta * F.exp(1 - gamma * u), F.lit(1e-3))


def total_cost(cost: Column, u: Column, overhead: Column, floor: Column, factor: float = 0.2) -> Column:
    """3-D cost with an uncertainty penalty: a tenth above the robot, none on the floor near the ground."""
    return clamp((cost + factor * u) * F.when(overhead, 0.1).when(floor, 0.0).otherwise(1.0))


def from_log_odds(h: Column, prior: float) -> Column:
    """Probability of a class with log-odds h over its prior, against all others."""
    return prior / (prior + (1 - prior) * F.exp(-h))


def decay(h: Column, rate: float) -> Column:
    return F.zip_with(h, softmax(h), lambda x, p: x * (1 - rate * (1 - p)))
