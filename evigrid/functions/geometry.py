"""Vectors, rotations and symmetric 3 x 3 matrices as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = Sequence[Column]


def dot(a: Triple, b: Triple) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: Triple, b: Triple) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Triple) -> Column:
    return F.sqrt(dot(a, a))


def rotate(q: Sequence[Column], v: Triple) -> list[Column]:
    """v turned by the unit quaternion (w, x, y, z)."""
    t = [2 * c for c in cross(q[1:], v)]
    return [x + q[0] * y + z for x, y, z in zip(v, t, cross(q[1:], t), strict=True)]


def transform(q: Sequence[Column], shift: Triple, v: Triple) -> list[Column]:
    return [a + b for a, b in zip(rotate(q, v), shift, strict=True)]


def facing(start: Triple, end: Triple) -> list[Column]:
    """Quaternion (w, x, y, z) that turns the x axis to the direction from start to end; no turn if they are parallel."""
    d = [b - a for a, b in zip(start, end, strict=True)]
    length = norm(d)
    c = F.least(F.greatest(d[0] / length, F.lit(-1.0)), F.lit(1.0))
    side = F.sqrt(d[1] * d[1] + d[2] * d[2])
    half = F.sqrt((1 - c) / 2)
    turned = side / length > 1e-10
    return [F.when(turned, v).otherwise(o) for v, o in ((F.sqrt((1 + c) / 2), 1.0), (0 * c, 0.0), (-half * d[2] / side, 0.0), (half * d[1] / side, 0.0))]


def pinhole(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    """Point that a pixel sees at a depth."""
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


#: Entries of a symmetric matrix come in this order.
ENTRIES = ("xx", "xy", "xz", "yy", "yz", "zz")


def determinant(m: Sequence[Column]) -> Column:
    a, b, c, d, e, f = m
    return a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)


def inverse(m: Sequence[Column]) -> list[Column]:
    a, b, c, d, e, f = m
    det = determinant(m)
    return [x / det for x in (d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b)]


def quadratic(m: Sequence[Column], v: Triple) -> Column:
    """v' m v"""
    a, b, c, d, e, f = m
    x, y, z = v
    return a * x * x + d * y * y + f * z * z + 2 * (b * x * y + c * x * z + e * y * z)


def mahalanobis(m: Sequence[Column], v: Triple) -> Column:
    return F.sqrt(F.greatest(quadratic(inverse(m), v), F.lit(0.0)))


def eigenvalues(m: Sequence[Column]) -> list[Column]:
    """Eigenvalues in ascending order, by the trigonometric solution of the characteristic equation."""
    a, b, c, d, e, f = m
    mean = (a + d + f) / 3
    spread = F.sqrt(((a - mean) ** 2 + (d - mean) ** 2 + (f - mean) ** 2 + 2 * (b * b + c * c + e * e)) / 6)
    scaled = [x / spread for x in (a - mean, b, c, d - mean, e, f - mean)]
    angle = F.acos(F.least(F.greatest(determinant(scaled) / 2, F.lit(-1.0)), F.lit(1.0))) / 3
    high, low = mean + 2 * spread * F.cos(angle), mean + 2 * spread * F.cos(angle + 2 * math.pi / 3)
    flat = spread < 1e-12
    return [F.when(flat, mean).otherwise(v) for v in (low, 3 * mean - high - low, high)]


def volume(m: Sequence[Column]) -> Column:
    """Volume of the unit ellipsoid of a covariance."""
    return 4 / 3 * math.pi * F.sqrt(F.greatest(determinant(m), F.lit(0.0)))


def in_view(q: Sequence[Column], eye: Triple, point: Triple, reach: float, horizontal: float, vertical: float) -> Column:
    """Whether a camera that looks along its x axis has point in its angles (full widths, radians) and reach."""
    d = [b - a for a, b in zip(eye, point, strict=True)]
    length = norm(d)
    ahead = rotate(q, [F.lit(1.0), F.lit(0.0), F.lit(0.0)])
    flat = F.sqrt(d[0] * d[0] + d[1] * d[1]) * F.sqrt(ahead[0] * ahead[0] + ahead[1] * ahead[1])
    cosine = F.when(flat > 0, (d[0] * ahead[0] + d[1] * ahead[1]) / flat).otherwise(0.0)
    sideways = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) <= horizontal / 2
    upwards = F.abs(F.asin(F.least(F.greatest(d[2] / length, F.lit(-1.0)), F.lit(1.0)))) <= vertical / 2
    return (length > 1e-10) & (length <= reach) & sideways & upwards


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpack_rgb(c: Column) -> list[Column]:
    return [F.shiftright(c, n).bitwiseAND(F.lit(255)) for n in (16, 8, 0)]
