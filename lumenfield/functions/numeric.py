"""Column arithmetic shared by the operators. Everything stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | str | float | int


def c(v: Num) -> Column:
    """A column from a name, a number (always DOUBLE, never DECIMAL) or a column."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.lit(float(v))


def clamp(v: Num, lo: Num, hi: Num) -> Column:
    return F.greatest(c(lo), F.least(c(hi), c(v)))


def sq(v: Num) -> Column:
    v = c(v)
    return v * v


def dot(a: Sequence[Num], b: Sequence[Num]) -> Column:
    total = c(a[0]) * c(b[0])
    for p, q in zip(a[1:], b[1:]):
        total = total + c(p) * c(q)
    return total


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: Sequence[Column]) -> list[Column]:
    n = F.sqrt(dot(a, a))
    return [v / F.nullif(n, F.lit(0.0)) for v in a]


def mat_vec(m: Sequence[Num], v: Sequence[Num]) -> list[Column]:
    """Row-major 3×n matrix times a column vector."""
    n = len(v)
    return [dot(m[i : i + n], v) for i in range(0, len(m), n)]


def mat_mul(a: Sequence[Num], b: Sequence[Num]) -> list[Column]:
    return [dot([a[3 * i + k] for k in range(3)], [b[3 * k + j] for k in range(3)]) for i in range(3) for j in range(3)]


def mat_inverse(m: Sequence[Num]) -> list[Column]:
    """Closed-form inverse of a row-major 3×3; all NULL when singular."""
    a, b, d, e, f, g, h, i, j = (c(v) for v in m)
    det = F.nullif(a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h), F.lit(0.0))
    cof = [
        f * j - g * i, d * i - b * j, b * g - d * f,
        g * h - e * j, a * j - d * h, d * e - a * g,
        e * i - f * h, b * h - a * i, a * f - b * e,
    ]
    return [v / det for v in cof]


def erf(x: Num) -> Column:
    """Error function by the rational approximation 7.1.26 of Abramowitz & Stegun, |error| < 1.5e-7."""
    x = c(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(x))
    poly = F.lit(0.0)
    for k in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(k)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def weighted_mean(value: Num, weight: Num) -> Column:
    return F.sum(c(value) * c(weight)) / F.nullif(F.sum(c(weight)), F.lit(0.0))


def half_up(v: Num) -> Column:
    """Rounding half away from zero on the binary value, as ``round`` does in C."""
    v = c(v)
    return F.signum(v) * F.floor(F.abs(v) + F.lit(0.5))


def segment(points: str, key: str, x: Num) -> Column:
    """0-based number of the segment of a sorted array column of structs that holds ``x`` in [point, next point); the first and last segments reach on without end.

    A binary search in the row: an as-of lookup without a join by range. NULL for a NULL or NaN ``x``; 0 for arrays of fewer than two points.
    """
    n, x = F.size(points), c(x)
    at = lambda i: F.get(F.col(points), i)[key]
    state = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        upper = at(mid) <= x
        return F.when(s["hi"] - s["lo"] > 1, state(F.when(upper, mid).otherwise(s["lo"]), F.when(upper, s["hi"]).otherwise(mid))).otherwise(s)

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n + 1)).cast("int")))
    found = F.aggregate(steps, state(F.lit(0), n), halve, lambda s: F.greatest(F.lit(0), F.least(s["lo"], n - 2)))
    return F.when(~F.isnan(x), found)
