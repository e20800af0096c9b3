"""Shared-exponent quantisation as Column formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfield.functions.numeric import Num, c


def exponent(top: Column) -> Column:
    """e with 2^(e−1) ≤ top < 2^e; NULL below the smallest storable value."""
    e = F.floor(F.log2(F.when(top >= 1e-32, top))) + 1
    two = F.lit(2.0)
    # log2 may land on the wrong side of an exact power of two
    return F.when(top >= F.pow(two, e), e + 1).when(top < F.pow(two, e - 1), e - 1).otherwise(e).cast("int")


def quantise(channels: Sequence[Num], rounded: bool, e: Num) -> list[Column]:
    """Mantissas 0–255 at exponent ``e``, truncated or rounded."""
    scale = F.pow(F.lit(2.0), F.lit(8.0) - c(e))
    out = []
    for ch in channels:
        m = F.greatest(F.lit(0.0), c(ch)) * scale + (0.5 if rounded else 0.0)
        out.append(F.least(F.lit(255), F.floor(m)).cast("int"))
    return out


def restore(mantissa: Num, e: Num) -> Column:
    """Value at the middle of the quantisation step; 0 where nothing was stored."""
    return F.coalesce((c(mantissa) + 0.5) * F.pow(F.lit(2.0), c(e) - 8.0), F.lit(0.0))


def round_trip(channels: Sequence[str], rounded: bool = True) -> dict[str, Column]:
    """Quantised and restored channels."""
    e = exponent(F.greatest(*[c(ch) for ch in channels], F.lit(0.0)))
    return {ch: restore(m, e) for ch, m in zip(channels, quantise(channels, rounded, e))}
