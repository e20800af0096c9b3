"""Comparing two pictures pixel by pixel. Both carry the same pixel key, so every operator here is one equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.functions import rgbe
from lumenfield.functions.numeric import c
from lumenfield.operators import ranking as R

PX = ("image_id", "y", "x")


def _pair(test: DataFrame, ref: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return test.join(ref.select(*keys, *[F.col(k).alias(f"_{k}") for k in columns]), list(keys))


def difference(test: DataFrame, ref: DataFrame, value: str = "lum", keys: Sequence[str] = PX) -> DataFrame:
    """Error, absolute, squared, relative absolute and relative squared error."""
    d = _pair(test, ref, [value], keys)
    e, r = F.col(value) - F.col(f"_{value}"), F.col(f"_{value}")
    return d.select(*keys, e.alias("e"), F.abs(e).alias("ae"), (e * e).alias("se"), (F.abs(e) / (r + 0.01)).alias("rae"), (e * e / (r * r + 0.01)).alias("rse"))


def preservation(test: DataFrame, ref: DataFrame, mask: DataFrame, value: str = "contrast", keys: Sequence[str] = PX) -> DataFrame:
    """Contrast kept, min(1, test/ref), with the mask-weighted test, reference and visibility maps. ``mask(keys, weight)`` is sparse."""
    d = _pair(test.select(*keys, value), ref, [value], keys).join(mask.select(*keys, "weight"), list(keys), "left")
    w, r, t = F.coalesce("weight", F.lit(0.0)), F.col(f"_{value}"), F.col(value)
    kept = F.when(r > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t / r))).otherwise(F.lit(1.0))
    d = d.select(*keys, w.alias("weight"), r.alias("ref"), t.alias("test"), kept.alias("kept"))
    return d.withColumns({
        "test_map": F.col("test") * F.col("weight"), "ref_map": F.col("ref") * F.col("weight"),
        "visibility": F.col("kept") * F.col("ref") * F.col("weight") * F.col("weight"),
    })


def view_summary(maps: DataFrame, by: Sequence[str] = ("image_id",), quantised: bool = True) -> DataFrame:
    """Masked pixels and area, reference and visibility totals, baseline, ratio and quality 0–10.

    ``quantised`` sums the maps as they would read back from a stored picture.
    """
    by = list(by)

    def stored(v: str):
        return rgbe.round_trip([v], rounded=False)[v] if quantised else c(v)

    inside = F.col("weight") > 0.5
    unit = 128.5 / 128.0 if quantised else 1.0
    g = maps.groupBy(*by).agg(
        F.count_if(inside).alias("view_pixels"), F.sum(stored("ref_map")).alias("ref_total"), F.sum(stored("visibility")).alias("visibility_total"),
        F.sum(F.when(inside, F.col("kept"))).alias("_kept"),
    )
    n = F.greatest(F.lit(1), F.col("view_pixels"))
    g = g.withColumn("view_size", F.col("view_pixels") * F.lit(unit))
    return g.withColumns({
        "baseline": F.col("ref_total") / F.greatest("view_size", F.lit(1e-9)), "ratio": F.col("visibility_total") / F.greatest("ref_total", F.lit(1e-9)),
        "quality": F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce("_kept", F.lit(0.0)) * 10.0 / n)),
    }).drop("_kept")


def change_mask(test: DataFrame, ref: DataFrame, channels: Sequence[str] = ("r", "g", "b"), keys: Sequence[str] = PX) -> DataFrame:
    """True where any channel changed by more than 0.1 % (by anything where the reference is 0)."""
    d = _pair(test, ref, channels, keys)
    changed = F.lit(False)
    for ch in channels:
        t, r = F.col(ch), F.col(f"_{ch}")
        changed = changed | F.when(r == 0, t != 0).otherwise(F.abs(t - r) / F.nullif(r, F.lit(0.0)) > 0.001)
    return d.select(*keys, changed.alias("changed"))


def map_summary(df: DataFrame, value: str, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Minimum, median, mean and maximum of a map."""
    by = list(by)
    a = df.groupBy(*by).agg(F.min(value).alias("v_min"), F.avg(value).alias("v_mean"), F.max(value).alias("v_max"))
    return a.join(R.percentiles(df, by, value, {"v_median": ("median", 0.5)}).drop("n"), by)


def step_comparison(a: DataFrame, b: DataFrame, channels: Sequence[str] = ("r", "g", "b"), by: Sequence[str] = ("image_id",), keys: Sequence[str] = PX) -> DataFrame:
    """Share of pixels that differ by more than one stored step (1/128), identical share and largest relative difference."""
    by = list(by)
    d = _pair(a.select(*keys, *channels), b, channels, keys)
    top = d.groupBy(*by).agg(F.max(F.greatest(*channels, *[f"_{ch}" for ch in channels])).alias("_top"))
    rel = F.greatest(*[
        F.when(F.greatest(F.abs(ch), F.abs(f"_{ch}")) > F.col("_top") * 1e-9, F.abs(F.col(ch) - F.col(f"_{ch}")) / F.greatest(F.abs(ch), F.abs(f"_{ch}"))).otherwise(F.lit(0.0))
        for ch in channels
    ])
    d = d.join(top, by).withColumn("_rel", rel)
    return d.groupBy(*by).agg(
        F.avg((F.col("_rel") > 1.0001 / 128.0).cast("double")).alias("beyond"), F.avg((F.col("_rel") == 0).cast("double")).alias("identical"), F.max("_rel").alias("worst")
    )
