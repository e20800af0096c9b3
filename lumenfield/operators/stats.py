"""Aggregates, profiles, ranked lists and luminance distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfield.functions.numeric import c, weighted_mean
from lumenfield.operators import ranking as R

# Default luminance thresholds and top fractions of the distribution tables.
THRESHOLDS = (0.01, 0.1, 1.0, 10.0, 50.0, 100.0, 200.0, 300.0, 500.0, 750.0, 1000.0, 3000.0, 5000.0, 10000.0)
TAILS = (0.0001, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)
EXTRA_POINTS = (0.001, 0.01, 0.1, 0.5, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 0.9995, 0.9999)


def summary(value: str, omega: str | None = None) -> list[Column]:
    """Count, solid angle, min, max, mean and population standard deviation."""
    out = [F.count(value).alias("n_px")]
    if omega:
        out.append(F.sum(omega).alias("omega"))
    return out + [F.min(value).alias("v_min"), F.max(value).alias("v_max"), F.avg(value).alias("v_mean"), F.stddev_pop(value).alias("v_std")]


def region_stats(df: DataFrame, keys: Sequence[str], value: str = "lum", omega: str | None = "omega") -> DataFrame:
    return df.groupBy(*keys).agg(*summary(value, omega))


def capture_summary(df: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pixels, solid angle, ω-weighted mean, maximum and vertical illuminance of valid pixels."""
    return df.filter("valid").groupBy(*keys).agg(
        F.count("*").alias("n_px"),
        F.sum("omega").alias("omega_sr"),
        weighted_mean("lum", "omega").alias("lum_mean"),
        F.max("lum").alias("lum_max"),
        F.sum(F.col("dy") * F.col("omega") * F.col("lum")).alias("ev_lux"),
    )


def profile(
    df: DataFrame, axis: str, values: Sequence[str] = ("lum",), keys: Sequence[str] = ("image_id",), weighting: str = "lines"
) -> DataFrame:
    """Row (``axis='y'``) or column profile: line means, solid angle, cumulative solid angle and running means.

    ``lines`` averages line means; ``omega`` weights lines by solid angle, or by count where they have none.
    The window sees one row per picture line.
    """
    lines = df.groupBy(*keys, axis).agg(
        F.count("*").alias("n_px"), F.sum("omega").alias("omega"), *[F.avg(v).alias(f"{v}_mean") for v in values]
    )
    w = W.partitionBy(*keys).orderBy(axis).rowsBetween(W.unboundedPreceding, W.currentRow)
    wt = F.lit(1.0) if weighting == "lines" else F.when(F.col("omega") > 0, F.col("omega")).otherwise(c("n_px"))
    lines = lines.withColumn("_w", wt)
    return lines.withColumns({
        "line": F.col(axis) - F.min(axis).over(W.partitionBy(*keys)),
        "omega_cum": F.sum("omega").over(w),
        **{f"{v}_run": F.sum(F.col(f"{v}_mean") * F.col("_w")).over(w) / F.sum("_w").over(w) for v in values},
    }).drop("_w")


def angle_axis(lines: DataFrame, axis: str, centre: int, size: tuple[int, int], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Add ``axis_deg``: angle of each line's middle pixel from that of the first line in view; NULL where the middle pixel is out of view."""
    from lumenfield.functions.geometry import angle_between, equidistant

    x, y = (c(float(centre)), c(axis)) if axis == "y" else (c(axis), c(float(centre)))
    g = equidistant(x, y, float(size[0]), float(size[1]))
    w = W.partitionBy(*keys).orderBy(axis)
    out = lines.withColumns({f"_{k}": F.when(g["radius"] <= 0.5, g[k]) for k in ("dx", "dy", "dz")})
    first = [F.first(f"_{k}", ignorenulls=True).over(w) for k in ("dx", "dy", "dz")]
    angle = F.degrees(angle_between(["_dx", "_dy", "_dz"], first))
    return out.withColumn("axis_deg", F.when(F.col("_dx").isNotNull(), angle)).drop("_dx", "_dy", "_dz")


def ranked(df: DataFrame, keys: Sequence[str] = ("image_id",), value: str = "lum", weighted: bool = False, ties: Sequence[str] = ("y", "x")) -> DataFrame:
    """Descending list with cumulative solid angle and running mean; prefix sums are exact for pictures of any size."""
    wt = F.greatest(F.col("omega"), F.lit(0.0)) if weighted else F.lit(1.0)
    out = R.ranked(df, keys, value, {"omega_cum": F.col("omega"), "_w": wt, "_v": F.col(value) * wt}, ties)
    return out.withColumn("running_mean", F.col("_v") / F.nullif(F.col("_w"), F.lit(0.0))).drop("_v", "_w")


def luminance_distribution(df: DataFrame, keys: Sequence[str] = ("image_id",), value: str = "lum", points: int = 4097) -> DataFrame:
    """Quantile curve (keys, idx, q, v): sorted values at evenly spaced ranks plus fixed extra points."""
    keys = list(keys)
    ranks = R.value_ranks(df, keys, value)
    n1 = (F.col("n") - 1).cast("double")
    m = F.greatest(F.lit(2), F.least(F.lit(points), F.col("n"))).cast("bigint")
    hi = F.col("lo") + F.col("cnt") - 1
    # the even points whose rank may fall into [lo, hi]; only neighbours of the range are generated, then tested
    first = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("lo") * (m - 1) / F.greatest(n1, F.lit(1.0))) - 1)
    last = F.least(m - 1, F.ceil(hi * (m - 1) / F.greatest(n1, F.lit(1.0))) + 1)
    even = F.transform(F.sequence(first, last), lambda i: F.floor(i.cast("double") / (m - 1).cast("double") * n1 + 0.5))
    extra = F.transform(F.array(*[F.lit(q) for q in EXTRA_POINTS]), lambda q: F.floor(q * n1 + 0.5))
    idx = F.array_distinct(F.filter(F.concat(even, extra), lambda i: (i >= F.col("lo")) & (i <= hi)))
    out = ranks.withColumn("idx", F.explode_outer(idx)).filter("idx is not null")
    return out.select(*keys, "idx", (F.col("idx") / F.nullif(n1, F.lit(0.0))).alias("q"), F.col(value).alias("v"))


def approximate_distribution(df: DataFrame, keys: Sequence[str] = ("image_id",), value: str = "lum", accuracy: int = 10000) -> DataFrame:
    """One-pass sketch of the extra points where an exact curve is not needed."""
    q = F.array(*[F.lit(p) for p in EXTRA_POINTS])
    return df.groupBy(*keys).agg(F.percentile_approx(value, list(EXTRA_POINTS), accuracy).alias("v")).select(
        *keys, F.inline(F.arrays_zip(q.alias("q"), F.col("v").alias("v")))
    )


def threshold_table(df: DataFrame, keys: Sequence[str] = ("image_id",), value: str = "lum", thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Count and share of values ≥ each threshold: one conditional count per threshold in a single aggregate, then unpivoted."""
    agg = df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.count_if(F.col(value) >= t).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("n_above")) for i, t in enumerate(thresholds)])
    return agg.select(*keys, "n", F.inline(rows)).withColumn("share", F.col("n_above") / F.col("n")).drop("n")


def tail_table(df: DataFrame, keys: Sequence[str] = ("image_id",), value: str = "lum", tails: Sequence[float] = TAILS) -> DataFrame:
    """Threshold at 1−f and share of the total held by the top ⌈f·n⌉ values (at least one)."""
    keys = list(keys)
    ranks = R.value_ranks(df, keys, value)
    aggs = [F.max("n").alias("n"), F.sum(F.col(value) * F.col("cnt")).alias("_total")]
    for i, f in enumerate(tails):
        top = F.greatest(F.lit(1.0), F.ceil(F.col("n").cast("double") * f).cast("double"))
        first = F.col("n") - top
        part = F.greatest(F.lit(0.0), F.least(F.col("cnt").cast("double"), F.col("lo") + F.col("cnt") - first))
        pos = (F.col("n") - 1).cast("double") * (1.0 - f)
        aggs += [
            F.sum(F.col(value) * part).alias(f"_s{i}"),
            R.at_rank(value, F.floor(pos)).alias(f"_a{i}"),
            R.at_rank(value, F.least(F.floor(pos) + 1, F.col("n") - 1)).alias(f"_b{i}"),
        ]
    g = ranks.groupBy(*keys).agg(*aggs)
    rows = []
    for i, f in enumerate(tails):
        pos = (F.col("n") - 1).cast("double") * (1.0 - f)
        t = pos - F.floor(pos)
        rows.append(F.struct(
            F.lit(float(f)).alias("top_fraction"),
            (F.col(f"_a{i}") * (F.lit(1.0) - t) + F.col(f"_b{i}") * t).alias("threshold"),
            F.when(F.col("_total") > 0, F.col(f"_s{i}") / F.col("_total")).otherwise(F.lit(0.0)).alias("share"),
        ))
    return g.select(*keys, F.inline(F.array(*rows)))


def highlight(df: DataFrame, lo: float, hi: float, value: str = "lum") -> DataFrame:
    """Flag pixels between two values (both ends included)."""
    return df.withColumn("highlighted", F.col(value).between(lo, hi))


def histogram(df: DataFrame, keys: Sequence[str], value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width histogram; bin 0 is below ``lo`` and bin ``bins + 1`` from ``hi`` upward."""
    return df.groupBy(*keys, F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n_px"))


def regression(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("corr"), F.count("*").alias("n")
    )


def scale_fit(y: Column, x: Column) -> Column:
    """One-parameter least squares y ≈ k·x."""
    return F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))


def minkowski_mean(value: Column, p: float) -> Column:
    return F.pow(F.avg(F.pow(F.abs(value), F.lit(float(p)))), F.lit(1.0 / p))


def geometric_mean(value: Column) -> Column:
    return F.exp(F.avg(F.log(value)))


def top_pixels(df: DataFrame, k: int, keys: Sequence[str] = ("image_id",), value: str = "lum", ties: Sequence[str] = ("y", "x")) -> DataFrame:
    """The k brightest pixels of each picture with stable tie order.

    Each row is ranked within a (picture, slice) first, so a large picture is reduced by many tasks before the final ranking
    of at most k rows per slice.
    """
    order = [F.desc(value), *[F.asc(t) for t in ties]]
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*ties), F.lit(64)))
    local = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))).filter(F.col("_r") <= k)
    final = local.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return final.drop("_s", "_r")


def rollup_stats(df: DataFrame, levels: Sequence[str], value: str, omega: str | None = None) -> DataFrame:
    """Statistics at every level of a hierarchy (day → capture → picture …) in one pass."""
    return df.rollup(*levels).agg(*summary(value, omega), F.grouping_id().cast("int").alias("level"))


def cube_stats(df: DataFrame, dims: Sequence[str], value: str, omega: str | None = None) -> DataFrame:
    return df.cube(*dims).agg(*summary(value, omega), F.grouping_id().cast("int").alias("level"))


def block_means(df: DataFrame, size: int = 32, value: str = "lum", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Means of whole size × size blocks; rests at the right and lower border are left out."""
    by, bx = F.floor(F.col("y") / size).cast("int"), F.floor(F.col("x") / size).cast("int")
    whole = ((by + 1) * size <= F.col("height")) & ((bx + 1) * size <= F.col("width"))
    return df.filter(whole).groupBy(*keys, by.alias("by"), bx.alias("bx")).agg(F.avg(value).alias("mean"))


def block_difference(a: DataFrame, b: DataFrame, size: int = 32, value: str = "lum", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Relative difference of block means of two pictures, blocks above 1e-4 of the brightest: 99th percentile and maximum."""
    keys = list(keys)
    j = block_means(a, size, value, keys).join(block_means(b, size, value, keys).withColumnRenamed("mean", "mean_b"), [*keys, "by", "bx"])
    top = j.groupBy(*keys).agg(F.max("mean").alias("_top"))
    d = j.join(top, keys).filter(F.col("mean") > F.col("_top") * 1e-4)
    d = d.withColumn("diff", F.abs(F.col("mean_b") - F.col("mean")) / F.col("mean"))
    p = R.percentiles(d, keys, "diff", {"p99": ("linear", 0.99), "worst": ("linear", 1.0)})
    return p.withColumnRenamed("n", "n_blocks")
