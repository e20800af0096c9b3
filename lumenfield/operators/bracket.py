"""Exposure brackets: frame metadata, raw levels, weights and merging.

``frames(bracket_id, frame_id, …)`` holds metadata, ``frame_px(bracket_id, frame_id, y, x, e, dn)`` raw samples with their
effective exposure. Frame size travels with the samples as ``width``/``height``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfield.functions.numeric import Num, c, half_up, mat_vec
from lumenfield.operators import ranking as R
from lumenfield.operators.stencil import column_window, core, row_window, tiles
from lumenfield.session import cut_lineage

PX = ("bracket_id", "y", "x")
RGGB = 0x94949494

# --- frame metadata ---


def third_stop(seconds: Num) -> Column:
    """Nearest third stop."""
    t = c(seconds)
    return F.when(t > 0, F.pow(F.lit(2.0), half_up(F.log2(t) * 3.0) / 3.0)).otherwise(t)


def corrected_aperture(n: Num, overrides: Sequence[tuple[float, float]] = ()) -> Column:
    """Measured value of a listed nominal aperture (relative 1e-5), else the nearest third stop."""
    a = c(n)
    stop = F.when((a > 0) & ~F.isnan(a), F.pow(F.lit(2.0), half_up(F.log2(a * a) * 3.0) / 6.0)).otherwise(F.lit(1.0))
    for nominal, measured in reversed(list(overrides)):
        near = F.abs(a - nominal) / F.lit(max(abs(nominal), 1e-6)) < 1e-5
        stop = F.when(near, F.lit(float(measured))).otherwise(stop)
    return stop


def shutter_curve(t: Num, k: Num) -> Column:
    """1/t' = (1/t)·exp(k/t)."""
    t = c(t)
    return F.when(t > 0, F.lit(1.0) / (F.lit(1.0) / t * F.exp(c(k) / t))).otherwise(t)


def effective_exposure(t: Num, iso: Num, aperture: Num, scale: Num = 1.0, nd: Num = 0.0) -> Column:
    n = c(aperture)
    return c(t) * c(iso) / (F.lit(100.0) * n * n * c(scale) * F.pow(F.lit(10.0), c(nd)))


def validate(frames: DataFrame, effective: bool = False) -> DataFrame:
    """One row per violated rule: all frames of a bracket share size, pattern and – unless exposures are effective – ISO and aperture."""
    rules = ["width", "height", "cfa"] + ([] if effective else ["iso", "aperture"])
    g = frames.groupBy("bracket_id").agg(*[(F.min(r) != F.max(r)).alias(r) for r in rules])
    return g.select("bracket_id", F.explode(F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in rules]), lambda v: v.isNotNull())).alias("rule"))


def measured_range(frames: DataFrame, calfac: Num, saturation_offset: Num, range_value: float = 0.0) -> DataFrame:
    """Measured luminance range per frame, and per bracket as a window."""
    top = (F.lit(1.0) - c(saturation_offset)) * c(calfac) / F.col("e")
    w = W.partitionBy("bracket_id")
    f = frames.withColumns({"range_max": top, "range_min": top * max(range_value, 0.005)})
    return f.withColumns({"bracket_min": F.min("range_min").over(w), "bracket_max": F.max("range_max").over(w)})


def exposure_map(frames: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replace nominal exposures by ``replacements(nominal, actual)``; a frame without an entry keeps NULL in ``actual``.

    Matching is relative to 1e-5: exposures are bucketed by their logarithm (five decimal digits) with both neighbour buckets probed.
    """
    width = math.log(1.0 + 2e-5)
    bucket = F.floor(F.log("nominal") / width)
    r = replacements.withColumn("_k", F.explode(F.sequence(bucket - 1, bucket + 1))).withColumnRenamed("nominal", "_from")
    f = frames.withColumn("_k", bucket)
    j = f.join(r, (f["_k"] == r["_k"]) & (F.abs(F.col("_from") - F.col("nominal")) / F.col("nominal") < 1e-5), "left")
    return j.select(*[f[n] for n in frames.columns], "actual")


# --- raw levels ---


def repair_white(frame_px: DataFrame, black: Num = "black", white: Num = "white") -> DataFrame:
    """White point per frame, raised where enough samples lie far above the declared range."""
    limit = F.least(F.lit(65535.0), c(black) + (c(white) - c(black)) * 2.0)
    g = frame_px.groupBy("bracket_id", "frame_id").agg(
        F.max("dn").alias("top"), F.count_if(F.col("dn") > limit).alias("n_above"), F.count("*").alias("n"),
        F.max(c(black)).alias("black"), F.max(c(white)).alias("white"),
    )
    rng = F.col("white") - F.col("black")
    raised = (
        (rng > 0) & (F.col("top") - F.col("black") > rng * 2) & (F.col("top") >= 32768)
        & (F.col("n_above") >= F.greatest(F.lit(64), F.floor(F.col("n") / 1e6)))
    )
    level = F.when(F.col("top") >= 65280, F.lit(65280.0)).otherwise(c("top").cast("double"))
    return g.withColumn("white_fixed", F.when(raised, F.greatest(F.col("white"), level)).otherwise(F.col("white")))


def normalise(dn: Column, black: Num, white: Num, to_black: Num, to_white: Num) -> Column:
    """Move a count from a frame's black/white to the common ones; integer arithmetic, saturation kept."""
    i = lambda v: c(v).cast("bigint") if not isinstance(v, int) else F.lit(v).cast("bigint")
    b, w, tb, tw = i(black), i(white), i(to_black), i(to_white)
    signal = F.greatest(F.lit(0).cast("bigint"), dn.cast("bigint") - b)
    src, dst = w - b, tw - tb
    bad = (src <= 0) | (dst <= 0) | (b < 0) | (tb < 0) | (w > 65535) | (tw > 65535)
    top = signal * dst + F.floor(src / 2)
    scaled = tb + (top - top % src) / src
    return (
        F.when(bad, F.raise_error(F.lit("invalid black/white range")).cast("bigint"))
        .when(signal >= src, tw).otherwise(scaled.cast("bigint")).cast("int")
    )


def level_warnings(frames: DataFrame, fixed_black: int = -1, tolerance: int = 4) -> DataFrame:
    """(bracket_id, kind, frame_id, detail): black off the fixed level, spread of black, any spread of white."""
    off = frames.filter((F.lit(fixed_black) >= 0) & (F.abs(F.col("black") - fixed_black) > tolerance)).select(
        "bracket_id", F.lit("black_off").alias("kind"), "frame_id", (F.col("black") - fixed_black).cast("int").alias("detail")
    )
    g = frames.groupBy("bracket_id").agg(
        (F.max("black") - F.min("black")).alias("db"), (F.max("white") - F.min("white")).alias("dw")
    )
    none = F.lit(None).cast("bigint").alias("frame_id")
    spread = g.filter(F.col("db") > tolerance).select("bracket_id", F.lit("black_spread").alias("kind"), none, F.col("db").cast("int").alias("detail"))
    white = g.filter(F.col("dw") != 0).select("bracket_id", F.lit("white_spread").alias("kind"), none, F.col("dw").cast("int").alias("detail"))
    return off.unionByName(spread).unionByName(white)


def cfa_colour(y: Num, x: Num, pattern: int = RGGB) -> Column:
    """Colour 0/1/2 at a pixel of a 2-bit packed pattern; the second green counts as green."""
    y, x = (F.col(v) if isinstance(v, str) else v for v in (y, x))
    n = ((y % 8) * 2 + x % 2) * 2
    e = F.lit(1)
    for shift in range(0, 32, 2):
        k = (pattern >> shift) & 3
        if k in (0, 2):
            e = F.when(n == shift, F.lit(k)).otherwise(e)
    return e


def shift_pattern(pattern: int, dy: int, dx: int) -> int:
    """Packed pattern seen from offset (dy, dx), as after a crop."""
    out = 0
    for y in range(8):
        for x in range(2):
            k = (pattern >> ((((y + dy) % 8) * 2 + (x + dx) % 2) * 2)) & 3
            out |= k << ((y * 2 + x) * 2)
    return out


def raw_multipliers(frame_px: DataFrame, multipliers: Sequence[float], black: float, white: float, pattern: int = RGGB) -> DataFrame:
    """Channel multipliers about black, relative to the lowest, clipped at white."""
    low = min(multipliers)
    if not low > 0:
        raise ValueError("raw multipliers must be positive")
    k = cfa_colour("y", "x", pattern)
    f = F.when(k == 0, F.lit(multipliers[0] / low)).when(k == 2, F.lit(multipliers[2] / low)).otherwise(F.lit(multipliers[1] / low))
    v = F.least(F.lit(float(white)), F.greatest(F.lit(0.0), F.lit(float(black)) + (c("dn") - float(black)) * f))
    return frame_px.withColumn("dn", F.when(f == 1.0, c("dn")).otherwise(F.floor(v + 0.5).cast("double")))


def saturation_level(frame_px: DataFrame, black: float, white: float) -> DataFrame:
    """Saturation per bracket: 99.9 % order statistic of its longest frame as a fraction of the range."""
    longest = frame_px.groupBy("bracket_id").agg(F.max("e").alias("_e"))
    f = frame_px.join(longest, "bracket_id").filter(F.col("e") == F.col("_e")).select("bracket_id", c("dn").cast("double").alias("dn"))
    p = R.percentiles(f, ["bracket_id"], "dn", {"level": ("nth", 0.999)})
    return p.select("bracket_id", ((F.col("level") - black) / (white - black)).alias("saturation"))


# --- weights and merging ---


def pixel_weight(scaled: Column) -> Column:
    """β·exp(−0.1(1/s + 1/(1−s))) with β = e^0.4; 0 outside (0, 1). ``scaled`` is relative to saturation."""
    ok = (scaled > 0) & (scaled < 1)
    s = F.when(ok, scaled)
    return F.coalesce(F.lit(math.exp(0.4)) * F.exp((F.lit(1.0) / s + F.lit(1.0) / (F.lit(1.0) - s)) * -0.1), F.lit(0.0))


def neighbourhood_weight(s: Column, limit: float) -> Column:
    """exp(−.01/s − .01/(limit − s)) + 1e-6 inside [0, limit]; ``limit`` is the saturation fraction."""
    ok = (s >= 0) & (s <= limit)
    a = F.when(s > 0, F.exp(F.lit(-0.01) / F.nullif(s, F.lit(0.0)) - F.lit(0.01) / F.nullif(F.lit(limit) - s, F.lit(0.0)))).otherwise(F.lit(0.0))
    return F.when(ok, F.coalesce(a, F.lit(0.0)) + 1e-6).otherwise(F.lit(0.0))


def _white(colour: Column, white_saturation: Sequence[float]) -> Column:
    r, g, b = (F.lit(float(v)) for v in white_saturation)
    return F.when(colour == 0, r).when(colour == 2, b).otherwise(g)


def merge(
    frame_px: DataFrame, black: float, white: float, saturation: float = 1.0, underexposed: float = 0.0,
    white_saturation: Sequence[float] = (1.0, 1.0, 1.0), pattern: int = RGGB,
) -> DataFrame:
    """Merged radiance per pixel, pixel weighting.

    Pass 1 weighs samples by their own count, pass 2 by the count predicted from pass 1. Both passes see all frames of a
    pixel: window sums and the final aggregate share one exchange on (bracket, y, x).
    """
    rng = white - black
    w = W.partitionBy(*PX)

    def weight(dn: Column) -> Column:
        return pixel_weight((dn - black) / (saturation * rng))

    f = frame_px.select(*PX, c("e").alias("e"), c("dn").cast("double").alias("dn"))
    f = f.withColumns({"s": (F.col("dn") - black) / rng, "w1": weight(F.col("dn"))})
    top = F.least(F.col("s"), _white(cfa_colour("y", "x", pattern), white_saturation)) / F.col("e")
    f = f.withColumns({
        "_sw": F.sum(F.col("s") * F.col("w1")).over(w), "_ew": F.sum(F.col("e") * F.col("w1")).over(w), "_ss": F.sum("s").over(w),
        "high": F.greatest(F.lit(0.0), F.max(top).over(w)), "low": F.min(F.col("s") / F.col("e")).over(w),
        "under": F.bool_and(F.col("s") < underexposed).over(w), "over": F.bool_and(F.col("s") >= saturation).over(w),
    })
    first = (
        F.when(F.col("_ew") > 0, F.col("_sw") / F.nullif(F.col("_ew"), F.lit(0.0))).when(F.col("under"), F.col("low"))
        .when(F.col("over"), F.col("high")).otherwise(F.col("_ss"))
    )
    f = f.withColumn("ref", first).withColumn("pred", F.col("ref") * F.col("e") * rng + black)
    f = f.withColumn("w2", F.when((F.col("pred") > 0) & (F.col("pred") < 65535.0), weight(F.floor(F.col("pred") + 0.5).cast("double"))).otherwise(F.lit(0.0)))
    g = f.groupBy(*PX).agg(
        F.sum(F.col("s") * F.col("w2")).alias("_sw"), F.sum(F.col("e") * F.col("w2")).alias("_ew"),
        *[F.first(k).alias(k) for k in ("low", "high", "under", "over", "ref")],
    )
    value = (
        F.when(F.col("_ew") > 0, F.col("_sw") / F.nullif(F.col("_ew"), F.lit(0.0))).when(F.col("under"), F.col("low"))
        .when(F.col("over"), F.col("high")).otherwise(F.col("ref"))
    )
    return g.select(*PX, value.alias("value"))


def merge_neighbourhood(
    frame_px: DataFrame, black: float, white: float, saturation: float, underexposed: float = 0.0,
    white_saturation: Sequence[float] = (1.0, 1.0, 1.0), pattern: int = RGGB,
) -> DataFrame:
    """Merged radiance per pixel; the 5 × 5 maximum and minimum decide saturation and weight.

    Tiles of all frames of a bracket are shuffled together once; row and column windows and the merge itself reuse
    that partitioning.
    """
    k = cfa_colour("y", "x", pattern)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("dn") - black) / (white - black)))
    f = frame_px.select(*PX, "frame_id", "width", "height", c("e").alias("e"), s.alias("s"), k.alias("k"))
    t = tiles(f, (2, 2), ("bracket_id",))
    keys = ("bracket_id", "frame_id")
    rw, cw = row_window((2, 2), keys), column_window((2, 2), keys)
    t = t.withColumns({f"_m{i}": F.max(F.when(F.col("k") == i, F.col("s"))).over(rw) for i in range(3)} | {"_lo": F.min("s").over(rw)})
    t = t.withColumns({f"m{i}": F.coalesce(F.max(f"_m{i}").over(cw), F.lit(0.0)) for i in range(3)} | {"lo": F.min("_lo").over(cw)})
    t = t.withColumns({"_by": F.col("_ty"), "_bx": F.col("_tx")})
    t = core(t).withColumn("top", F.greatest("m0", "m1", "m2"))
    t = t.withColumns({"over1": F.col("top") >= saturation, "under1": F.col("s") < underexposed})
    weight = F.least(neighbourhood_weight(F.col("top"), min(1.0, saturation)), neighbourhood_weight(F.col("lo"), min(1.0, saturation)))
    t = t.withColumn("wt", F.when(F.col("over1") | F.col("under1"), F.lit(0.0)).otherwise(weight))
    g = t.groupBy("bracket_id", "_by", "_bx", "y", "x").agg(
        F.sum(F.col("s") * F.col("wt")).alias("_sw"), F.sum(F.col("e") * F.col("wt")).alias("_ew"),
        F.max(F.least(F.col("s"), _white(F.col("k"), white_saturation)) / F.col("e")).alias("high"),
        F.min(F.col("s") / F.col("e")).alias("low"), F.bool_and("under1").alias("under"), F.bool_and("over1").alias("over"),
    )
    value = (
        F.when(F.col("under"), F.col("low")).when(F.col("over"), F.col("high"))
        .when(F.col("_ew") > 0, F.col("_sw") / F.nullif(F.col("_ew"), F.lit(0.0))).otherwise(F.col("high"))
    )
    return g.select(*PX, value.alias("value"))


def single_frame(frame_px: DataFrame, black: float, white: float) -> DataFrame:
    """Calibrated value of one-frame brackets: s / e."""
    return frame_px.withColumn("value", (c("dn") - black) / (white - black) / c("e"))


def merge_rgb(
    frame_rgb: DataFrame, saturation: float, underexposed: float, matrix: Sequence[float],
    white_saturation: Sequence[float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """Merge frames that already hold RGB: the worst channel weighs all three and is also tested after the colour matrix."""
    lim = min(1.0, saturation)
    f = frame_rgb.withColumns({ch: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(ch))) for ch in "rgb"})
    f = f.withColumns({f"_o{i}": F.greatest(F.lit(0.0), v) for i, v in enumerate(mat_vec(matrix, ["r", "g", "b"]))})
    f = f.withColumns({"_hi": F.greatest("r", "g", "b"), "_lo": F.least("r", "g", "b")})
    f = f.withColumns({
        "over1": (F.col("_hi") >= lim) | (F.greatest("_o0", "_o1", "_o2") >= lim),
        "under1": (F.col("_lo") < underexposed) | (F.least("_o0", "_o1", "_o2") < underexposed),
    })
    # in-range samples lie strictly inside the limits, so the range test of the weight never applies
    wt = F.least(neighbourhood_weight(F.col("_hi"), lim), neighbourhood_weight(F.col("_lo"), lim))
    f = f.withColumn("wt", F.when(F.col("over1") | F.col("under1"), F.lit(0.0)).otherwise(wt))
    aggs = [F.sum(F.col("wt") * F.col("e")).alias("_ew"), F.bool_and("under1").alias("under"), F.bool_and("over1").alias("over")]
    for ch, ws in zip("rgb", white_saturation):
        aggs += [
            F.sum(F.col("wt") * F.col(ch)).alias(f"_s{ch}"), F.min(F.col(ch) / F.col("e")).alias(f"_l{ch}"),
            F.max(F.least(F.col(ch), F.lit(float(ws))) / F.col("e")).alias(f"_h{ch}"),
        ]
    g = f.groupBy(*PX).agg(*aggs)
    return g.select(*PX, *[
        F.when(F.col("under"), F.col(f"_l{ch}")).when(F.col("over") | (F.col("_ew") == 0), F.col(f"_h{ch}"))
        .otherwise(F.col(f"_s{ch}") / F.nullif(F.col("_ew"), F.lit(0.0))).alias(ch)
        for ch in "rgb"
    ])


def channel_samples(frame_px: DataFrame, black: float, white: float, saturation: float, underexposed: float, pattern: int = RGGB) -> DataFrame:
    """Mean in-range radiance and in-range share per frame and colour."""
    f = frame_px.withColumns({"s": (c("dn") - black) / (white - black), "colour": cfa_colour("y", "x", pattern)})
    ok = (F.col("s") >= underexposed) & (F.col("s") < saturation) & (F.col("e") > 0)
    return f.groupBy("bracket_id", "frame_id", "colour").agg(
        F.avg(F.when(ok, F.col("s") / F.col("e"))).alias("mean"), (F.count_if(ok) / F.count("*")).alias("share"), F.count("*").alias("n")
    )


# --- mosaic ---


#: Most rows of a bad-pixel table that are sent to every executor (some 10 MB); longer ones Spark joins like any other table.
BAD_ROWS = 200_000


def repair_bad_pixels(frame_px: DataFrame, bad: DataFrame, pattern: int = RGGB, by: Sequence[str] = ()) -> DataFrame:
    """Replace listed pixels ``bad(by, y, x)`` by the middle of their same-colour good neighbours in 5 × 5, widened to 9 × 9 below three.

    The list holds for all frames or for those whose columns ``by``, such as the camera, are equal. Only listed pixels and their at most 80 neighbours leave their
    place; all others pass as they are read, without an exchange.
    """
    by = list(by)
    at = [*by, "y", "x"]
    bad = cut_lineage(bad.select(*at).distinct())
    listed = bad.count()
    sent = lambda df, rows: F.broadcast(df) if rows <= BAD_ROWS else df
    around = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-4, 5) for dx in range(-4, 5) if (dy, dx) != (0, 0)]
    near = bad.select(*by, F.col("y").alias("ty"), F.col("x").alias("tx"), F.inline(F.array(*around)))
    near = near.select(*by, "ty", "tx", (F.col("ty") + F.col("dy")).alias("y"), (F.col("tx") + F.col("dx")).alias("x"), F.greatest(F.abs("dy"), F.abs("dx")).alias("d"))
    near = near.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (cfa_colour("y", "x", pattern) == cfa_colour("ty", "tx", pattern)))
    near = near.join(bad, at, "left_anti")
    s = frame_px.select("bracket_id", "frame_id", *at, "dn").join(sent(near, listed * 24), at)
    s = s.groupBy("bracket_id", "frame_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(
        F.sort_array(F.collect_list(F.when(F.col("d") <= 2, F.col("dn")))).alias("_a"), F.sort_array(F.collect_list("dn")).alias("_b")
    )
    pick = F.when(F.size("_a") >= 3, F.col("_a")).otherwise(F.col("_b"))
    s = s.withColumn("_p", pick).withColumn("_fix", F.get("_p", F.floor(F.size("_p") / 2).cast("int"))).drop("_a", "_b", "_p")
    good, faulty = (frame_px.join(sent(bad, listed), at, how) for how in ("left_anti", "left_semi"))
    mended = faulty.join(s, ["bracket_id", "frame_id", "y", "x"], "left").withColumn("dn", F.coalesce("_fix", "dn"))
    return good.select(*frame_px.columns).unionByName(mended.select(*frame_px.columns))


def interpolate_colours(merged: DataFrame, pattern: int = RGGB) -> DataFrame:
    """r, g, b of a mosaic: own colour kept, the others the mean of the same colour in 3 × 3 (1 where there is none)."""
    f = merged.withColumn("k", cfa_colour("y", "x", pattern))
    t = tiles(f, (1, 1), ("bracket_id",))
    rw, cw = row_window((1, 1), ("bracket_id",)), column_window((1, 1), ("bracket_id",))
    own = [F.when(F.col("k") == i, F.col("value")) for i in range(3)]
    t = t.withColumns({f"_s{i}": F.sum(own[i]).over(rw) for i in range(3)} | {f"_n{i}": F.count(own[i]).over(rw) for i in range(3)})
    t = t.withColumns({f"s{i}": F.sum(f"_s{i}").over(cw) for i in range(3)} | {f"n{i}": F.sum(f"_n{i}").over(cw) for i in range(3)})
    t = core(t)
    return t.select(*PX, *[
        F.when(F.col("k") == i, F.col("value")).when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).otherwise(F.lit(1.0)).alias(ch)
        for i, ch in enumerate("rgb")
    ])


def sparse_grid(merged: DataFrame, pattern: int = RGGB) -> DataFrame:
    """One channel per pixel, the others 0."""
    k = cfa_colour("y", "x", pattern)
    return merged.select(*PX, *[F.when(k == i, F.col("value")).otherwise(F.lit(0.0)).alias(ch) for i, ch in enumerate("rgb")])


# --- exposure fit ---


def patches(frame_px: DataFrame, black: float, white: float, saturation: float, size: int = 20, colour: int = 1, pattern: int = RGGB) -> DataFrame:
    """Uniform-patch statistics on a grid: (bracket, frame, py, px, lo, hi, mean, rel_std, good) of one colour."""
    s = (c("dn") - black) / (white - black)
    f = frame_px.filter(cfa_colour("y", "x", pattern) == colour).withColumns({
        "s": s, "py": F.floor(F.col("y") / size).cast("int"), "px": F.floor(F.col("x") / size).cast("int")
    })
    g = f.groupBy("bracket_id", "frame_id", "e", "py", "px").agg(
        F.min("s").alias("lo"), F.max("s").alias("hi"), F.avg("s").alias("mean"), (F.stddev_samp("s") / F.abs(F.avg("s"))).alias("rel_std")
    )
    # Limits of a usable patch.
    return g.withColumn("good", (F.col("lo") > 0.01) & (F.col("hi") < saturation - 0.05) & (F.col("rel_std") < 0.1))


def fit_exposures(good: DataFrame) -> DataFrame:
    """Exposures from log2(mean) = exposure + patch; the longest frame keeps its nominal exposure.

    Patch effects are eliminated per patch: its frames (a handful) add to a frames × frames system, summed on Spark; only
    that small system per bracket is solved in Python.
    """
    v = good.withColumn("b", F.log2("mean"))
    # Fixed-size groups: a patch has one row per frame of its bracket.
    p = v.groupBy("bracket_id", "py", "px").agg(F.collect_list(F.struct("frame_id", "e", "b")).alias("m"))
    n = F.size("m").cast("double")
    p = p.select("bracket_id", n.alias("n"), F.aggregate("m", F.lit(0.0), lambda a, r: a + r["b"]).alias("sb"), "m", F.explode("m").alias("i"))
    p = p.select("bracket_id", "n", "sb", "i", F.explode("m").alias("j"))
    same = F.col("i.frame_id") == F.col("j.frame_id")
    sys = p.groupBy("bracket_id", F.col("i.frame_id").alias("i"), F.col("j.frame_id").alias("j"), F.col("i.e").alias("e")).agg(
        F.sum(F.when(same, F.lit(1.0)).otherwise(F.lit(0.0)) - F.lit(1.0) / F.col("n")).alias("a"),
        F.sum(F.when(same, F.col("i.b") - F.col("sb") / F.col("n")).otherwise(F.lit(0.0))).alias("r"),
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["i"].unique())
        at = {k: n for n, k in enumerate(ids)}
        m, rhs, e = np.zeros((len(ids), len(ids))), np.zeros(len(ids)), np.zeros(len(ids))
        for row in pdf.itertuples():
            m[at[row.i], at[row.j]] += row.a
            rhs[at[row.i]] += row.r
            e[at[row.i]] = row.e
        x = np.linalg.lstsq(m, rhs, rcond=None)[0]
        longest = int(np.argmax(e))
        fitted = 2.0 ** (x - x[longest]) * e[longest]
        return pd.DataFrame({"bracket_id": pdf["bracket_id"].iloc[0], "frame_id": ids, "nominal": e, "fitted": fitted})

    return sys.groupBy("bracket_id").applyInPandas(solve, "bracket_id bigint, frame_id int, nominal double, fitted double")
