"""Calibration: shutter chains, chart cells, colour fits and their errors. Fits work on aggregated sums, never on raw pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lumenfield.functions import colour as C
from lumenfield.functions.numeric import c, mat_inverse, mat_mul, mat_vec, segment
from lumenfield.operators import ranking as R
from lumenfield.operators.stats import scale_fit

# --- shutter and aperture ---


def shutter_means(samples: DataFrame, keys: Sequence[str] = ("camera", "seq"), key: str = "shutter_key") -> DataFrame:
    """Frames more than 99 % in range, averaged per shutter key."""
    return samples.filter("share > 0.99").groupBy(*keys, key).agg(F.avg("mean").alias("value"), F.max("shutter").alias("shutter"))


def chain(means: DataFrame, keys: Sequence[str] = ("camera",), seq: str = "seq", key: str = "shutter_key") -> DataFrame:
    """Scale each sequence to the running merge by the mean ratio over shared shutters; later sequences overwrite.

    Sequences are taken in order of their smallest shutter. Input is one row per (sequence, shutter): a few dozen per
    camera, so the ordered fold is a small task per camera. A sequence that shares no shutter with the merge gives NULL.
    """
    keys = list(keys)
    ddl = ", ".join(f"{k} {means.schema[k].dataType.simpleString()}" for k in keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        merged: dict = {}
        order = pdf.groupby(seq)["shutter"].min().sort_values(kind="stable").index
        for n, s in enumerate(order):
            part = pdf[pdf[seq] == s].sort_values("shutter")
            ratio = [merged[k][1] / v for k, v in zip(part[key], part["value"]) if k in merged and v > 0 and not math.isnan(merged[k][1])]
            scale = 1.0 if n == 0 else (sum(ratio) / len(ratio) if ratio else float("nan"))
            for k, v, t in zip(part[key], part["value"], part["shutter"]):
                merged[k] = (t, v * scale)
        rows = sorted((t, k, v) for k, (t, v) in merged.items())
        base = rows[0][2]
        out = {k: [pdf[k].iloc[0]] * len(rows) for k in keys}
        return pd.DataFrame({**out, key: [r[1] for r in rows], "shutter": [r[0] for r in rows], "relative": [r[2] / base for r in rows]})

    return means.groupBy(*keys).applyInPandas(fold, f"{ddl}, {key} {means.schema[key].dataType.simpleString()}, shutter double, relative double")


def fit_shutter(chained: DataFrame, keys: Sequence[str] = ("camera",)) -> DataFrame:
    """1/relative = B·exp(A·shutter): slope and intercept of the logarithm."""
    y = -F.log("relative")
    return chained.filter("relative > 0").groupBy(*keys).agg(
        F.regr_slope(y, F.col("shutter")).alias("a"), F.exp(F.regr_intercept(y, F.col("shutter"))).alias("b")
    )


def aperture_correction(sequences: DataFrame, keys: Sequence[str] = ("camera",), order: str = "seq") -> DataFrame:
    """√(N²·ref/mean) per sequence, the first sequence of a camera being the reference."""
    ref = F.first("mean").over(W.partitionBy(*keys).orderBy(order))
    n = F.col("aperture")
    return sequences.withColumn("corrected", F.sqrt(n * n * ref / F.col("mean")))


# --- chart cells ---


def sample_cells(pixels: DataFrame, cells: DataFrame, scale: float = 1.0, keys: Sequence[str] = ("image_id",), by: Sequence[str] = ()) -> DataFrame:
    """Mean RGB per chart cell. ``cells(by, cell_id, x, y, w, h)`` hold for all pictures or for those whose columns ``by``, such as the camera, are equal.

    Cells are expanded to the rows they cover, which turns the range join into an equi-join on ``by`` and row plus a comparison.
    """
    rows = cells.withColumn("y", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1))).select(*by, "cell_id", "y", F.col("x").alias("_x"), F.col("w").alias("_w"))
    hit = pixels.select(*dict.fromkeys([*keys, *by, "y", "x", *C.RGB])).join(rows, [*by, "y"]).filter((F.col("x") >= F.col("_x")) & (F.col("x") < F.col("_x") + F.col("_w")))
    return hit.groupBy(*dict.fromkeys([*keys, *by]), "cell_id").agg(*[(F.avg(ch) * scale).alias(ch) for ch in C.RGB], F.count("*").alias("n_px"))


def luminance_fit(pairs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Scale of measured ``y`` onto ``ref`` and the relative RMS before and after."""
    keys = list(keys)
    f = pairs.groupBy(*keys).agg(scale_fit(F.col("ref"), F.col("y")).alias("scale"))
    j = pairs.join(f, keys)
    rel = lambda v: F.sqrt(F.avg((v - F.col("ref")) / F.col("ref") * ((v - F.col("ref")) / F.col("ref"))))
    return j.groupBy(*keys).agg(F.max("scale").alias("scale"), rel(F.col("y")).alias("rms_before"), rel(F.col("y") * F.col("scale")).alias("rms_after"))


def channel_scales(pairs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return pairs.groupBy(*keys).agg(*[scale_fit(F.col(f"ref_{ch}"), F.col(ch)).alias(f"scale_{ch}") for ch in C.RGB])


def fit_matrix(pairs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """3 × 3 matrix M minimising |ref − M·rgb|², from 15 moment sums per group: A·Bᵀ·(B·Bᵀ)⁻¹."""
    ref = [F.col(f"ref_{ch}") for ch in C.RGB]
    rgb = [F.col(ch) for ch in C.RGB]
    g = pairs.groupBy(*keys).agg(
        *[F.sum(ref[i] * rgb[j]).alias(f"_a{3 * i + j}") for i in range(3) for j in range(3)],
        *[F.sum(rgb[i] * rgb[j]).alias(f"_b{3 * i + j}") for i in range(3) for j in range(3)],
    )
    g = g.withColumns({f"_i{n}": v for n, v in enumerate(mat_inverse([f"_b{n}" for n in range(9)]))})
    m = mat_mul([f"_a{n}" for n in range(9)], [f"_i{n}" for n in range(9)])
    return g.select(*keys, *[v.alias(f"m{n}") for n, v in enumerate(m)])


def colour_errors(pairs: DataFrame, keys: Sequence[str] = ("image_id",), first: str = "cell_id") -> DataFrame:
    """RMS errors u'v', Yu'v', Lab/2.3, xy and mean relative luminance of XYZ ``x, y, z`` against ``ref_x, ref_y, ref_z``.

    The white point of Lab is the brighter of the two first cells.
    """
    keys = list(keys)
    xyz, ref = ["x", "y", "z"], ["ref_x", "ref_y", "ref_z"]
    w = pairs.groupBy(*keys).agg(F.min_by(F.struct(*xyz, *ref), first).alias("_f"))
    w = w.select(*keys, *[F.when(F.col("_f.ref_y") > F.col("_f.y"), F.col(f"_f.{r}")).otherwise(F.col(f"_f.{t}")).alias(f"_w{i}") for i, (t, r) in enumerate(zip(xyz, ref))])
    d = pairs.join(w, keys)
    white = ["_w0", "_w1", "_w2"]
    parts = {}
    for p, v in (("t", xyz), ("r", ref)):
        xy, yuv, lab = C.xyz_to_xy(v), C.xyz_to_yuv(v), C.xyz_to_lab(v, white)
        parts.update({f"_{p}x": xy[0], f"_{p}y": xy[1], f"_{p}u": yuv[1], f"_{p}v": yuv[2], f"_{p}l": lab[0], f"_{p}a": lab[1], f"_{p}b": lab[2]})
    d = d.withColumns(parts)
    sq = lambda k: (F.col(f"_t{k}") - F.col(f"_r{k}")) * (F.col(f"_t{k}") - F.col(f"_r{k}"))
    dl = (F.col("y") - F.col("ref_y")) / F.col("ref_y")
    return d.groupBy(*keys).agg(
        F.sqrt(F.avg(sq("u") + sq("v"))).alias("d_uv"), F.sqrt(F.avg(dl * dl + sq("u") + sq("v")) / 2.0).alias("d_yuv"),
        (F.sqrt(F.avg(sq("l") + sq("a") + sq("b"))) / 2.3).alias("d_lab"), F.sqrt(F.avg(sq("x") + sq("y")) / 2.0).alias("d_xy"), F.avg(dl).alias("d_lum"),
    )


def candidate_table(pairs: DataFrame, start: Sequence[float], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """All candidate matrices with all their errors: start, luminance-scaled, channel-scaled and least squares.

    ``pairs(keys, cell_id, r, g, b, ref_x, ref_y, ref_z)``; ``start`` maps rgb to XYZ.
    """
    keys = list(keys)
    base = pairs.withColumns(dict(zip(("x", "y", "z"), mat_vec(start, list(C.RGB)))))
    lum = base.groupBy(*keys).agg(scale_fit(F.col("ref_y"), F.col("y")).alias("_k"), *[scale_fit(F.col(f"ref_{v}"), F.col(v)).alias(f"_k{v}") for v in "xyz"])
    opt = fit_matrix(pairs.withColumns({f"ref_{ch}": F.col(f"ref_{v}") for ch, v in zip("rgb", "xyz")}), keys)
    j = base.join(lum, keys).join(opt, keys)
    fitted = mat_vec([f"m{n}" for n in range(9)], list(C.RGB))
    kinds = [
        ("start", [F.col(v) for v in "xyz"]), ("lum", [F.col(v) * F.col("_k") for v in "xyz"]),
        ("channel", [F.col(v) * F.col(f"_k{v}") for v in "xyz"]), ("matrix", fitted),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("candidate"), *[e.alias(f"_{v}") for e, v in zip(vs, "xyz")]) for n, vs in kinds])
    e = j.select(*keys, "cell_id", "ref_x", "ref_y", "ref_z", F.inline(rows))
    e = e.select(*keys, "candidate", "cell_id", "ref_x", "ref_y", "ref_z", *[F.col(f"_{v}").alias(v) for v in "xyz"])
    return colour_errors(e, [*keys, "candidate"])


def chart_profile(pixels: DataFrame, axis: str, keys: Sequence[str] = ("image_id",), value: str = "lum") -> DataFrame:
    """Mean along one axis of a chart picture: (keys, pos, mean)."""
    return pixels.groupBy(*keys, F.col(axis).alias("pos")).agg(F.avg(value).alias("mean"))


def dark_bands(profile: DataFrame, expected: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Dark bands of a profile (keys, pos, mean): candidates (begin, end, level, score) after dropping overlaps over 60 %.

    Runs below each of 20 thresholds between the 5th and 35th percentile of the smoothed profile are found as gaps and
    islands; the score adds darkness, contrast to both sides and width. A profile is one picture line long.
    """
    keys = list(keys)
    n = F.count("*").over(W.partitionBy(*keys))
    p = profile.withColumn("n", n)
    # window width depends on the profile length, so neighbours are summed by prefix differences
    w = W.partitionBy(*keys).orderBy("pos")
    p = p.withColumns({"i": F.row_number().over(w) - 1, "_c": F.sum("mean").over(w)})
    rad = F.greatest(F.lit(2), F.floor(F.col("n") / 80).cast("int"))
    line = p.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "_c", "pos"))).alias("s"))
    line = line.withColumn("r", rad).withColumn("cum", F.concat(F.array(F.lit(0.0)), F.transform("s", lambda e: e["_c"])))
    lo = lambda i: F.greatest(F.lit(0), i - F.col("r"))
    hi = lambda i: F.least(F.col("n").cast("int") - 1, i + F.col("r"))
    smooth = F.transform("s", lambda e: (F.get("cum", hi(e["i"]) + 1) - F.get("cum", lo(e["i"]))) / (hi(e["i"]) - lo(e["i"]) + 1))
    rows = line.select(*keys, "n", F.posexplode(smooth).alias("i", "v"))
    # running sums by a window, then one array per line
    sums = rows.withColumn("_s", F.sum("v").over(W.partitionBy(*keys).orderBy("i"))).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "_s"))).alias("s"))
    sums = sums.select(*keys, F.concat(F.array(F.lit(0.0)), F.transform("s", lambda e: e["_s"])).alias("sum"))
    q = R.percentiles(rows, keys, "v", {"p05": ("lower", 0.05), "p35": ("lower", 0.35), "p50": ("lower", 0.5)}).drop("n")
    mixes = F.array(*[F.lit(k) for k in range(20)])
    t = rows.join(q, keys).withColumn("mix", F.explode(mixes))
    t = t.filter(F.col("v") <= F.col("p05") + (F.col("p35") - F.col("p05")) * F.col("mix") * 0.05)
    grp = F.col("i") - F.row_number().over(W.partitionBy(*keys, "mix").orderBy("i"))
    runs = t.withColumn("_g", grp).groupBy(*keys, "mix", "_g").agg(
        F.min("i").alias("begin"), F.max("i").alias("end"), F.avg("v").alias("level"), F.max("n").alias("n"), F.max("p50").alias("p50")
    )
    width = F.col("end") - F.col("begin") + 1
    least = F.greatest(F.lit(2), F.floor(F.col("n") / 250))
    most = F.greatest(least + 1, F.floor(F.col("n") / max(3, expected)))
    runs = runs.withColumn("width", width).filter((width >= least) & (width <= most))
    runs = runs.join(sums, keys)
    reach = F.greatest(F.lit(3), F.col("width") * 2)
    lb, re = F.greatest(F.lit(0), F.col("begin") - reach), F.least(F.col("n").cast("int") - 1, F.col("end") + reach)

    def mean(a: Column, b: Column) -> Column:
        return F.when(b >= a, (F.get("sum", (b + 1).cast("int")) - F.get("sum", a.cast("int"))) / (b - a + 1)).otherwise(F.lit(0.0))

    runs = runs.withColumns({"_in": mean(F.col("begin"), F.col("end")), "_l": mean(lb, F.col("begin") - 1), "_r": mean(F.col("end") + 1, re)})
    contrast = F.greatest(F.lit(0.0), F.when(F.col("begin") == 0, F.col("_r")).when(F.col("end") == F.col("n") - 1, F.col("_l")).otherwise((F.col("_l") + F.col("_r")) * 0.5) - F.col("_in"))
    score = F.greatest(F.lit(0.0), F.col("p50") - F.col("level")) + contrast * 0.5 + F.col("width") * 0.15
    runs = runs.select(*keys, F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "level", score.alias("score"))
    # greedy choice by score; at most 20 runs per dark place of one profile
    best = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "begin", "end", "level", "score"))).alias("c"))

    def clash(a: Column, b: Column) -> Column:
        over = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["begin"], b["begin"]) + 1)
        return over > F.least(a["end"] - a["begin"] + 1, b["end"] - b["begin"] + 1) * 0.6

    empty = F.slice("c", 1, 0)
    kept = F.aggregate("c", empty, lambda acc, e: F.when(F.exists(acc, lambda k: clash(e, k)), acc).otherwise(F.concat(acc, F.array(e))))
    return best.select(*keys, F.inline(F.transform(kept, lambda e: F.struct(e["begin"].alias("begin"), e["end"].alias("end"), e["level"].alias("level"), e["score"].alias("score")))))


def white_score(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Luminance less 0.35 × chroma × largest channel."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    y = F.lit(0.265) * F.col(r) + F.lit(0.670) * F.col(g) + F.lit(0.065) * F.col(b)
    return F.when(top > 0, y - (top - low) / top * top * 0.35)


def grey_strip_scores(cells: DataFrame, keys: Sequence[str] = ("image_id",), line: str = "row", order: str = "col") -> DataFrame:
    """Score of each line of cells: 0.55 greyness + 0.25 monotony + 0.20 spread; 0 for fewer than three cells."""
    top, low = F.greatest(*C.RGB), F.least(*C.RGB)
    d = cells.withColumns({
        "_y": F.lit(0.265) * F.col("r") + F.lit(0.670) * F.col("g") + F.lit(0.065) * F.col("b"),
        "_c": F.when(top > 0, (top - low) / top).otherwise(F.lit(1.0)),
    })
    d = d.withColumn("_d", F.col("_y") - F.lag("_y").over(W.partitionBy(*keys, line).orderBy(order)))
    g = d.groupBy(*keys, line).agg(
        F.count("*").alias("n"), F.avg("_c").alias("_c"), F.max("_y").alias("_hi"), F.min("_y").alias("_lo"),
        F.coalesce(F.sum(F.greatest(F.lit(0.0), -F.col("_d"))), F.lit(0.0)).alias("_down"), F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("_d"))), F.lit(0.0)).alias("_up"),
    )
    rng = F.greatest(F.lit(1e-8), F.col("_hi") - F.col("_lo"))
    mono = F.greatest(F.lit(0.0), F.lit(1.0) - F.least("_down", "_up") / (rng * (F.col("n") - 1) + 1e-8))
    spread = F.when(F.col("_hi") > 0, F.greatest(F.lit(0.0), (F.col("_hi") - F.col("_lo")) / F.col("_hi"))).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_c")) * 0.55 + mono * 0.25 + spread * 0.20
    return g.select(*keys, line, F.when(F.col("n") >= 3, score).otherwise(F.lit(0.0)).alias("score"))


def grid_dimensions(charts: DataFrame, width: str = "width", height: str = "height", patches: str = "patches") -> DataFrame:
    """Add ``cols`` and ``rows``: the factorisation of the patch count closest to the picture's aspect ratio, wide preferred."""
    n = F.col(patches)
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda r: n % r == 0), lambda r: F.struct((n / r).cast("int").alias("cols"), r.cast("int").alias("rows")))
    aspect = c(width) / F.greatest(F.lit(1.0), c(height))

    def score(p: Column) -> Column:
        s = F.abs(F.log(p["cols"] / p["rows"] / aspect)) + F.abs(p["cols"] - p["rows"]) * 0.03
        return s + F.when(p["cols"] < p["rows"], F.lit(0.25)).otherwise(F.lit(0.0))

    best = F.array_min(F.transform(pairs, lambda p: F.struct(score(p).alias("s"), p["rows"].alias("rows"), p["cols"].alias("cols"))))
    d = charts.withColumn("_g", F.when(n > 0, best))
    return d.withColumns({"cols": F.coalesce("_g.cols", F.lit(6)), "rows": F.coalesce("_g.rows", F.lit(4))}).drop("_g")


# --- spectra ---


def _knots(curve: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per curve of two knots at least: ``_knots``, its sorted (nm, v, m) with the slopes of monotone cubics from lag/lead windows."""
    w = W.partitionBy(*by).orderBy("nm")
    d = curve.withColumns({"_x1": F.lead("nm").over(w), "_y1": F.lead(value).over(w), "_x0": F.lag("nm").over(w), "_y0": F.lag(value).over(w)})
    d = d.withColumns({"_h": F.col("_x1") - F.col("nm"), "_hp": F.col("nm") - F.col("_x0")})
    d = d.withColumns({"_d": (F.col("_y1") - F.col(value)) / F.col("_h"), "_dp": (F.col(value) - F.col("_y0")) / F.col("_hp")})
    w1, w2 = F.col("_h") * 2.0 + F.col("_hp"), F.col("_h") + F.col("_hp") * 2.0
    mid = F.when(F.col("_d") * F.col("_dp") <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / F.nullif("_dp", F.lit(0.0)) + w2 / F.nullif("_d", F.lit(0.0))))
    slope = F.when(F.col("_x0").isNull(), F.col("_d")).when(F.col("_x1").isNull(), F.col("_dp")).otherwise(mid)
    return d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("nm", F.col(value).alias("v"), slope.alias("m")))).alias("_knots")).where(F.size("_knots") > 1)


def resample_curve(curve: DataFrame, grid: DataFrame, by: Sequence[str] = (), value: str = "v1") -> DataFrame:
    """Monotone cubic (PCHIP) resampling of ``curve(by, nm, value)`` onto ``grid(nm)``; grid points outside a curve are left out.

    Each curve is one row with its sorted knots, in which every grid point searches its interval. The grid, a list of wavelengths, is one row too.
    """
    by = list(by)
    knots = _knots(curve, by, value)
    points = grid.where("nm is not null").agg(F.array_sort(F.collect_set("nm")).alias("_grid"))
    j = knots.crossJoin(F.broadcast(points)).withColumn("nm", F.explode("_grid")).where(F.col("nm").between(F.col("_knots")[0]["nm"], F.element_at("_knots", -1)["nm"]))
    j = j.withColumn("_at", segment("_knots", "nm", "nm")).withColumns({"_p": F.get("_knots", F.col("_at")), "_q": F.get("_knots", F.col("_at") + 1)})
    h = F.col("_q.nm") - F.col("_p.nm")
    j = j.withColumns({"_h": h, "_t": (F.col("nm") - F.col("_p.nm")) / h})
    t = F.col("_t")
    v = (
        F.col("_p.v") * (t * t * t * 2.0 - t * t * 3.0 + 1.0) + F.col("_p.m") * F.col("_h") * (t * t * t - t * t * 2.0 + t)
        + F.col("_q.v") * (t * t * 3.0 - t * t * t * 2.0) + F.col("_q.m") * F.col("_h") * (t * t * t - t * t)
    )
    return j.select(*by, "nm", v.alias(value))


def spectral_integral(emission: DataFrame, response: DataFrame, by: Sequence[str]) -> DataFrame:
    """∫ emission·response dλ by the trapezoid rule; both ``(key, nm, v1)`` on the same grid, ``by`` = (emission key, response key)."""
    e, r = by
    p = emission.select(F.col(e), "nm", F.col("v1").alias("_e")).join(response.select(F.col(r), "nm", F.col("v1").alias("_r")), "nm")
    p = p.withColumn("_p", F.col("_e") * F.col("_r"))
    w = W.partitionBy(e, r).orderBy("nm")
    part = (F.col("_p") + F.lag("_p").over(w)) * 0.5 * (F.col("nm") - F.lag("nm").over(w))
    return p.withColumn("_t", part).groupBy(e, r).agg(F.sum("_t").alias("integral"))


def curve_integral(curve: DataFrame, response: DataFrame, by: Sequence[str]) -> DataFrame:
    """``spectral_integral`` of curves resampled onto the wavelengths of each response, ``by`` = (curve key, response key).

    A curve meets a response as two rows of arrays, and the points between exist inside that step only: nothing of the size curves × wavelengths is sorted or sent.
    Responses are few reference tables and go to all tasks. A null value leaves out the pieces next to it.
    """
    e, r = by
    tables = response.where("nm is not null").groupBy(r).agg(F.array_sort(F.collect_list(F.struct("nm", F.col("v1").alias("v")))).alias("_table"))
    met = _knots(curve, [e], "v1").crossJoin(F.broadcast(tables)).select(e, r, "_knots", "_table")

    def columns(batch: pa.RecordBatch, at: int, names: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        lists = batch.column(at)
        flat = lists.flatten()
        cells = [flat.field(n) for n in names]
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        null = np.logical_or.reduce([c_.is_null().to_numpy(zero_copy_only=False) for c_ in cells])
        return ends, [c_.to_numpy(zero_copy_only=False).astype(float) for c_ in cells], null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ke, (kx, kv, km), kn = columns(b, 2, ("nm", "v", "m"))
            te, (tx, tv), tn = columns(b, 3, ("nm", "v"))
            keep, out = [], []
            for i in range(b.num_rows):
                x, v, m, none = (a[ke[i] : ke[i + 1]] for a in (kx, kv, km, kn))
                g, f, gone = (a[te[i] : te[i + 1]] for a in (tx, tv, tn))
                lo, hi = np.searchsorted(g, x[0]), np.searchsorted(g, x[-1], "right")
                if lo >= hi:
                    continue
                g, f, gone = g[lo:hi], f[lo:hi], gone[lo:hi]
                p = np.minimum(np.searchsorted(x, g, "right") - 1, len(x) - 2)
                h = x[p + 1] - x[p]
                t = (g - x[p]) / h
                t2, t3 = t * t, t * t * t
                y = f * (v[p] * (t3 * 2.0 - t2 * 3.0 + 1.0) + m[p] * h * (t3 - t2 * 2.0 + t) + v[p + 1] * (t2 * 3.0 - t3 * 2.0) + m[p + 1] * h * (t3 - t2))
                there = ~(gone | none[p] | none[p + 1])
                pieces = ((y[1:] + y[:-1]) * 0.5 * (g[1:] - g[:-1]))[there[1:] & there[:-1]]
                keep.append(i)
                out.append(float(pieces.sum()) if len(pieces) else None)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out, pa.float64())], names=[e, r, "integral"])

    return met.mapInArrow(run, T.StructType([curve.schema[e], response.schema[r], T.StructField("integral", T.DoubleType())]))


def receptor_response(pixels: DataFrame, matrix: Sequence[float], names: Sequence[str] = ("l", "m", "s", "rod"), xyz: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    """Linear receptor signals of XYZ from a 4 × 3 matrix (row-major), never negative."""
    out = [F.greatest(F.lit(0.0), v) for v in mat_vec(matrix, list(xyz))]
    return pixels.withColumns(dict(zip(names, out)))
