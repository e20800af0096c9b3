"""Glare: luminance edits, source grouping, source tables and indices.

Pixels carry ``lum, omega, dx, dy, dz, valid, width, height`` (see ``geometry.with_geometry``). Rows count from the top.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lumenfield.functions import geometry as G
from lumenfield.functions.numeric import c, dot, erf, weighted_mean
from lumenfield.operators import ranking as R
from lumenfield.operators.graph import components
from lumenfield.operators.regions import zone
from lumenfield.operators.stencil import tiles
from lumenfield.session import cut_lineage

KEYS = ("image_id",)
D = ("dx", "dy", "dz")
# π and degrees per radian as rounded in the index definitions, default parameters and DGP coefficients.
PI = 3.1415927
DEG = 180.0 / PI
THRESHOLD, SEARCH, SPLIT = 2000.0, 0.2, 50000.0
DGP = {"a1": 2.0, "a2": 1.0, "a3": 1.87, "a4": 2.0, "a5": 1.0, "c1": 5.87e-5, "c2": 0.092, "c3": 0.159}


# --- picture totals ---


def totals(pixels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Solid angle, vertical illuminance, mean and maximum luminance of valid pixels."""
    return pixels.filter("valid").groupBy(*keys).agg(
        F.sum("omega").alias("omega"), F.sum(F.col("dy") * F.col("omega") * F.col("lum")).alias("ev"),
        weighted_mean("lum", "omega").alias("lum_mean"), F.max("lum").alias("lum_max"),
    )


def position_means(pixels: DataFrame, keys: Sequence[str] = KEYS, model: str = "guth") -> DataFrame:
    """ω-weighted means and plain medians of L, L/P and L/P²."""
    keys = list(keys)
    p = G.with_position_index(pixels.filter("valid"), "p", model).select(*keys, "omega", "lum", "p")
    one = lambda name, v: F.struct(F.lit(name).alias("metric"), v.alias("v"))
    p = p.select(*keys, "omega", F.inline(F.array(
        one("med_lum", F.col("lum")), one("med_lum_pos", F.col("lum") / F.col("p")), one("med_lum_pos2", F.col("lum") / F.col("p") / F.col("p"))
    )))
    by = [*keys, "metric"]
    med = R.percentiles(p, by, "v", {"m": ("median", 0.5)}).drop("n")
    g = p.groupBy(*by).agg(weighted_mean("v", "omega").alias("mean")).join(med, by)

    def pick(metric: str, v: str, name: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(v))).alias(name)

    return g.groupBy(*keys).agg(
        pick("med_lum_pos", "mean", "av_lum_pos"), pick("med_lum_pos2", "mean", "av_lum_pos2"),
        *[pick(m, "m", m) for m in ("med_lum", "med_lum_pos", "med_lum_pos2")],
    )


# --- luminance edits ---


def clip_above(pixels: DataFrame, limit: float, value: float) -> DataFrame:
    return pixels.withColumn("lum", F.when(F.col("lum") >= limit, F.lit(float(value))).otherwise(F.col("lum")))


def replace_disc(pixels: DataFrame, direction: tuple[float, float, float], opening: float, value: float) -> DataFrame:
    """Fixed value where 2·acos(d) ≤ opening."""
    inside = dot(D, direction) >= math.cos(opening / 2.0)
    return pixels.withColumn("lum", F.when(F.col("valid") & inside, F.lit(float(value))).otherwise(F.col("lum")))


def fill_rows(pixels: DataFrame, row: int, upward: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every row from ``row`` to the border takes the row next to it on the inner side. The donor is one row per picture."""
    donor_y = row + 1 if upward else row - 1
    donor = pixels.filter(F.col("y") == donor_y).select(*keys, "x", F.col("lum").alias("_d"))
    covered = (F.col("y") <= row) if upward else (F.col("y") >= row)
    rest, fill = pixels.filter(~covered), pixels.filter(covered)
    filled = fill.join(donor, [*keys, "x"], "left").withColumn("lum", F.coalesce("_d", "lum")).drop("_d")
    return rest.unionByName(filled)


def ideal_value(pixels: DataFrame, measured: DataFrame, limit: float, keys: Sequence[str] = KEYS, cap: float = 2e9) -> DataFrame:
    """Replace pixels ≥ ``limit`` by the value that brings the vertical illuminance to ``measured(keys, ev_measured)``.

    Two passes: one row per picture of sums, joined back.
    """
    keys = list(keys)
    hot = F.col("lum") >= limit
    k = F.col("dy") * F.col("omega")
    s = pixels.filter("valid").groupBy(*keys).agg(
        F.sum(k * F.col("lum")).alias("ev"), F.sum(F.when(hot, k * F.col("lum"))).alias("ev_hot"), F.sum(F.when(hot, k)).alias("k_hot")
    ).join(measured, keys)
    ideal = (F.col("ev_measured") - F.col("ev") + F.col("ev_hot")) / F.col("k_hot")
    value = F.when(ideal > 0, F.least(ideal, F.lit(cap))).otherwise(F.lit(cap))
    s = s.select(*keys, F.when((F.col("ev_hot") > 0) & (F.col("ev_measured") > F.col("ev")), value).alias("_set"))
    j = pixels.join(s, keys, "left")
    return j.withColumn("lum", F.when(F.col("valid") & hot & F.col("_set").isNotNull(), F.col("_set")).otherwise(F.col("lum"))).drop("_set")


# --- source pixels and grouping ---


def threshold(tot: DataFrame, level: float = THRESHOLD, base: str = "lum_mean") -> DataFrame:
    """Source threshold per picture: ``level`` itself above 100, else that many times the task or picture mean."""
    return tot.withColumn("threshold", F.lit(float(level)) if level > 100 else c(base) * level)


def source_pixels(pixels: DataFrame, limits: DataFrame | float = THRESHOLD, keys: Sequence[str] = KEYS) -> DataFrame:
    p = pixels.filter("valid")
    if isinstance(limits, DataFrame):
        return p.join(limits.select(*keys, "threshold"), list(keys)).filter("lum > threshold").drop("threshold")
    return p.filter(F.col("lum") > float(limits))


def _blocks(source: DataFrame, search: float, pitch: float | None) -> DataFrame:
    """Source pixels with ``_node``, the number of their block: square, and narrow enough for all its pixels to belong together."""
    t = 2.0 * math.sin(min(search / 2.0, math.pi) / 2.0)  # chord
    step = c(pitch) if pitch is not None else F.lit(math.pi) / F.least("width", "height")
    size = F.greatest(F.lit(1), F.floor(F.lit(t / 4.0) / step).cast("int"))
    return source.withColumn("_node", F.floor(F.col("y") / size).cast("bigint") * 1000000 + F.floor(F.col("x") / size).cast("bigint"))


def _block_labels(pixels: DataFrame, search: float, keys: list[str]) -> DataFrame:
    """(keys, _node, label) of pixels with ``_node``. Only blocks, pairs of blocks and components are saved, never pixels."""
    a = search / 2.0
    t = 2.0 * math.sin(min(a, math.pi) / 2.0)
    box = pixels.groupBy(*keys, F.col("_node").alias("node")).agg(
        *[F.min(d).alias(f"{d}0") for d in D], *[F.max(d).alias(f"{d}1") for d in D], F.min(F.col("y") * F.col("width") + F.col("x")).alias("first")
    )
    half = F.sqrt(sum(((F.col(f"{d}1") - F.col(f"{d}0")) * 0.5) * ((F.col(f"{d}1") - F.col(f"{d}0")) * 0.5) for d in D))
    box = cut_lineage(box.select(*keys, "node", "first", *[((F.col(f"{d}0") + F.col(f"{d}1")) * 0.5).alias(f"m{i}") for i, d in enumerate(D)], half.alias("rho")))
    g = 2.0 * t
    cell = [F.floor(F.col(f"m{i}") / g).cast("int") for i in range(3)]
    left = box.select(*keys, F.col("node").alias("a"), *[F.col(f"m{i}").alias(f"p{i}") for i in range(3)], F.col("rho").alias("ra"), *[cell[i].alias(f"c{i}") for i in range(3)])
    right = box.select(*keys, F.col("node").alias("b"), "m0", "m1", "m2", F.col("rho").alias("rb"), *[cell[i].alias(f"k{i}") for i in range(3)])
    for i in range(3):
        right = right.withColumn(f"c{i}", F.explode(F.array(F.col(f"k{i}") - 1, F.col(f"k{i}"), F.col(f"k{i}") + 1)))
    pairs = left.join(right, [*keys, "c0", "c1", "c2"]).filter("a <= b")
    gap = F.sqrt(sum((F.col(f"p{i}") - F.col(f"m{i}")) * (F.col(f"p{i}") - F.col(f"m{i}")) for i in range(3)))
    slack = F.col("ra") + F.col("rb")
    # one pixel each: the distance itself decides, as a cosine like the reference rule
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    exact = F.col("p0") * F.col("m0") + F.col("p1") * F.col("m1") + F.col("p2") * F.col("m2") >= math.cos(a)
    pairs = pairs.withColumn("sure", (F.col("a") == F.col("b")) | F.when(single, exact).otherwise(gap + slack <= t))
    pairs = cut_lineage(pairs.filter(F.col("sure") | (~single & (gap - slack <= t))).select(*keys, "a", "b", "sure"))
    comp = components(pairs.filter("sure"), keys)
    doubtful = (
        pairs.filter("not sure")
        .join(comp.select(*keys, F.col("node").alias("a"), F.col("comp").alias("ca")), [*keys, "a"])
        .join(comp.select(*keys, F.col("node").alias("b"), F.col("comp").alias("cb")), [*keys, "b"])
        .filter("ca <> cb")
    )
    doubtful = cut_lineage(doubtful)
    if not doubtful.isEmpty():
        # a block holds at most (t/4 ÷ pitch)² pixels, so its direction list is bounded; lists are made for doubtful blocks only
        ends = doubtful.select(*keys, F.col("a").alias("_node")).unionByName(doubtful.select(*keys, F.col("b").alias("_node"))).distinct()
        dirs = pixels.join(ends, [*keys, "_node"], "left_semi").groupBy(*keys, "_node").agg(F.collect_list(F.struct(*D)).alias("v"))
        met = doubtful.join(dirs.select(*keys, F.col("_node").alias("a"), F.col("v").alias("va")), [*keys, "a"]).join(dirs.select(*keys, F.col("_node").alias("b"), F.col("v").alias("vb")), [*keys, "b"])
        near = F.exists("va", lambda u: F.exists("vb", lambda v: u["dx"] * v["dx"] + u["dy"] * v["dy"] + u["dz"] * v["dz"] >= math.cos(a)))
        bridges = cut_lineage(met.filter(near).select(*keys, F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if not bridges.isEmpty():
            wider = components(bridges, keys).select(*keys, F.col("node").alias("comp"), F.col("comp").alias("_wider"))
            comp = comp.join(wider, [*keys, "comp"], "left").select(*keys, "node", F.coalesce("_wider", "comp").alias("comp"))
    first = box.select(*keys, "node", "first").join(comp, [*keys, "node"])
    label = first.groupBy(*keys, "comp").agg(F.min("first").cast("int").alias("label"))
    return comp.join(label, [*keys, "comp"]).select(*keys, F.col("node").alias("_node"), "label")


def group_sources(source: DataFrame, search: float = SEARCH, keys: Sequence[str] = KEYS, pitch: float | None = None) -> DataFrame:
    """Add ``label``: source pixels within the search angle of one another (2·acos(d) ≤ search), directly or through others.

    The label is the smallest pixel number (y·width + x) of the source, so it depends on neither order nor partitioning. Steps:
    pixels → blocks small enough to be one source in any case; blocks → pairs through a direction grid (27 neighbour cells, an
    equi-join); pairs whose boxes are near enough for certain are united; remaining doubtful pairs of still different sources
    are compared pixel by pixel. ``pitch`` is the largest angle between neighbouring pixels, radians; by default that of a 180° picture.
    """
    keys = list(keys)
    s = _blocks(source.drop("label"), search, pitch)
    return s.join(_block_labels(s, search, keys), [*keys, "_node"]).drop("_node")


def patch_label(patch_degrees: float, view: tuple[float, float] = (180.0, 180.0)) -> Column:
    """Patch number of a pixel on a staggered angular grid instead of grouping: the nearer of two candidate centres.

    Patches are numbered from 1, rows counted from the bottom.
    """
    pdx = F.floor(c("width") / view[0] * patch_degrees)
    pdy = F.floor(c("height") / view[1] * patch_degrees)
    nx = math.floor(view[1] / patch_degrees) + 1
    ny = math.floor(view[0] / patch_degrees) + 1
    xo, yo = F.floor(pdx / 2), F.floor(pdy / 2)
    yb = F.col("height") - 1 - F.col("y")
    line = F.floor(yb / pdy)
    odd = F.pmod(line, F.lit(2))
    col = F.floor(F.greatest(F.lit(0.0), F.col("x") / pdx - F.lit(0.5) * odd))
    i1 = line * nx + col + 1

    def centre(i: Column) -> tuple[Column, Column]:
        row, k = F.floor((i - 1) / nx), (i - 1) % nx
        return xo + F.pmod(row, F.lit(2)) * xo + k * pdx, yo + row * pdy

    cx, cy = centre(i1)
    i2 = F.when(yb > cy, i1 + nx).otherwise(i1 - nx) + F.when(F.col("x") > cx, 0).otherwise(-1) + odd
    ex, ey = centre(i2)
    d1 = (F.col("x") - cx) * (F.col("x") - cx) + (yb - cy) * (yb - cy)
    d2 = (F.col("x") - ex) * (F.col("x") - ex) + (yb - ey) * (yb - ey)
    n = nx * ny
    return F.when((i1 >= 1) & (i1 <= n), F.when((i2 > n) | (i2 < 1) | (d1 < d2), i1).otherwise(i2)).cast("int")


def smoothing_radius(width: int, search: float = SEARCH) -> float:
    """Search radius in pixels at the middle of a 180° picture."""
    pitch = math.pi / width
    return search / (2.0 * math.hypot(10, 10) * pitch / 10.0) / 1.75


def secondary_pixels(pixels: DataFrame, labelled: DataFrame, radius: float, share: float = 0.2, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, y, x, label): unassigned valid pixels that join a source holding more than ``share`` of their window's solid angle.

    The window is a disc clipped to the frame. Haloed tiles are shuffled once; inside a tile the disc sums are running sums per row.
    """
    keys = list(keys)
    r = math.floor(radius)
    lab = labelled.select(*keys, "y", "x", "label")
    p = pixels.select(*keys, "y", "x", "width", "height", "omega", "valid").join(lab, [*keys, "y", "x"], "left")
    tiled = tiles(p.withColumn("label", F.coalesce("label", F.lit(-1))), (r, r), keys)
    schema = T.StructType([*[pixels.schema[k] for k in keys], T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("label", T.IntegerType())])
    rows = [(dy, math.floor(math.sqrt(radius * radius - dy * dy))) for dy in range(-r, r + 1)]

    def disc(m: np.ndarray) -> np.ndarray:
        h, w = m.shape
        run = np.zeros((h + 2 * r, w + 1))
        run[r : r + h, 1:] = np.cumsum(m, axis=1)
        out = np.zeros((h, w))
        xs = np.arange(w)
        for dy, half in rows:
            line = run[r + dy : r + dy + h]
            out += line[:, np.minimum(xs + half + 1, w)] - line[:, np.maximum(xs - half, 0)]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({f.name: [] for f in schema.fields})
        labels = [v for v in np.unique(pdf["label"]) if v >= 0]
        if not labels:
            return empty
        size, ty, tx = int(pdf["_tile"].iloc[0]), int(pdf["_ty"].iloc[0]), int(pdf["_tx"].iloc[0])
        n = size + 2 * r
        iy, ix = (pdf["y"] - ty * size + r).to_numpy(), (pdf["x"] - tx * size + r).to_numpy()
        om, lb, ok = np.zeros((n, n)), np.full((n, n), -1), np.zeros((n, n), bool)
        om[iy, ix], lb[iy, ix] = pdf["omega"].to_numpy(), pdf["label"].to_numpy()
        own = ((pdf["y"] // size == ty) & (pdf["x"] // size == tx) & pdf["valid"]).to_numpy()
        ok[iy[own], ix[own]] = True
        ok &= lb < 0
        total = disc(om)
        parts = []
        for v in labels:
            part = disc(np.where(lb == v, om, 0.0))
            jy, jx = np.nonzero(ok & (part > share * total) & (total > 0))
            parts.append(pd.DataFrame({"y": jy + ty * size - r, "x": jx + tx * size - r, "label": v}))
        out = pd.concat(parts)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[f.name for f in schema.fields]] if len(out) else empty

    return tiled.groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema)


def split_peaks(labelled: DataFrame, limit: float = SPLIT, search: float = SEARCH, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels ≥ ``limit`` leave their source and form sources of their own within it.

    ``label`` of a peak is its smallest pixel number + 1 negated, so it cannot meet that of its parent; ``parent`` keeps the old label.
    """
    keys = list(keys)
    low = labelled.filter(F.col("lum") < limit).withColumn("parent", F.lit(None).cast("int"))
    high = labelled.filter(F.col("lum") >= limit).withColumnRenamed("label", "parent")
    peaks = group_sources(high, search, [*keys, "parent"]).withColumn("label", -(F.col("label") + 1))
    return low.unionByName(peaks)


# --- source tables ---


def source_table(labelled: DataFrame, keys: Sequence[str] = KEYS, by: Sequence[str] = ("label",)) -> DataFrame:
    """Per source: pixels, ω, mean luminance, luminance-weighted centroid, extremes, direct illuminance and frame size."""
    lw = F.col("omega") * F.col("lum")
    return labelled.groupBy(*keys, *by).agg(
        F.count("*").alias("n_px"), F.sum("omega").alias("omega"), weighted_mean("lum", "omega").alias("lum"),
        (F.sum(lw * F.col("x")) / F.sum(lw)).alias("cx"), (F.sum(lw * F.col("y")) / F.sum(lw)).alias("cy"),
        F.min("lum").alias("lum_min"), F.max("lum").alias("lum_max"), F.sum(F.col("dy") * lw).alias("e_glare"),
        F.first("width").alias("width"), F.first("height").alias("height"),
    )


def locate(sources: DataFrame, view: G.View = G.View(), model: str = "guth") -> DataFrame:
    """Direction, angle from the line of sight and position index at the truncated centroid.

    Truncation counts rows from the bottom and follows rounding to 9 digits, so that a centroid on a pixel stays there whatever the order of its sums.
    Directions are formulas of the pixel, so nothing is joined.
    """
    px, up = F.floor(F.round("cx", 9)).cast("int"), F.floor(F.round(F.col("height") - 1 - F.col("cy"), 9))
    d = sources.withColumns({"px": px, "py": (F.col("height") - 1 - up).cast("int")})
    g = G.equidistant("px", "py", "width", "height", view)
    d = d.withColumns({k: g[k] for k in D})
    d = d.withColumn("sigma", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dy")))))
    return G.with_position_index(d, "pos", model).withColumn("theta", F.col("sigma") * DEG)


def renumber(sources: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("label",)) -> DataFrame:
    return sources.withColumn("source_id", F.dense_rank().over(W.partitionBy(*keys).orderBy(*order)))


def split_by_zone(labelled: DataFrame, direction: tuple[float, float, float], inner: float, outer: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Source table with sources cut at zone borders; the illuminance goes with the pixels."""
    return source_table(labelled.withColumn("zone", zone(direction, inner, outer)), keys, ("label", "zone"))


def zone_statistics(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pixels, ω, mean, median, standard deviation, 75th/95th percentiles, extremes and illuminance per region."""
    by = list(by)
    s = pixels.groupBy(*by).agg(
        F.count("*").alias("n_px"), F.sum("omega").alias("omega"), weighted_mean("lum", "omega").alias("av_lum"),
        F.stddev_pop("lum").alias("std_lum"), F.min("lum").alias("lum_min"), F.max("lum").alias("lum_max"),
        F.sum(F.col("dy") * F.col("omega") * F.col("lum")).alias("ev"),
    )
    p = R.percentiles(pixels, by, "lum", {"median_lum": ("median", 0.5), "perc_75": ("paired", 0.75), "perc_95": ("paired", 0.95)})
    return s.join(p.drop("n"), by)


# --- indices ---


def dgm_limit(d: Sequence[str] = D) -> Column:
    """Smallest effective solid angle of a source by its eccentricity."""
    # Coefficients of the published threshold.
    x, f, z = (c(v) for v in d)
    beta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), f)))
    alpha = F.atan2(F.abs(x), F.abs(z))
    base = F.cos(alpha) * (beta - 0.230914) + beta - 0.284456
    deg = F.when(base > 0, F.lit(2.346) * (F.pow(F.when(base > 0, base), beta * 2.02609) + 0.238658)).otherwise(F.lit(2.346 * 0.238658))
    return F.lit(2.0 * math.pi) * (F.lit(1.0) - F.cos(F.radians(F.least(deg, F.lit(6.552)))))


def background(mode: str = "cosine") -> Column:
    """Background luminance: ``cosine`` (E_v − E_dir)/π, ``mean`` of what is not a source, or ``total`` E_v/π."""
    if mode == "cosine":
        return (F.col("ev") - F.col("e_dir")) / PI
    if mode == "total":
        return F.col("ev") / PI
    rest = F.col("omega_all") - F.col("omega_sources")
    return F.when(rest == 0, F.col("lum_mean")).otherwise((F.col("omega_all") * F.col("lum_mean") - F.col("_ls")) / F.nullif(rest, F.lit(0.0)))


def glare_indices(
    sources: DataFrame, tot: DataFrame, keys: Sequence[str] = KEYS, background_mode: str = "cosine", low_light: bool = False,
    age_factor: float = 1.0, external_ev: str | None = None, **coef: float,
) -> DataFrame:
    """All indices, one row per picture: the sums over sources are a single aggregate.

    ``sources(keys, omega, lum, pos, sigma, theta, e_glare, dx, dy, dz)``; ``tot(keys, omega, ev, lum_mean)``. Undefined values are NULL.
    ``external_ev`` names a column of ``tot`` with a measured illuminance that replaces the computed one in DGP.
    """
    keys = list(keys)
    k = {**DGP, **coef}
    t = tot.withColumnRenamed("omega", "omega_all")
    s = sources.select(*keys, F.col("omega").alias("om"), F.col("lum").alias("l"), "pos", "sigma", "theta", "e_glare", *D)
    j = s.join(t.select(*keys, "ev", "lum_mean", "omega_all"), keys)
    w = W.partitionBy(*keys)  # one row per source: a picture has few
    j = j.withColumns({"e_dir": F.sum("e_glare").over(w), "omega_sources": F.sum("om").over(w), "_ls": F.sum(F.col("l") * F.col("om")).over(w)})
    j = j.withColumn("lb", background(background_mode))
    l, om, pos, lb = F.col("l"), F.col("om"), F.col("pos"), F.col("lb")
    lum_a = F.col("ev") / PI
    omega_s = om / pos / pos
    dgi_top = F.pow(l, F.lit(1.6)) * F.pow(omega_s, F.lit(0.8)) * 0.478
    g = j.groupBy(*keys).agg(
        F.count("*").alias("n_sources"), F.max("e_dir").alias("e_v_dir"), F.max("omega_sources").alias("omega_sources"),
        (F.max("_ls") / F.max("omega_sources")).alias("lum_sources"), F.max("lb").alias("lum_backg"),
        F.sum(F.pow(l, F.lit(k["a1"])) / F.pow(pos, F.lit(k["a4"])) * F.pow(om, F.lit(k["a2"]))).alias("_dgp"),
        F.sum(dgi_top / (lb + F.sqrt(om) * l * 0.07)).alias("_dgi"),
        F.sum(dgi_top / (F.pow(lum_a, F.lit(0.85)) + F.sqrt(om) * l * 0.07)).alias("_dgim"),
        F.sum(l / pos * (l / pos) * om).alias("_ugr"), F.sum(l * om / pos / pos).alias("_ugre"),
        F.sum(l * 0.5 * (om * 20.4 + F.pow(om, F.lit(0.2)) * 1.52 - 0.075) / (pos * F.pow(F.col("lum_mean"), F.lit(0.44)))).alias("_dgr"),
        (F.sum(l * F.cos(F.col("sigma") + 1e-11) * om / (F.col("sigma") * DEG + 1e-11)) * 5.0).alias("lveil"),
        F.sum(F.col("e_glare") * 10.0 / (F.col("theta") * F.col("theta") + 1e-16)).alias("lveil_cie"),
        F.sum(l * l * om * om / (F.greatest(om, dgm_limit(), F.lit(1e-16)) * pos * pos)).alias("_dgm"),
    )
    r = t.join(g, keys, "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    ev = c("ev") if external_ev is None else c(external_ev)
    has = F.col("n_sources") > 0
    dgp = F.pow(ev, F.lit(k["a5"])) * k["c1"] + k["c3"] + F.when(has, F.log10(F.lit(1.0) + F.col("_dgp") / F.pow(ev, F.lit(k["a3"]))) * k["c2"]).otherwise(F.lit(0.0))
    dgp = F.least(F.lit(1.0), dgp)
    if low_light:
        x = F.exp(ev * 0.024 - 4.0)
        dgp = dgp * F.when(ev < 1000, x / (x + 1.0)).otherwise(F.lit(1.0))

    def or_zero(v: Column, none: float = 0.0) -> Column:
        return F.when(has, v).otherwise(F.lit(none))

    r = r.withColumn("dgr", or_zero(F.pow(F.col("_dgr"), F.pow(F.col("n_sources").cast("double"), F.lit(-0.0914)))))
    vcp = F.when(F.col("dgr") > 750, F.lit(0.0)).when(F.col("dgr") < 20, F.lit(100.0)).otherwise(
        erf((F.lit(6.374) - F.log("dgr") * 1.3227) / 1.414213562373) * 50.0 + 50.0
    )
    lb = F.when(F.col("lum_backg") > 0, F.col("lum_backg"))
    dgm = F.col("ev") * 5.87e-5 + 0.159 + or_zero(F.log10(F.lit(1.0) + F.col("_dgm") / F.pow(F.greatest("ev", F.lit(1e-9)), F.lit(1.87))) * 0.092)
    return r.select(
        *keys, "n_sources", (dgp * age_factor).alias("dgp"), F.col("lum_mean").alias("av_lum"), F.col("ev").alias("e_v"),
        F.when(has, F.col("lum_backg")).otherwise(F.col("ev") / PI if background_mode != "mean" else F.col("lum_mean")).alias("lum_backg"),
        F.coalesce("e_v_dir", F.lit(0.0)).alias("e_v_dir"),
        or_zero(F.log10("_dgi") * 10.0).alias("dgi"), or_zero(F.log10(F.lit(0.25) / lb * F.col("_ugr")) * 8.0).alias("ugr"),
        or_zero(vcp, 100.0).alias("vcp"),
        or_zero(F.log10((F.lit(1.0) + F.col("e_v_dir") / 500.0) * 2.0 / F.col("ev") * F.col("_ugr")) * 8.0).alias("cgi"),
        F.coalesce("lum_sources", F.lit(0.0)).alias("lum_sources"), F.coalesce("omega_sources", F.lit(0.0)).alias("omega_sources"),
        F.coalesce("lveil", F.lit(0.0)).alias("lveil"), F.coalesce("lveil_cie", F.lit(0.0)).alias("lveil_cie"), "dgr",
        or_zero(F.log10(F.lit(0.25) / lb * F.col("_ugr")) * 0.26).alias("ugp"),
        or_zero(F.log10(F.col("ev") / PI) * 8.0 + F.log10(F.col("_ugre") / ((F.col("ev") - F.col("e_v_dir")) / PI)) * 8.0).alias("ugr_exp"),
        or_zero(F.log10("_dgim") * 10.0).alias("dgi_mod"),
        or_zero(F.lit(1.0) / F.pow(F.lit(1.0) + F.pow(F.col("_ugr") / lb, F.lit(-0.2)) * (2.0 / 7.0), F.lit(10.0))).alias("ugp2"),
        F.least(F.lit(1.0), dgm).alias("dgm"),
    )


def contributions(sources: DataFrame, tot: DataFrame, keys: Sequence[str] = KEYS, **coef: float) -> DataFrame:
    """Share of each source in contrast and DGP, its veil and angle."""
    keys = list(keys)
    k = {**DGP, **coef}
    ix = glare_indices(sources, tot, keys, **coef).select(*keys, F.col("dgp").alias("_dgp"))
    rest = F.pow(F.col("lum"), F.lit(2.0)) * F.col("omega") / (F.col("pos") * F.col("pos"))
    j = sources.withColumn("_all", F.sum(rest).over(W.partitionBy(*keys))).join(tot.select(*keys, "ev"), keys).join(ix, keys)
    e3 = F.pow("ev", F.lit(k["a3"]))
    part = F.log10(F.lit(1.0) + rest / e3) * k["c2"]
    return j.withColumns({
        "r_contrast": part / (F.log10(F.lit(1.0) + F.col("_all") / e3) * k["c2"]), "r_dgp": part / F.col("_dgp"),
        "lveil_cie": F.col("e_glare") * 10.0 / (F.col("theta") * F.col("theta") + 1e-16),
    }).drop("_dgp", "_all", "ev")


def pgsv(stats: DataFrame) -> DataFrame:
    """PGSV contrast, saturation and combined value from ``stats(ev, lum_mean, mask_lum, mask_omega, task_lum)``."""
    pi = 3.14159265359
    lb = (F.col("lum_mean") * (2 * pi) - F.col("mask_lum") * F.col("mask_omega")) / (F.lit(2 * pi) - F.col("mask_omega"))
    d = stats.withColumn("_lb", lb)
    pos = F.when(F.col("_lb") > 0, F.col("_lb"))
    con = F.log10("mask_lum") * 3.2 - F.log10("mask_omega") * 0.64 + (F.log10("mask_omega") * 0.79 - 0.61) * F.log10(pos) - 8.2
    sat = F.lit(3.3) - F.lit(0.57 + 3.3) / (F.pow(F.col("ev") / pi / 1250.0, F.lit(1.7)) + 1.0)
    d = d.withColumns({"pgsv_con": con, "pgsv_sat": sat})
    use_con = F.col("mask_lum") / F.nullif("_lb", F.lit(0.0)) > F.col("ev") / (F.col("task_lum") * pi)
    return d.withColumn("pgsv", F.when(F.col("_lb") != 0, F.when(use_con, F.col("pgsv_con")).otherwise(F.col("pgsv_sat")))).drop("_lb")


def evaluate(pixels: DataFrame, level: float = THRESHOLD, search: float = SEARCH, split: float | None = SPLIT, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Pixels → indices: totals, threshold, grouping, peak split, source table, indices."""
    keys = list(keys)
    tot = totals(pixels, keys)
    src = source_pixels(pixels, threshold(tot, level) if level <= 100 else level, keys).drop("label")
    if split is None:
        lab = group_sources(src, search, keys)
    else:
        # pixels above the split limit that lie within the search angle of one another share their source anyway: both groupings are one, on two layers
        s = _blocks(src, search, None)
        peak = (F.col("lum") >= split).cast("int")
        layers = s.withColumn("_layer", F.explode(F.sequence(F.lit(0), peak)))
        lab = s.withColumn("_layer", peak).join(_block_labels(layers, search, [*keys, "_layer"]), [*keys, "_layer", "_node"])
        lab = lab.withColumn("label", F.when(F.col("_layer") == 1, -(F.col("label") + 1)).otherwise(F.col("label"))).drop("_layer", "_node")
    return glare_indices(locate(source_table(lab, keys)), tot, keys, **kw)


def multi_picture(
    pixels: DataFrame, overlays: DataFrame, scales: Sequence[float] = (1.0,), level: float = THRESHOLD, search: float = SEARCH, keys: Sequence[str] = KEYS,
    placed_on: DataFrame | None = None, **kw,
) -> DataFrame:
    """Indices per (picture, overlay, scan): an overlay's pixels, scaled, replace those of the picture.

    ``overlays(keys, overlay_id, y, x, value)``. Every overlay × scale is its own picture for all later steps. ``placed_on(keys, overlay_id)`` names the pictures
    of each overlay, also those of which it covers no pixel; by default those where it covers one.
    """
    keys = list(keys)
    scans = F.array(*[F.struct(F.lit(i).alias("scan"), F.lit(float(v)).alias("factor")) for i, v in enumerate(scales)])
    which = (overlays if placed_on is None else placed_on).select(*keys, "overlay_id").distinct().select("*", F.inline(scans))
    base = pixels.join(which, keys)
    j = base.join(overlays.select(*keys, "overlay_id", "y", "x", F.col("value").alias("_o")), [*keys, "overlay_id", "y", "x"], "left")
    j = j.withColumn("lum", F.coalesce(F.col("_o") * F.col("factor"), F.col("lum"))).drop("_o", "factor")
    return evaluate(j, level, search, None, [*keys, "overlay_id", "scan"], **kw)
