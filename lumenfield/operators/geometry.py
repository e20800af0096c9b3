"""Geometry operators: per-pixel geometry, key arithmetic, and gathers in tiles (rotation, reprojection, resampling)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lumenfield.functions import geometry as G
from lumenfield.functions.numeric import c, segment
from lumenfield.session import cut_lineage

PI = math.pi
CHANNELS = ("r", "g", "b")


def with_geometry(pixels: DataFrame, view: G.View = G.View()) -> DataFrame:
    """Add nx, ny, radius, theta, omega, dx, dy, dz, valid. Formulas only: no join and no shuffle."""
    parts = G.equidistant("x", "y", "width", "height", view)
    return pixels.withColumns(parts)


def without_projection(pixels: DataFrame) -> DataFrame:
    """Solid angle used when a picture declares no projection."""
    return pixels.withColumn("omega", F.lit(1.0) / (c("width") * c("height")))


def crop(pixels: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """Crop from the top left; pictures too small for the rectangle raise."""
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    fits = (F.lit(left + width) <= F.col("width")) & (F.lit(top + height) <= F.col("height"))
    return (
        pixels.filter(inside | ~fits)
        .withColumn("x", F.when(fits, F.col("x") - left).otherwise(F.raise_error(F.lit("crop leaves the picture")).cast("int")))
        .withColumn("y", F.col("y") - top)
        .withColumns({"width": F.lit(width), "height": F.lit(height)})
    )


def flip_rotate(pixels: DataFrame, degrees: int = 0, flip: str = "") -> DataFrame:
    """Rotate clockwise by 0/90/180/270 degrees, then mirror along x and/or y. Keys only."""
    if degrees not in (0, 90, 180, 270) or set(flip) - {"x", "y"}:
        raise ValueError("rotation must be 0, 90, 180 or 270 and flip one of x, y, xy")
    x, y, w, h = (F.col(k) for k in ("x", "y", "width", "height"))
    x, y, w, h = {
        0: (x, y, w, h),
        90: (h - 1 - y, x, h, w),
        180: (w - 1 - x, h - 1 - y, w, h),
        270: (y, w - 1 - x, h, w),
    }[degrees]
    if "x" in flip:
        x = w - 1 - x
    if "y" in flip:
        y = h - 1 - y
    return pixels.withColumns({"x": x, "y": y, "width": w, "height": h})


# --- gathers -------------------------------------------------------------------------------------------------------

#: Side of a tile, and the most rows of a tile table that are sent to every executor (some 10 MB); beyond, Spark joins it like any other table.
TILE, TABLE_ROWS = 64, 100_000


def frame_grid(pixels: DataFrame) -> DataFrame:
    """One row (width, height, y, x) per pixel of every distinct frame size."""
    sizes = pixels.select("width", "height").distinct()
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))


def _tile(name: str) -> Column:
    return F.floor(F.col(name) / TILE).cast("int")


def _tile_sources(grid: DataFrame) -> DataFrame:
    """(width, height, _sty, _stx, _boxes): for each source tile of a frame size the target tiles that read it, with the box of source pixels each one reads."""
    edge = lambda v, last: F.greatest(F.lit(0), F.least(F.col(last) - 1, v)).cast("int")
    boxes = grid.filter("_ok").groupBy("width", "height", _tile("y").alias("ty"), _tile("x").alias("tx")).agg(*[f(F.floor(v)).alias(f"{n}_{v}") for v in ("_sy", "_sx") for n, f in (("lo", F.min), ("hi", F.max))])
    boxes = boxes.withColumns({"y0": edge(F.col("lo__sy"), "height"), "y1": edge(F.col("hi__sy") + 1, "height"), "x0": edge(F.col("lo__sx"), "width"), "x1": edge(F.col("hi__sx") + 1, "width")})
    read = boxes.withColumn("_sty", F.explode(F.sequence(_tile("y0"), _tile("y1")))).withColumn("_stx", F.explode(F.sequence(_tile("x0"), _tile("x1"))))
    return read.groupBy("width", "height", "_sty", "_stx").agg(F.collect_list(F.struct("ty", "tx", "y0", "y1", "x0", "x1")).alias("_boxes"))


def gather(pixels: DataFrame, place: Callable[[DataFrame], DataFrame], clamped: bool, channels: Sequence[str] = CHANNELS, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Every pixel's value at its source coordinates, bilinear; 0 where it has none.

    ``place`` adds ``_sx, _sy`` (in pixel units, centres at whole numbers) and ``_ok`` to rows with width, height, y, x. Source pixels go, once, to the tiles of
    target pixels that read them, next to which the target pixels themselves already are: one exchange, and no copies but those of tile borders.
    Which tile reads which is a table per frame size, whatever the number of pictures. ``clamped`` repeats border pixels; otherwise coordinates outside the frame have no value.
    """
    keys, channels = list(keys), list(channels)
    right, bottom = F.col("width") - 1, F.col("height") - 1

    def placed(df: DataFrame) -> DataFrame:
        df = place(df)
        if clamped:
            return df.withColumns({"_sx": F.greatest(F.lit(0.0), F.least(right.cast("double"), F.col("_sx"))), "_sy": F.greatest(F.lit(0.0), F.least(bottom.cast("double"), F.col("_sy")))})
        return df.withColumn("_ok", F.col("_ok") & (F.col("_sx") >= 0) & (F.col("_sy") >= 0) & (F.col("_sx") <= right) & (F.col("_sy") <= bottom))

    table = cut_lineage(_tile_sources(placed(frame_grid(pixels))))
    if table.count() <= TABLE_ROWS:
        table = F.broadcast(table)
    rows = placed(pixels.select(*keys, "y", "x", "width", "height", *channels)).withColumns({"_sty": _tile("y"), "_stx": _tile("x")})
    rows = rows.join(table, ["width", "height", "_sty", "_stx"], "left")
    inside = F.filter(F.coalesce("_boxes", F.array().cast(table.schema["_boxes"].dataType)), lambda b: F.col("y").between(b["y0"], b["y1"]) & F.col("x").between(b["x0"], b["x1"]))
    rows = rows.withColumn("_inside", inside)
    own = lambda b: (b["ty"] == F.col("_sty")) & (b["tx"] == F.col("_stx"))
    spot = lambda ty, tx, is_own, is_source: F.struct(ty.alias("_ty"), tx.alias("_tx"), is_own.alias("_own"), is_source.alias("_source"))
    here = F.array(spot(F.col("_sty"), F.col("_stx"), F.lit(True), F.exists("_inside", own)))
    there = F.transform(F.filter("_inside", lambda b: ~own(b)), lambda b: spot(b["ty"], b["tx"], F.lit(False), F.lit(True)))
    dealt_rows = rows.select(*keys, "y", "x", "width", "height", "_sx", "_sy", "_ok", *channels, F.inline(F.concat(here, there)))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        get = lambda name: t[name].to_numpy()
        own_, source = get("_own"), get("_source")
        mine = t.filter(pa.array(own_))
        sx, sy = (np.nan_to_num(mine[n].to_numpy().astype(float)) for n in ("_sx", "_sy"))
        ok = mine["_ok"].fill_null(False).to_numpy(zero_copy_only=False)
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        tx, ty = sx - x0, sy - y0
        x1, y1 = np.minimum(x0 + 1, mine["width"].to_numpy() - 1), np.minimum(y0 + 1, mine["height"].to_numpy() - 1)
        # the block that the tile reads; source pixels that are missing in it count 0
        top, left = (int(y0[ok].min()), int(x0[ok].min())) if ok.any() else (0, 0)
        shape = (int(y1[ok].max()) - top + 1, int(x1[ok].max()) - left + 1) if ok.any() else (1, 1)
        y, x = get("y") - top, get("x") - left
        source = source & (y >= 0) & (x >= 0) & (y < shape[0]) & (x < shape[1])
        y, x = y[source], x[source]
        cell = lambda v, start, size: np.clip(v - start, 0, size - 1)
        ya, yb, xa, xb = cell(y0, top, shape[0]), cell(y1, top, shape[0]), cell(x0, left, shape[1]), cell(x1, left, shape[1])
        out = mine.select([*keys, "y", "x", "width", "height"])
        for ch in channels:
            m = np.zeros(shape)
            m[y, x] = get(ch)[source].astype(float)
            v = m[ya, xa] * ((1 - tx) * (1 - ty)) + m[ya, xb] * (tx * (1 - ty)) + m[yb, xa] * ((1 - tx) * ty) + m[yb, xb] * (tx * ty)
            out = out.append_column(ch, pa.array(np.where(ok, v, 0.0)))
        return out

    schema = T.StructType([*[pixels.schema[k] for k in (*keys, "y", "x", "width", "height")], *[T.StructField(ch, T.DoubleType()) for ch in channels]])
    return dealt_rows.groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)


def rotate(pixels: DataFrame, degrees: float, channels: Sequence[str] = CHANNELS, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Rotation about the middle, counter-clockwise for positive angles, bilinear, 0 outside."""
    a = math.radians(degrees)
    ca, sa = math.cos(a), math.sin(a)
    cx, cy = (c("width") - 1.0) * 0.5, (c("height") - 1.0) * 0.5
    ox, oy = c("x") - cx, c("y") - cy
    return gather(pixels, lambda d: d.withColumns({"_sx": ox * ca - oy * sa + cx, "_sy": ox * sa + oy * ca + cy, "_ok": F.lit(True)}), False, channels, keys)


def with_newton_inverse(df: DataFrame, coefficients: Sequence[float], target: str, name: str, steps: int = 4) -> DataFrame:
    """Add u in [0, 1] with Σ kᵢ·uⁱ⁺¹ = target: unrolled Newton steps, each its own projection."""
    df = df.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(target))))
    u = F.col(name)
    for _ in range(steps):
        value, slope = F.lit(0.0), F.lit(0.0)
        for i, k in reversed(list(enumerate(coefficients))):
            value = (value + F.lit(k)) * u
            slope = slope * u + F.lit((i + 1) * k)
        df = df.withColumns({"_value": value, "_slope": slope})
        step = F.when(F.abs("_slope") > 1e-14, (F.col("_value") - F.col(target)) / F.col("_slope")).otherwise(F.lit(0.0))
        df = df.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), u - step)))
    return df.drop("_value", "_slope")


def reproject(
    pixels: DataFrame, kind: str, channels: Sequence[str] = CHANNELS, keys: Sequence[str] = ("image_id",),
    coefficients: Sequence[float] = (), source_radius: float = 0.0, target_radius: float = 0.0,
) -> DataFrame:
    """Any supported lens → equidistant: ``equisolid``, ``hemispherical``, ``calibrated`` (radial polynomial, inverted) or
    ``angle_polynomial``. Samples clamp to the border; targets outside the circle are 0. Pictures must be square."""
    pixels = pixels.filter(F.when(F.col("width") == F.col("height"), True).otherwise(F.raise_error(F.lit("square pictures only")).cast("boolean")))
    w, h = c("width"), c("height")

    def place(d: DataFrame) -> DataFrame:
        if kind in ("equisolid", "hemispherical"):
            dx, dy = (c("x") + 0.5) / w - 0.5, (c("y") + 0.5) / h - 0.5
            radius = F.sqrt(dx * dx + dy * dy)
            src = F.sin(radius * (PI / 2)) / math.sqrt(2.0) if kind == "equisolid" else F.sin(radius * PI) * 0.5
            scale = F.when(radius > 1e-12, src / radius).otherwise(F.lit(1.0))
            return d.withColumns({"_sx": (dx * scale + 0.5) * w - 0.5, "_sy": (dy * scale + 0.5) * h - 0.5, "_ok": radius <= 0.5})
        dx, dy = c("x") + 0.5 - w * 0.5, c("y") + 0.5 - h * 0.5
        radius = F.sqrt(dx * dx + dy * dy)
        if kind == "calibrated":
            d = with_newton_inverse(d.withColumn("_t", radius / target_radius), coefficients, "_t", "_u").drop("_t")
            u = F.col("_u")
            valid = radius <= target_radius
        elif kind == "angle_polynomial":
            angle = radius / target_radius * (PI / 2)
            u = F.lit(0.0)
            for k in reversed(coefficients):
                u = (u + F.lit(k)) * angle
            valid = (radius < target_radius) & (u >= 0) & (u < 1)
        else:
            raise ValueError(f"unknown lens {kind}")
        scale = F.when(radius > 1e-12, u * source_radius / radius).otherwise(F.lit(0.0))
        return d.withColumns({"_sx": w * 0.5 + dx * scale - 0.5, "_sy": h * 0.5 + dy * scale - 0.5, "_ok": valid})

    return gather(pixels, place, True, channels, keys)


def valid_half_angle(coefficients: Column, steps: int = 80) -> Column:
    """Largest field angle (radians, at most π/2) whose polynomial radius stays within 1, by bisection per row."""

    def radius(angle: Column) -> Column:
        return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, k: (acc + k) * angle)

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(PI / 2).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) * 0.5
        below = radius(mid) < 1.0
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) * 0.5)
    return F.when(radius(F.lit(PI / 2)) <= 1.0, F.lit(PI / 2)).otherwise(found)


def stereo_split(pixels: DataFrame, left: tuple[int, int, int, int], right: tuple[int, int, int, int], **lens) -> DataFrame:
    """Two square crops (x, y, w, h) of a dual-fisheye frame, each brought to equidistant, tagged ``eye``."""
    eyes = []
    for eye, (x, y, w, h) in (("left", left), ("right", right)):
        eyes.append(crop(pixels, x, y, w, h).withColumn("eye", F.lit(eye)))
    return reproject(eyes[0].unionByName(eyes[1]), "calibrated", keys=("image_id", "eye"), **lens)


# kernel of a distance in filter steps, and its radius
KERNELS = {
    "tent": (lambda d: np.maximum(0.0, 1.0 - np.abs(d)), 1.0),
    "lanczos": (lambda d: np.where(np.abs(d) > 3.0, 0.0, np.sinc(d) * np.sinc(d / 3.0)), 3.0),
}


def axis_weights(n: int, target: int, first: int, last: int, kind: str) -> tuple[int, np.ndarray]:
    """Source position of the first column, and the weights (target positions ``first`` to ``last``, source positions) of an axis of ``n`` brought to ``target``.

    The kernel is widened by n / target when shrinking, weights add up to 1, and positions beyond an end count for the end.
    """
    kernel, radius = KERNELS[kind]
    stretch = max(1.0, n / target)
    t = np.arange(first, last + 1)
    centre = (t + 0.5) / target * n
    at = np.floor(centre - radius * stretch + 0.5).astype(int)[:, None] + np.arange(int(np.floor(2.0 * radius * stretch)))
    w = kernel((at + 0.5 - centre[:, None]) / stretch)
    at = np.clip(at, 0, n - 1)
    start = int(at.min())
    out = np.zeros((len(t), int(at.max()) - start + 1))
    np.add.at(out, (np.arange(len(t))[:, None], at - start), w)
    return start, out / out.sum(axis=1, keepdims=True)


def resample(pixels: DataFrame, target: tuple[int, int], kind: str = "tent", channels: Sequence[str] = CHANNELS, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Separable resampling of frames of any sizes (their rows' ``width``, ``height``) to ``target`` (w, h), along x then y.

    Pixels that are missing count 0; a target pixel all of whose sources are missing is missing too.

    A pixel goes to the target tiles whose kernels may reach it, which follow from its place and its frame's size: one exchange, and no table.
    """
    keys, channels = list(keys), list(channels)
    radius = KERNELS[kind][1]

    def reach(axis: str, size: str, length: int) -> Column:
        # target positions within the kernel's radius and one more; the ends stand for all beyond them
        scale, wide = F.lit(float(length)) / F.col(size), F.greatest(F.lit(1.0), F.col(size) / float(length)) * radius + 1.0
        lo = F.when(F.col(axis) == 0, F.lit(0.0)).otherwise((F.col(axis) + 0.5 - wide) * scale - 1.0)
        hi = F.when(F.col(axis) == F.col(size) - 1, F.lit(length - 1.0)).otherwise((F.col(axis) + 0.5 + wide) * scale + 1.0)
        inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(length - 1.0), v))
        # a border pixel is needed near its own end only
        hi = F.when(F.col(axis) == 0, (wide + 0.5) * scale + 1.0).otherwise(hi)
        lo = F.when(F.col(axis) == F.col(size) - 1, (F.col(size) - 0.5 - wide) * scale - 1.0).otherwise(lo)
        return F.sequence(F.floor(inside(lo) / TILE).cast("int"), F.floor(inside(hi) / TILE).cast("int"))

    rows = pixels.select(*keys, "y", "x", "width", "height", *channels)
    rows = rows.withColumn("_ty", F.explode_outer(reach("y", "height", target[1]))).withColumn("_tx", F.explode_outer(reach("x", "width", target[0])))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ty, tx = key[len(keys)].as_py(), key[len(keys) + 1].as_py()
        height, width = t["height"][0].as_py(), t["width"][0].as_py()
        ends = [(k * TILE, min(k * TILE + TILE, length) - 1) for k, length in ((ty, target[1]), (tx, target[0]))]
        y_start, wy = axis_weights(height, target[1], *ends[0], kind)
        x_start, wx = axis_weights(width, target[0], *ends[1], kind)
        y, x = t["y"].to_numpy() - y_start, t["x"].to_numpy() - x_start
        near = (y >= 0) & (x >= 0) & (y < wy.shape[1]) & (x < wx.shape[1])
        there = np.zeros((wy.shape[1], wx.shape[1]))
        there[y[near], x[near]] = 1.0
        found = np.flatnonzero(((wy != 0) @ there @ (wx != 0).T).ravel())
        n = wy.shape[0] * wx.shape[0]
        columns = {k: pa.array([key[i].as_py()] * n, t.schema.field(k).type) for i, k in enumerate(keys)}
        columns["y"] = pa.array(np.repeat(np.arange(ends[0][0], ends[0][1] + 1, dtype=np.int32), wx.shape[0]))
        columns["x"] = pa.array(np.tile(np.arange(ends[1][0], ends[1][1] + 1, dtype=np.int32), wy.shape[0]))
        columns["width"], columns["height"] = (pa.array(np.full(n, v, np.int32)) for v in target)
        for ch in channels:
            m = np.zeros((wy.shape[1], wx.shape[1]))
            m[y[near], x[near]] = t[ch].to_numpy()[near].astype(float)
            columns[ch] = pa.array((wy @ (m @ wx.T)).ravel())
        return pa.table(columns).take(pa.array(found))

    schema = T.StructType([*[pixels.schema[k] for k in keys], *[T.StructField(n, T.IntegerType()) for n in ("y", "x", "width", "height")], *[T.StructField(ch, T.DoubleType()) for ch in channels]])
    return rows.groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)


# --- vignetting --------------------------------------------------------------------------------------------------


def vignetting_table(pixels: DataFrame, table: DataFrame, channels: Sequence[str] = CHANNELS, by: Sequence[str] = ()) -> DataFrame:
    """Multiply by factors interpolated at the angle from the picture middle (180° over the width); beyond its ends the profile goes on in a straight line.

    ``table(by, angle, fr, fg, fb)``: one profile, or one for each value of the columns ``by``, such as the camera. Each profile becomes one row with its sorted
    points, in which every pixel searches its segment. One point: its factors hold everywhere. Pixels without a profile or an angle keep their row, with NULL channels.
    """
    factors = ("fr", "fg", "fb")
    profile = table.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("angle", *factors))).alias("_points"))
    dx, dy = c("x") + 0.5 - c("width") * 0.5, c("y") + 0.5 - c("width") * 0.5
    angle = F.degrees(F.acos(F.cos(F.sqrt(dx * dx + dy * dy) / c("width") * PI)))
    # without keys the profile is one row
    j = pixels.join(profile, list(by), "left") if by else pixels.crossJoin(F.broadcast(profile))
    j = j.withColumn("_angle", angle).withColumn("_at", segment("_points", "angle", "_angle"))
    j = j.withColumns({"_p": F.get("_points", F.col("_at")), "_q": F.coalesce(F.get("_points", F.col("_at") + 1), F.get("_points", F.col("_at")))})
    t = F.coalesce((F.col("_angle") - F.col("_p.angle")) / F.nullif(F.col("_q.angle") - F.col("_p.angle"), F.lit(0.0)), F.lit(0.0))
    j = j.withColumn("_t", t)
    return j.withColumns({ch: F.col(ch) * (F.col(f"_p.{f}") * (F.lit(1.0) - F.col("_t")) + F.col(f"_q.{f}") * F.col("_t")) for ch, f in zip(channels, factors)}).select(*pixels.columns)


def _vignetting_r2() -> Column:
    size = F.greatest("width", "height")
    dx, dy = (c("x") + 0.5 - c("width") / 2.0) / size, (c("y") + 0.5 - c("height") / 2.0) / size
    return dx * dx + dy * dy


def vignetting_polynomial(pixels: DataFrame, a: float, b: float, k: float, channels: Sequence[str] = CHANNELS) -> DataFrame:
    r2 = _vignetting_r2()
    gain = F.lit(1.0) / (F.lit(1.0) + r2 * a + r2 * r2 * b + r2 * r2 * r2 * k)
    return pixels.withColumns({ch: F.col(ch) * gain for ch in channels})


def fit_vignetting(pixels: DataFrame, step: int = 10, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Least squares of luminance on 1, r², r⁴, r⁶ at every ``step``-th pixel; coefficients relative to the constant.

    Only eleven sums per picture leave the executors' partial aggregates; the 4 × 4 system is eliminated in expressions.
    """
    # Luminance row used for the fit.
    lum = F.lit(0.212671) * F.col("r") + F.lit(0.715160) * F.col("g") + F.lit(0.072169) * F.col("b")
    s = pixels.filter(f"x % {step} = 0 and y % {step} = 0").select(*keys, _vignetting_r2().alias("q"), lum.alias("lum"))
    m = s.groupBy(*keys).agg(
        *[F.sum(F.pow("q", F.lit(float(p)))).alias(f"m{p}") for p in range(7)],
        *[F.sum(F.pow("q", F.lit(float(p))) * F.col("lum")).alias(f"t{p}") for p in range(4)],
    )
    # forward elimination, one generation of columns per pivot so that expressions stay small
    names = [[f"m{i + j}" for j in range(4)] + [f"t{i}"] for i in range(4)]
    for k in range(4):
        new = {}
        for i in range(k + 1, 4):
            for j in range(k, 5):
                new[f"e{k}_{i}_{j}"] = F.col(names[i][j]) - F.col(names[i][k]) / F.nullif(F.col(names[k][k]), F.lit(0.0)) * F.col(names[k][j])
        m = m.withColumns(new) if new else m
        for i in range(k + 1, 4):
            for j in range(k, 5):
                names[i][j] = f"e{k}_{i}_{j}"
    for i in (3, 2, 1, 0):
        rest = F.col(names[i][4])
        for j in range(i + 1, 4):
            rest = rest - F.col(names[i][j]) * F.col(f"s{j}")
        m = m.withColumn(f"s{i}", rest / F.nullif(F.col(names[i][i]), F.lit(0.0)))
    return m.select(*keys, *[(F.col(f"s{i}") / F.col("s0")).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))])


# --- polygons ----------------------------------------------------------------------------------------------------


def scanline_intervals(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, polygon, y, _from, _to): the x-intervals (from, to] that lie inside on each row a polygon crosses, by the even-odd rule. Intervals of one row do not overlap."""
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    cuts = (
        edges.filter("y0 <> y1")
        .withColumn("y", F.explode(F.sequence(F.ceil(lo).cast("int"), F.ceil(hi).cast("int"))))
        .filter((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y")))
        .withColumn("_to", (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    )
    # one row of one polygon has a few cuts
    row = W.partitionBy(*by, "polygon", "y")
    line = row.orderBy("_to", "x0", "y0", "x1", "y1")
    cuts = cuts.withColumns({"_from": F.coalesce(F.lag("_to").over(line), F.lit(float("-inf"))), "_left": F.count("*").over(row) - F.row_number().over(line) + 1})
    return cuts.filter("_left % 2 = 1 AND _from < _to").select(*by, "polygon", "y", "_from", "_to")


def polygon_mask(pixels: DataFrame, edges: DataFrame, keys: Sequence[str] = ("image_id",), by: Sequence[str] = ()) -> DataFrame:
    """Pixels inside polygons by the even-odd rule: (keys, by, polygon, y, x).

    ``edges(by, polygon, x0, y0, x1, y1)`` in pixel coordinates, for all pictures or for those whose columns ``by``, such as the picture or the camera, are equal.
    Edges become disjoint intervals on the rows they cross, so pixels meet them by an equi-join on ``by`` and row with one comparison, and nothing is counted afterwards.
    """
    hits = pixels.select(*dict.fromkeys([*keys, *by, "y", "x"])).join(scanline_intervals(edges, by), [*by, "y"])
    return hits.filter((F.col("x") > F.col("_from")) & (F.col("x") <= F.col("_to"))).select(*dict.fromkeys([*keys, *by]), "polygon", "y", "x")


def nearest_resize(rows: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize of sparse rows (y, x): each source pixel is sent to the targets that read it."""

    def reach(k: str, s: int, t: int) -> Column:
        lo = F.ceil(c(k) * t / s - 0.5).cast("int")
        hi = (F.ceil((c(k) + 1.0) * t / s - 0.5) - 1).cast("int")
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    ty = rows.withColumn("_ty", F.explode(reach("y", source[1], target[1])))
    tx = ty.withColumn("_tx", F.explode(reach("x", source[0], target[0])))
    return tx.withColumns({"y": F.col("_ty"), "x": F.col("_tx")}).drop("_ty", "_tx")

