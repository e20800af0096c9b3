"""View volume: depth maps, category masks and their paired comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.numeric import Num, c, dot
from lumenfield.operators import ranking as R
from lumenfield.operators.geometry import frame_grid
from lumenfield.operators.regions import iou
from lumenfield.session import cut_lineage, parts_for

PX = ("image_id", "y", "x")
#: Most taps that are sent to every executor; longer tables Spark joins like any other.
SENT = 100_000
# The five faces as (forward, right, down) axes, each (right, forward, up) of the picture.
FACES = (
    ((0, 1, 0), (1, 0, 0), (0, 0, -1)), ((-1, 0, 0), (0, 1, 0), (0, 0, -1)), ((1, 0, 0), (0, -1, 0), (0, 0, -1)),
    ((0, 0, 1), (1, 0, 0), (0, 1, 0)), ((0, 0, -1), (1, 0, 0), (0, -1, 0)),
)


def taps(grid: DataFrame, sx: Column, sy: Column, valid: Column, clamped: bool) -> DataFrame:
    """Bilinear taps (width, height, y, x, sy, sx, wt) for source coordinates in pixel units (centre at integers).

    One table per frame size, whatever the number of pictures: its rows are bounded by four frames.
    ``clamped`` repeats border pixels; otherwise coordinates outside the frame give no taps.
    """
    g = grid.withColumns({"_sx": sx, "_sy": sy}).filter(valid)
    right, bottom = F.col("width") - 1, F.col("height") - 1
    if clamped:
        g = g.withColumns({
            "_sx": F.greatest(F.lit(0.0), F.least(right.cast("double"), F.col("_sx"))),
            "_sy": F.greatest(F.lit(0.0), F.least(bottom.cast("double"), F.col("_sy"))),
        })
    else:
        g = g.filter((F.col("_sx") >= 0) & (F.col("_sy") >= 0) & (F.col("_sx") <= right) & (F.col("_sy") <= bottom))
    g = g.withColumns({"_x0": F.floor("_sx").cast("int"), "_y0": F.floor("_sy").cast("int")})
    g = g.withColumns({"_tx": F.col("_sx") - F.col("_x0"), "_ty": F.col("_sy") - F.col("_y0")})
    one = F.lit(1.0)
    x1, y1 = F.least(F.col("_x0") + 1, right), F.least(F.col("_y0") + 1, bottom)
    four = F.array(
        F.struct(F.col("_y0").alias("sy"), F.col("_x0").alias("sx"), ((one - F.col("_tx")) * (one - F.col("_ty"))).alias("wt")),
        F.struct(F.col("_y0").alias("sy"), x1.alias("sx"), (F.col("_tx") * (one - F.col("_ty"))).alias("wt")),
        F.struct(y1.alias("sy"), F.col("_x0").alias("sx"), ((one - F.col("_tx")) * F.col("_ty")).alias("wt")),
        F.struct(y1.alias("sy"), x1.alias("sx"), (F.col("_tx") * F.col("_ty")).alias("wt")),
    )
    return g.select("width", "height", "y", "x", F.inline(four)).filter("wt > 0")


def stitch_faces(faces: DataFrame, targets: DataFrame, face_size: int, fov: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Radial depth of equidistant pixels from five perspective depth tiles ``faces(keys, face, y, x, depth_m)``.

    Which tile pixels a target reads depends on the frame size only, so that table is computed once and joined; coverage is the summed
    edge/incidence weight relative to the best of the picture.
    """
    from lumenfield.functions.geometry import equidistant

    keys = list(keys)
    half, focal = math.tan(math.radians(fov) / 2.0), 0.5 * face_size / math.tan(math.radians(fov) / 2.0)
    grid = frame_grid(targets)
    g = equidistant("x", "y", "width", "height")
    grid = grid.withColumns({k: g[k] for k in ("dx", "dy", "dz", "valid")}).filter("valid")
    axes = F.array(*[F.struct(F.lit(i).alias("face"), *[F.lit(float(v)).alias(f"{a}{n}") for a, ax in zip("frd", f) for n, v in enumerate(ax)]) for i, f in enumerate(FACES)])
    t = grid.select("*", F.inline(axes))
    ray = ("dx", "dy", "dz")
    t = t.withColumn("den", dot(ray, ("f0", "f1", "f2"))).filter("den > 1e-6")
    t = t.withColumns({"xn": dot(ray, ("r0", "r1", "r2")) / F.col("den"), "yn": dot(ray, ("d0", "d1", "d2")) / F.col("den")})
    t = t.filter((F.abs("xn") <= half) & (F.abs("yn") <= half))
    edge = F.greatest(F.abs("xn"), F.abs("yn")) / half
    w = F.pow(F.greatest(F.lit(0.02), F.lit(1.0) - edge), F.lit(2.0)) * F.pow(F.least(F.lit(1.0), F.col("den")), F.lit(2.0))
    t = t.withColumns({"blend": w, "tx": F.col("xn") * focal + (face_size - 1) / 2.0, "ty": F.col("yn") * focal + (face_size - 1) / 2.0})
    # the tap helper works on one frame size: a tile is a frame of its own
    size = t.select(F.lit(face_size).alias("width"), F.lit(face_size).alias("height"), F.struct("y", "x", "width", "height", "face").alias("y"), F.struct("den", "blend").alias("x"), "tx", "ty")
    tap = taps(size, F.col("tx"), F.col("ty"), F.lit(True), clamped=True)
    tap = cut_lineage(tap.select("y.*", F.col("x.den").alias("den"), F.col("x.blend").alias("blend"), "sy", "sx", "wt"))
    # each picture reads the taps of its own target size
    src = faces.join(targets.select(*keys, "width", "height").distinct(), keys)
    src = src.select(*keys, "width", "height", "face", F.col("y").alias("sy"), F.col("x").alias("sx"), "depth_m")
    on, parts = ["width", "height", "face", "sy", "sx"], parts_for(faces.sparkSession, faces.count())
    if tap.count() <= SENT:
        j = src.repartition(parts, *keys, "face").join(F.broadcast(tap), on)
    else:
        # four taps a target
        j = src.join(tap, on).repartition(4 * parts, *keys, "y", "x")
    j = j.groupBy(*keys, "y", "x", "face", "den", "blend").agg(F.sum(F.col("wt") * F.col("depth_m")).alias("z"))
    j = j.withColumn("radial", F.col("z") / F.col("den")).filter("radial > 0")
    s = j.repartition(parts, *keys, "y", "x").groupBy(*keys, "y", "x").agg(F.sum(F.col("radial") * F.col("blend")).alias("_s"), F.sum("blend").alias("_w"))
    best = s.groupBy(*keys).agg(F.max("_w").alias("_best"))
    return s.join(best, keys).select(*keys, "y", "x", (F.col("_s") / F.col("_w")).alias("depth_m"), (F.col("_w") / F.greatest("_best", F.lit(1e-9))).alias("coverage"))


def clamp_depth(depth: DataFrame, lo: float, hi: float) -> DataFrame:
    """Valid depths clamped to [lo, hi], 0 elsewhere, with flags for clamped pixels."""
    d = F.col("depth_m")
    ok = F.coalesce(~F.isnan(d) & (d > 0) & (d < float("inf")), F.lit(False))
    return depth.withColumns({
        "below": ok & (d < lo), "above": ok & (d > hi), "depth_m": F.when(ok, F.greatest(F.lit(lo), F.least(F.lit(hi), d))).otherwise(F.lit(0.0)),
    })


def glazing_distance(metres: Num, forward: Num = "dy", valid: Column | None = None) -> Column:
    """Ray distance to a front-facing plane; 0 outside the view or without a plane."""
    f, m = c(forward), c(metres)
    v = F.when(m <= 0, F.lit(0.0)).when(f > 1e-6, m / f).otherwise(F.lit(float("inf")))
    return F.when(valid, v).otherwise(F.lit(0.0)) if valid is not None else v


def perspective_glazing(metres: Num, vh: float, vv: float) -> Column:
    """The same for a perspective picture: distance times the ray's length at unit depth."""
    fx, fy = c("width") * 0.5 / math.tan(math.radians(vh / 2)), c("height") * 0.5 / math.tan(math.radians(vv / 2))
    x, y = (c("x") + 0.5 - c("width") * 0.5) / fx, (c("y") + 0.5 - c("height") * 0.5) / fy
    return c(metres) * F.sqrt(F.lit(1.0) + x * x + y * y)


def cone_volume(depth: Num = "depth_m", omega: Num = "omega", glazing: Num = "glazing_m") -> Column:
    """ω·max(d³ − g³, 0)/3."""
    d, g = c(depth), c(glazing)
    return c(omega) * F.greatest(d * d * d - g * g * g, F.lit(0.0)) / 3.0


def view_volume(pixels: DataFrame, masks: DataFrame, keys: Sequence[str] = PX) -> DataFrame:
    """Volume per pixel and category: ``pixels(keys, depth_m, omega, glazing_m)`` ⋈ ``masks(keys, category)``."""
    return pixels.withColumn("volume_m3", cone_volume()).join(masks.select(*keys, "category"), list(keys))


def category_summary(volumes: DataFrame, by: Sequence[str] = ("image_id", "category")) -> DataFrame:
    """Pixels, solid angle, median depth of measured pixels and volume."""
    by = list(by)
    s = volumes.groupBy(*by).agg(F.count("*").alias("n_px"), F.sum("omega").alias("omega"), F.sum("volume_m3").alias("volume_m3"))
    m = R.percentiles(volumes.filter("depth_m > 0"), by, "depth_m", {"median_depth_m": ("median", 0.5)}).drop("n")
    return s.join(m, by, "left")


def satisfaction(built: Num, green: Num, a: float | None, b: float | None, k: float | None) -> Column:
    """a·log10(1+V_built) + b·log10(1+V_green) + c; NULL without coefficients, an error when only some are given."""
    given = [v is not None for v in (a, b, k)]
    if not any(given):
        return F.lit(None).cast("double")
    if not all(given):
        raise ValueError("give all three coefficients or none")
    return F.log10(c(built) + 1.0) * a + F.log10(c(green) + 1.0) * b + k


def depth_errors(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bias, MAE, RMSE, median absolute error and MAPE of ``depth_m`` against ``ref_m`` where both are positive."""
    by = list(by)
    d = pairs.filter("depth_m > 0 and ref_m > 0").withColumn("_e", F.col("depth_m") - F.col("ref_m")).withColumn("_a", F.abs("_e"))
    g = d.groupBy(*by).agg(
        F.count("*").alias("n_px"), F.avg("_e").alias("bias_m"), F.avg("_a").alias("mae_m"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_m"),
        (F.avg(F.col("_a") / F.greatest("ref_m", F.lit(1e-6))) * 100.0).alias("mape"),
    )
    return g.join(R.percentiles(d, by, "_a", {"median_ae_m": ("median", 0.5)}).drop("n"), by)


def paired_report(inside: DataFrame, outside: DataFrame, by: Sequence[str] = ("image_id", "category")) -> DataFrame:
    """IoU, depth errors on the common mask, volume difference and per cent; one row per picture and category.

    Both inputs ``(image_id, category, y, x, depth_m, omega, volume_m3)`` hold masked pixels only.
    """
    by = list(by)
    px = [*by, "y", "x"]
    overlap = iou(inside, outside, by, px)
    err = depth_errors(inside.select(*px, "depth_m").join(outside.select(*px, F.col("depth_m").alias("ref_m")), px), by)
    a = inside.groupBy(*by).agg(F.sum("volume_m3").alias("volume_in"))
    b = outside.groupBy(*by).agg(F.sum("volume_m3").alias("volume_out"))
    j = overlap.join(a, by, "left").join(b, by, "left").join(err.withColumnRenamed("n_px", "n_common"), by, "left")
    diff = F.coalesce("volume_in", F.lit(0.0)) - F.coalesce("volume_out", F.lit(0.0))
    return j.withColumns({"volume_error": diff, "volume_error_pct": F.when(F.col("volume_out") > 0, diff / F.col("volume_out") * 100.0)})


def report_json(report: DataFrame) -> DataFrame:
    return report.select("image_id", F.to_json(F.struct(*report.columns)).alias("report"))


def _of_picture(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the values of their picture. ``table`` is saved and has a row per picture: it is sent to the rows up to a count; else rows are dealt by a count, so that a task's do not grow with the archive."""
    if table.count() <= R.SENT:
        return df.join(F.broadcast(table), keys)
    return df.repartition(parts_for(df.sparkSession, df.count()), *keys).join(table.hint("merge"), keys)


def _trimmed(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median of what lies between the 10th and 90th percentile, with the number of candidates."""
    q = R.percentiles(df, keys, value, {"_lo": ("linear", 0.1), "_hi": ("linear", 0.9)})
    q = cut_lineage(q)
    t = _of_picture(df, q.select(*keys, "_lo", "_hi"), keys).filter((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))
    m = R.percentiles(t, keys, value, {name: ("median", 0.5)}).select(*keys, name)
    return q.select(*keys, F.col("n").alias(f"{name}_n")).join(m, keys)


def window_distance(pixels: DataFrame, keys: Sequence[str] = ("image_id",), enough: int = 256) -> DataFrame:
    """Observer-to-window distance with the method that gave it.

    ``pixels(keys, y, x, dy, depth_m, ref_m, inside, outside, near_window)``: paired rays first, then pixels around the window mask, then
    pixels segmented only indoors, then the nearest 40 % of depths. Each step needs ``enough`` candidates.
    """
    keys = list(keys)
    cos = F.greatest(F.lit(1e-4), F.least(F.lit(1.0), F.col("dy")))
    d = pixels.withColumns({"_disc": F.col("depth_m") * F.col("depth_m") - F.col("ref_m") * F.col("ref_m") * F.greatest(F.lit(0.0), F.lit(1.0) - cos * cos), "_axial": F.col("depth_m") * cos})
    ray = d.filter("depth_m > 0 and ref_m > 0 and inside and outside and _disc >= 0").withColumn("_v", F.sqrt("_disc") - F.col("ref_m") * cos)
    ok = d.filter("_axial >= 0.1 and _axial <= 20.0").withColumn("_v", F.col("_axial"))
    cut = cut_lineage(R.percentiles(ok, keys, "_v", {"_cut": ("linear", 0.4)}).select(*keys, "_cut"))
    steps = [
        ("paired", _trimmed(ray, keys, "_v", "paired")),
        ("boundary", _trimmed(ok.filter("near_window"), keys, "_v", "boundary")),
        ("indoor", _trimmed(ok.filter("inside and not outside"), keys, "_v", "indoor")),
        ("near", _trimmed(_of_picture(ok, cut, keys).filter("_v <= _cut"), keys, "_v", "near")),
    ]
    out = pixels.select(*keys).distinct()
    for _, s in steps:
        out = out.join(s, keys, "left")
    total = ok.groupBy(*keys).agg(F.count("*").alias("_all"))
    out = out.join(total, keys, "left")
    use, dist = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(0.0))
    for name, _ in steps:
        good = F.col(f"{name}_n") >= enough if name != "near" else F.col("_all") >= enough
        if name == "paired":
            good = good & F.col(name).between(0.1, 20.0)
        use, dist = use.when(good, name), dist.when(good, F.col(name))
    return out.select(*keys, use.alias("method"), dist.alias("distance_m"))


def quality_warnings(summary: DataFrame) -> DataFrame:
    """Add ``warnings`` from ``overlap_px, built_px, green_px, window_m, path``."""
    smaller = F.least("built_px", "green_px")
    share = F.when(smaller > 0, F.col("overlap_px") / smaller).otherwise(F.lit(0.0))
    rules = F.array(
        F.when(F.lower("path").contains("_blind_"), F.lit("blinds")),
        F.when(share > 0.25, F.lit("overlap")), F.when(F.col("window_m") <= 0, F.lit("no window distance")),
    )
    return summary.withColumn("warnings", F.array_compact(rules))
