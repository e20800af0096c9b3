"""Region predicates and mask set operations. A mask is a sparse relation: only non-zero rows are stored."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.geometry import View, equidistant
from lumenfield.functions.numeric import c, dot, weighted_mean

PX = ("image_id", "y", "x")


def rect(df: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """Rectangle from the top left; parts outside the picture hold no rows."""
    return df.filter(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))


def circle(df: DataFrame, centres: DataFrame, degrees: float, keys: Sequence[str] = ("image_id",), view: View = View()) -> DataFrame:
    """Pixels within ``degrees`` of the direction of each picture's centre pixel ``centres(keys, cy, cx)``.

    Only the centres (one row per picture) are joined: their direction is a formula of the frame size. The angle test compares
    cosines, so no acos is evaluated per pixel. Centres outside the view give no rows.
    """
    j = df.filter("valid").join(centres.select(*keys, "cy", "cx"), list(keys))
    g = equidistant("cx", "cy", "width", "height", view)
    j = j.withColumns({"_mx": g["dx"], "_my": g["dy"], "_mz": g["dz"], "_in": g["valid"]})
    near = dot(("dx", "dy", "dz"), ("_mx", "_my", "_mz")) >= math.cos(math.radians(degrees))
    return j.filter(F.col("_in") & near).drop("_mx", "_my", "_mz", "_in", "cy", "cx")


def circle_at(df: DataFrame, direction: tuple[float, float, float], degrees: float) -> DataFrame:
    """Pixels within ``degrees`` of one fixed direction: a plain filter."""
    return df.filter(F.col("valid") & (dot(("dx", "dy", "dz"), direction) >= math.cos(math.radians(degrees))))


def in_mask(df: DataFrame, masks: DataFrame, keys: Sequence[str] = PX) -> DataFrame:
    """Selection mask: left semi join on the pixel key."""
    return df.join(masks.select(*keys), list(keys), "left_semi")


def inside_circle_only(df: DataFrame) -> DataFrame:
    return df.filter("omega > 0")


def left_eye(df: DataFrame, drop_corners: bool = True) -> DataFrame:
    """Side-by-side frames (width = 2 × height) keep the left half; fisheye corners are left out."""
    side = F.col("width") == F.col("height") * 2
    out = df.filter(~side | (F.col("x") < F.col("height"))).withColumn("width", F.when(side, F.col("height")).otherwise(F.col("width")))
    if drop_corners:
        rx, ry = c("x") - (c("width") - 1.0) * 0.5, c("y") - (c("height") - 1.0) * 0.5
        r = (F.least("width", "height") - 1.0) * 0.5
        out = out.filter((F.col("width") != F.col("height")) | (rx * rx + ry * ry <= r * r))
    return out


def band(df: DataFrame, radians: float, view: View = View()) -> DataFrame:
    """Horizontal band: pixels within ``radians`` of the middle row's direction in the same column.

    The middle row's direction is a formula of the column, so nothing is joined; the angle is compared as a cosine.
    """
    mid = F.floor(F.col("height") / 2).cast("int")
    g = equidistant("x", mid, "width", "height", view)
    j = df.filter("valid").withColumns({"_mx": g["dx"], "_my": g["dy"], "_mz": g["dz"]})
    near = (dot(("dx", "dy", "dz"), ("_mx", "_my", "_mz")) >= math.cos(radians)) | (F.col("y") == mid)
    return j.filter(near).drop("_mx", "_my", "_mz")


def zone(direction: tuple[float, float, float], inner: float, outer: float | None = None) -> Column:
    """1 inside ``inner``, 2 between ``inner`` and ``outer``, else 0; an angle limit a means 2·acos(d) ≤ a."""
    d = dot(("dx", "dy", "dz"), direction)
    e = F.when(d >= math.cos(inner / 2.0), F.lit(1))
    if outer is not None:
        e = e.when(d >= math.cos(outer / 2.0), F.lit(2))
    return e.otherwise(F.lit(0))


def in_task(direction: tuple[float, float, float], opening: float) -> Column:
    return dot(("dx", "dy", "dz"), direction) >= math.cos(opening / 2.0)


def task_luminance(df: DataFrame, direction: tuple[float, float, float], opening: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    t = df.filter(F.col("valid") & in_task(direction, opening))
    return t.groupBy(*keys).agg(weighted_mean("lum", "omega").alias("task_lum"), F.count("*").alias("task_px"))


def luminance_mask(df: DataFrame, masks: DataFrame, limit: float = 0.1) -> DataFrame:
    """Masked pixels whose mask value exceeds ``limit``."""
    m = masks.filter(F.col("weight") > limit).select(*PX)
    return df.join(m, list(PX))


def white_mask(df: DataFrame) -> DataFrame:
    """Implicit mask of weight 1 over the reference grid."""
    return df.select(*PX, F.lit(1.0).alias("weight"))


def mask_union(candidates: DataFrame, keys: Sequence[str] = ("image_id",), min_score: float = 0.5, policy: str = "all") -> DataFrame:
    """Union of candidate masks ``(keys, kind, score, y, x)``.

    ``all`` joins semantic and instance candidates; ``instances_first`` uses instances of at least ``min_score`` where a
    picture has any, else its semantic candidates.
    """
    keys = list(keys)
    semantic = candidates.filter("kind = 'semantic'")
    instances = candidates.filter("kind = 'instance'")
    if policy == "instances_first":
        instances = instances.filter(F.col("score") >= min_score)
        has = instances.select(*keys).distinct()
        semantic = semantic.join(has, keys, "left_anti")
    return semantic.select(*keys, "y", "x").unionByName(instances.select(*keys, "y", "x")).distinct()


def drop_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str] = PX) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels claimed by both categories are ambiguous and leave both: (a only, b only, overlap)."""
    keys = list(keys)
    a, b = a.select(*keys), b.select(*keys)
    return a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti"), a.intersect(b)


def unique_masks(candidates: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Keep one candidate per distinct pixel set: instance before semantic, then the higher score.

    Content is compared by order-free 64-bit sums of two independent pixel hashes plus the pixel count, which combine on the map
    side; no pixel list is collected. Candidates are ``(keys, mask_id, kind, score, y, x)``.
    """
    keys = list(keys)
    h1, h2 = F.xxhash64("y", "x"), F.xxhash64("x", F.lit(7), "y")
    sig = candidates.groupBy(*keys, "mask_id", "kind", "score").agg(
        F.count("*").alias("n_px"),
        F.sum(F.shiftright(h1, 16)).alias("_s1"),
        F.sum(F.shiftright(h2, 16)).alias("_s2"),
        F.bit_xor(h1).alias("_s3"),
    )
    best = F.min_by(
        F.struct("mask_id", "kind", "score"),
        F.struct((F.col("kind") != "instance").cast("int"), (-F.col("score")).alias("s"), F.col("mask_id")),
    )
    return sig.groupBy(*keys, "n_px", "_s1", "_s2", "_s3").agg(best.alias("m")).select(*keys, "m.*", "n_px")


def iou(a: DataFrame, b: DataFrame, by: Sequence[str] = ("image_id",), keys: Sequence[str] = PX) -> DataFrame:
    """Intersection, union and IoU per group; NULL for an empty union."""
    both = a.select(*keys, F.lit(1).alias("_a")).unionByName(b.select(*keys, F.lit(2).alias("_a")))
    px = both.groupBy(*keys).agg(F.sum("_a").alias("s"))
    r = px.groupBy(*by).agg(F.count_if(F.col("s") == 3).alias("n_both"), F.count("*").alias("n_any"))
    return r.withColumn("iou", F.col("n_both") / F.nullif(F.col("n_any"), F.lit(0)))


def bounding_box(df: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n_px")
    )
