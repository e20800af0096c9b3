"""Gathers and resampling in tiles against plain loops over whole frames of several sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import geometry as OG
from lumenfield.operators import sunmerge as M


def frames(spark, sizes):
    out = None
    for i, (w, h) in enumerate(sizes):
        px = spark.range(w * h).select(F.lit(i).cast("long").alias("image_id"), F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"), F.lit(w).alias("width"), F.lit(h).alias("height"))
        out = px if out is None else out.unionByName(px)
    return out.withColumn("g", F.pmod(F.xxhash64("image_id", "y", "x"), F.lit(1000)) * 1.0)


def rasters(df, sizes):
    pdf = df.toPandas()
    out = {}
    for i, (w, h) in enumerate(sizes):
        a, p = np.full((h, w), np.nan), pdf[pdf.image_id == i]
        assert len(p) == w * h and set(p.width) == {w} and set(p.height) == {h}
        a[p.y, p.x] = p.g
        out[i] = a
    return out


def bilinear(a, sx, sy):
    h, w = a.shape
    x0, y0 = math.floor(sx), math.floor(sy)
    tx, ty = sx - x0, sy - y0
    x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
    return (a[y0, x0] * (1 - tx) + a[y0, x1] * tx) * (1 - ty) + (a[y1, x0] * (1 - tx) + a[y1, x1] * tx) * ty


@pytest.mark.parametrize("degrees", [0, 33, 180, -90.5])
def test_rotation_of_frames_of_several_sizes(spark, degrees):
    sizes = [(150, 70), (64, 64), (7, 90), (150, 70)]
    p = frames(spark, sizes)
    src, got = rasters(p, sizes), rasters(OG.rotate(p, degrees, ("g",)), sizes)
    ca, sa = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    for i, (w, h) in enumerate(sizes):
        cx, cy = (w - 1) / 2, (h - 1) / 2
        want = np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                sx, sy = (x - cx) * ca - (y - cy) * sa + cx, (x - cx) * sa + (y - cy) * ca + cy
                if 0 <= sx <= w - 1 and 0 <= sy <= h - 1:
                    want[y, x] = bilinear(src[i], sx, sy)
        # at whole coordinates rounding decides on which side of the border a pixel falls
        near = np.abs(got[i] - want) < 1e-6
        assert near.all() if degrees in (0, 33) else near.mean() > 0.97


@pytest.mark.parametrize("kind", ["equisolid", "hemispherical"])
def test_reprojection(spark, kind):
    sizes = [(130, 130), (65, 65)]
    p = frames(spark, sizes)
    src, got = rasters(p, sizes), rasters(OG.reproject(p, kind, ("g",)), sizes)
    for i, (n, _) in enumerate(sizes):
        want = np.zeros((n, n))
        for y in range(n):
            for x in range(n):
                dx, dy = (x + 0.5) / n - 0.5, (y + 0.5) / n - 0.5
                r = math.hypot(dx, dy)
                if r <= 0.5:
                    s = (math.sin(r * math.pi / 2) / math.sqrt(2) if kind == "equisolid" else math.sin(r * math.pi) / 2) / r if r > 1e-12 else 1.0
                    clip = lambda v: min(max(v, 0.0), n - 1.0)
                    want[y, x] = bilinear(src[i], clip((dx * s + 0.5) * n - 0.5), clip((dy * s + 0.5) * n - 0.5))
        assert np.allclose(got[i], want, atol=1e-6)


def kernel(kind, d):
    if kind == "tent":
        return max(0.0, 1 - abs(d))
    return 0.0 if abs(d) > 3 else 1.0 if abs(d) < 1e-9 else math.sin(math.pi * d) / (math.pi * d) * math.sin(math.pi * d / 3) / (math.pi * d / 3)


@pytest.mark.parametrize(("kind", "target"), [("tent", (40, 100)), ("lanczos", (40, 100)), ("lanczos", (200, 9)), ("tent", (1, 1))])
def test_resampling(spark, kind, target):
    sizes = [(150, 70), (33, 200), (1, 5)]
    p = frames(spark, sizes)
    src, got = rasters(p, sizes), rasters(OG.resample(p, target, kind, ("g",)), [target] * len(sizes))
    radius = {"tent": 1, "lanczos": 3}[kind]

    def matrix(n, m):
        out, stretch = np.zeros((m, n)), max(1.0, n / m)
        for t in range(m):
            c = (t + 0.5) / m * n
            first, many = math.floor(c - radius * stretch + 0.5), math.floor(2 * radius * stretch)
            for s in range(first, first + many):
                out[t, min(max(s, 0), n - 1)] += kernel(kind, (s + 0.5 - c) / stretch)
        return out / out.sum(axis=1, keepdims=True)

    for i, (w, h) in enumerate(sizes):
        want = matrix(h, target[1]) @ src[i] @ matrix(w, target[0]).T
        assert np.allclose(got[i], want, atol=1e-6)


def test_one_exchange_of_pixels(spark):
    p = frames(spark, [(70, 70)])
    for df in (OG.rotate(p, 20, ("g",)), OG.reproject(p, "equisolid", ("g",)), OG.resample(p, (30, 30), "lanczos", ("g",))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_few_ring_pixels_reach_a_tile(spark):
    """A ring of some 100 000 pixels: a tile gets those of near cells only, and the nearest ones are among them."""
    n = 600
    p = OG.with_geometry(frames(spark, [(n, n)])).withColumns({"valid": F.lit(True), "r": F.col("g"), "b": F.col("g")})
    far = F.sqrt(F.pow(F.col("x") - 300.0, 2) + F.pow(F.col("y") - 300.0, 2))
    p = p.withColumn("near", F.when(far < 60, 0.9).when((far > 100) & (far < 220), 0.3).otherwise(0.0))
    ring, goal = p.where("near = 0.3"), p.where("near = 0.9").withColumns({"_ty": F.floor(F.col("y") / 32).cast("int"), "_tx": F.floor(F.col("x") / 32).cast("int")})
    cell = F.struct(*[F.floor(F.col(d) / 0.02).cast("int").alias(d) for d in M.D])
    ring = ring.withColumn("_cell", cell)
    where = ["image_id", "_ty", "_tx"]
    cells = M._near_cells(M._box(goal, where, "t"), M._box(ring, ["image_id", "_cell"], "c"), ["image_id"], where, 300)
    sent = ring.join(cells, ["image_id", "_cell"]).groupBy(*where).count().toPandas()
    assert len(sent) >= 16 and ring.count() > 100_000 and sent["count"].max() < 0.3 * ring.count() and sent["count"].mean() < 0.1 * ring.count()
    seeds = ring.select("y", "x", *M.D).toPandas()
    got = {(r._ty, r._tx): r.c for r in cells.groupBy("_ty", "_tx").agg(F.collect_set("_cell").alias("c")).collect()}
    for r in goal.orderBy(F.xxhash64("y", "x")).limit(20).collect():
        d2 = ((seeds[["dx", "dy", "dz"]].to_numpy() - np.array([r.dx, r.dy, r.dz])) ** 2).sum(axis=1)
        for i in np.argsort(d2)[:300]:
            assert tuple(np.floor(seeds.loc[i, ["dx", "dy", "dz"]].to_numpy(float) / 0.02).astype(int)) in {tuple(c) for c in got[r._ty, r._tx]}
