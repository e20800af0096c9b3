"""Neighbourhood operators.

Pixels are copied into the square tiles whose halo they touch and shuffled once by (picture, tile). Row windows and column windows
then run inside that partitioning, so a separable filter costs one exchange and no partition holds more than
(tile + 2·halo)² pixels of a picture. Rows are counted before they are dealt, so that a partition's rows do not grow with the archive.
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


from lumenfield.session import cut_lineage, parts_for

TILE = 64
KEYS = ("image_id",)


def _mirror(v: Column, size: Column, edge: str) -> Column:
    """Index of the pixel that stands at ``v`` outside the frame: reflected (edge repeated) or replicated."""
    if edge == "replicate":
        return F.greatest(F.lit(0), F.least(size - 1, v))
    m = F.pmod(v, size * 2)
    return F.when(m < size, m).otherwise(size * 2 - 1 - m)


def _axis_copies(axis: str, size: str, before: int, after: int, edge: str) -> Column:
    """Positions a pixel takes along one axis: itself, and its images beyond both ends of the frame."""
    n, p = F.col(size), F.col(axis)
    own = F.array(p)
    if edge == "clip":
        return own
    out = F.filter(F.sequence(F.lit(-before), n - 1 + after), lambda v: ((v < 0) | (v >= n)) & (_mirror(v, n, edge) == p))
    near = (p < before) | (p >= n - after) | (F.lit(max(before, after)) >= n)
    return F.when(near, F.concat(own, out)).otherwise(own)


def tiles(df: DataFrame, halo: tuple[int, int], keys: Sequence[str] = KEYS, edge: str = "clip", tile: int = TILE) -> DataFrame:
    """Rows with ``_ty, _tx`` (tile) and ``_py, _px`` (position, possibly outside the frame), partitioned by tile.

    ``halo`` = (before, after). ``edge``: clip (no rows outside), reflect or replicate.
    """
    b, a = halo
    tile = max(tile, 2 * (a + b))
    d = df
    if edge != "clip":
        d = d.withColumn("_py", F.explode_outer(_axis_copies("y", "height", b, a, edge)))
        d = d.withColumn("_px", F.explode_outer(_axis_copies("x", "width", b, a, edge)))
    else:
        d = d.withColumns({"_py": F.col("y"), "_px": F.col("x")})

    def reach(p: str, size: str) -> Column:
        # tiles t with t·tile − before ≤ p < (t+1)·tile + after
        lo = F.greatest(F.lit(0), F.floor((F.col(p) - a) / F.lit(float(tile))).cast("int"))
        hi = F.least(F.floor((F.col(size) - 1) / F.lit(float(tile))).cast("int"), F.floor((F.col(p) + b) / F.lit(float(tile))).cast("int"))
        return F.sequence(lo, hi)

    # the lists are never empty; the outer form saves Spark from building them once more to test that
    d = d.withColumn("_ty", F.explode_outer(reach("_py", "height"))).withColumn("_tx", F.explode_outer(reach("_px", "width")))
    parts = parts_for(df.sparkSession, df.count())
    return d.withColumn("_tile", F.lit(tile)).repartition(parts, *[F.col(k) for k in keys], F.col("_ty"), F.col("_tx"))


def core(df: DataFrame) -> DataFrame:
    """Only the tile's own pixels."""
    t = F.col("_tile")
    own = (
        (F.col("_py") == F.col("y")) & (F.col("_px") == F.col("x"))
        & (F.floor(F.col("y") / t).cast("int") == F.col("_ty")) & (F.floor(F.col("x") / t).cast("int") == F.col("_tx"))
    )
    return df.filter(own).drop("_ty", "_tx", "_py", "_px", "_tile")


def row_window(halo: tuple[int, int], keys: Sequence[str] = KEYS):
    return W.partitionBy(*keys, "_ty", "_tx", "_py").orderBy("_px").rangeBetween(-halo[0], halo[1])


def column_window(halo: tuple[int, int], keys: Sequence[str] = KEYS):
    return W.partitionBy(*keys, "_ty", "_tx", "_px").orderBy("_py").rangeBetween(-halo[0], halo[1])


def separable(
    df: DataFrame, rows: dict[str, Column], cols: dict[str, Column], halo: tuple[int, int], keys: Sequence[str] = KEYS, edge: str = "clip"
) -> DataFrame:
    """Aggregate ``rows`` along each row window, then ``cols`` along each column window."""
    t = tiles(df, halo, keys, edge)
    rw, cw = row_window(halo, keys), column_window(halo, keys)
    t = t.withColumns({k: e.over(rw) for k, e in rows.items()})
    t = t.withColumns({k: e.over(cw) for k, e in cols.items()})
    out = core(t)
    return out.drop(*[k for k in rows if k not in cols])


def _halo(size: int) -> tuple[int, int]:
    """Even sizes reach one pixel further back than forward."""
    return size // 2, size - 1 - size // 2


def box_mean(df: DataFrame, value: str, size: int, name: str = "mean", edge: str = "reflect", keys: Sequence[str] = KEYS) -> DataFrame:
    h = _halo(size)
    return separable(
        df, {"_s": F.sum(value), "_n": F.count(value)}, {"_s2": F.sum("_s"), "_n2": F.sum("_n")}, h, keys, edge
    ).withColumn(name, F.col("_s2") / F.col("_n2")).drop("_s2", "_n2")


def box_max(df: DataFrame, value: str, size: int, name: str = "peak", keys: Sequence[str] = KEYS) -> DataFrame:
    h = _halo(size)
    return separable(df, {"_m": F.max(value)}, {name: F.max("_m")}, h, keys)


def local_mean(df: DataFrame, value: str, radius: int, name: str = "local", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over a box clipped to the frame."""
    return box_mean(df, value, 2 * radius + 1, name, "clip", keys)


def contrast_proxy(df: DataFrame, ppd: float, sensitivity: float, value: str = "lum", keys: Sequence[str] = KEYS) -> DataFrame:
    """max(0, |log10 L − log10 local mean| − 10^(s−2)); the box follows the pixels per degree."""
    radius = max(1, min(12, math.floor(max(1.0, ppd) / 24.0 + 0.5)))
    floor = 1e-6
    d = local_mean(df, value, radius, "_local", keys)
    diff = F.abs(F.log10(F.greatest(F.col(value), F.lit(floor))) - F.log10(F.greatest(F.col("_local"), F.lit(floor))))
    return d.withColumn("contrast", F.greatest(F.lit(0.0), diff - 10.0 ** (sensitivity - 2.0))).drop("_local")


def box_sum3(df: DataFrame, value: str, name: str = "mean3", keys: Sequence[str] = KEYS) -> DataFrame:
    """3 × 3 mean with zeros outside the frame: sum over nine, whatever is missing."""
    return separable(df, {"_s": F.sum(value)}, {"_s2": F.sum("_s")}, (1, 1), keys).withColumn(name, F.col("_s2") / 9.0).drop("_s2")


def power_pool(df: DataFrame, value: str, size: int, norm: float, name: str = "pooled", keys: Sequence[str] = KEYS) -> DataFrame:
    """(Σ max(v, 0)^p / size²)^(1/p) with p = 10^norm; pixels outside the frame count as zero."""
    p = 10.0**norm
    r = size // 2
    d = df.withColumn("_p", F.pow(F.greatest(F.col(value), F.lit(0.0)), F.lit(p)))
    d = separable(d, {"_s": F.sum("_p")}, {"_s2": F.sum("_s")}, (r, r), keys)
    return d.withColumn(name, F.pow(F.col("_s2") / float(size * size), F.lit(1.0 / p))).drop("_p", "_s2")


def gaussian_kernel(sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian(
    df: DataFrame, value: str, sigma: float, name: str = "blur", edge: str = "reflect", keys: Sequence[str] = KEYS, radius: int | None = None
) -> DataFrame:
    """Gaussian blur with radius ⌈8σ⌉: one exchange into haloed tiles, then an Arrow batch of two dense 1-D passes per tile.

    Missing pixels take no weight: the sums are divided by the weight that is present.
    """
    r = radius if radius is not None else math.ceil(8.0 * sigma)
    k = gaussian_kernel(sigma, r)
    t = tiles(df, (r, r), keys, edge)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    names = df.columns

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx, size = int(pdf["_ty"].iloc[0]), int(pdf["_tx"].iloc[0]), int(pdf["_tile"].iloc[0])
        n = size + 2 * r
        iy, ix = (pdf["_py"] - ty * size + r).to_numpy(), (pdf["_px"] - tx * size + r).to_numpy()
        img, wt = np.zeros((n, n)), np.zeros((n, n))
        img[iy, ix], wt[iy, ix] = pdf[value].to_numpy(), 1.0
        for axis in (0, 1):
            img = np.apply_along_axis(np.convolve, axis, img, k, "same")
            wt = np.apply_along_axis(np.convolve, axis, wt, k, "same")
        own = (pdf["_py"] == pdf["y"]) & (pdf["_px"] == pdf["x"]) & (pdf["y"] // size == ty) & (pdf["x"] // size == tx)
        out = pdf.loc[own, names].copy()
        jy, jx = iy[own.to_numpy()], ix[own.to_numpy()]
        out[name] = img[jy, jx] / wt[jy, jx]
        return out

    return t.groupBy(*keys, "_ty", "_tx").applyInPandas(blur, schema)


def local_adaptation(df: DataFrame, ppd: float, value: str = "lum", name: str = "adapt", keys: Sequence[str] = KEYS) -> DataFrame:
    """exp of the blurred ln L; σ = 10^-0.781367 · ppd, at least 0.6, replicated edges, summed out to 8σ at every σ."""
    sigma = max(0.6, 10.0**-0.781367 * ppd)
    d = df.withColumn("_ln", F.log(F.greatest(F.col(value), F.lit(1e-6))))
    return gaussian(d, "_ln", sigma, "_g", "replicate", keys, radius=math.ceil(8.0 * sigma)).withColumn(name, F.exp("_g")).drop("_ln", "_g")


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, radius: int, name: str = "smooth") -> DataFrame:
    """Centred moving average of a 1-D profile, clipped at both ends."""
    return df.withColumn(name, F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-radius, radius)))


def relax(df: DataFrame, channels: Sequence[str], hole: Column, sweeps: int = 160, keys: Sequence[str] = KEYS, per_round: int = 20) -> DataFrame:
    """Fill pixels where ``hole`` holds by repeated weighted means of the eight neighbours (diagonals 1/√2), all from the previous sweep.

    A tile with a halo of ``per_round`` pixels can run that many sweeps on its own, so 160 sweeps need eight exchanges instead of 160. Only tiles with holes
    take part, and of the rest of the archive only their neighbours, picked before any exchange. From the second round on, only tiles go on in which, or next to
    which, the last round changed a pixel. State is saved reliably after every round.
    """
    keys, channels = list(keys), list(channels)
    state = df.withColumn("_hole", hole)
    tile = max(TILE, 4 * per_round)
    at = {"_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int")}
    where = [*keys, "_ty", "_tx"]

    def around(t: DataFrame) -> DataFrame:
        near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
        return t.withColumn("_ty", near("_ty")).withColumn("_tx", near("_tx")).distinct()

    # distinct tiles with holes: at most one row per tile of the archive
    busy = cut_lineage(state.filter("_hole").withColumns(at).select(*where).distinct())
    cols = [*keys, "y", "x", "width", "height", "_hole", *channels]
    small = state.select(*cols)
    reached = cut_lineage(small.withColumns(at).join(around(busy), where, "left_semi"))
    rest, work = (reached.join(busy, where, how).drop("_ty", "_tx") for how in ("left_anti", "left_semi"))
    schema = T.StructType([small.schema[k] for k in cols]).add("_moved", "boolean")
    steps = [(dy, dx, 1.0 if dy == 0 or dx == 0 else math.sqrt(0.5)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]

    def run(count: int):
        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            ty, tx, size = int(pdf["_ty"].iloc[0]), int(pdf["_tx"].iloc[0]), int(pdf["_tile"].iloc[0])
            n = size + 2 * per_round + 2
            iy, ix = (pdf["y"] - ty * size + per_round + 1).to_numpy(), (pdf["x"] - tx * size + per_round + 1).to_numpy()
            has, hol = np.zeros((n, n)), np.zeros((n, n), bool)
            has[iy, ix], hol[iy, ix] = 1.0, pdf["_hole"].to_numpy()
            shift = lambda m, dy, dx: np.roll(m, (-dy, -dx), (0, 1))
            weight = sum(shift(has, dy, dx) * w for dy, dx, w in steps)
            out = pdf.copy()
            moved = np.zeros((n, n), bool)
            for ch in channels:
                m = np.zeros((n, n))
                m[iy, ix] = pdf[ch].to_numpy()
                ok = hol & (weight > 0)
                for _ in range(count):
                    m = np.where(ok, sum(shift(m, dy, dx) * w for dy, dx, w in steps) / np.where(weight > 0, weight, 1.0), m)
                moved[iy, ix] |= m[iy, ix] != out[ch].to_numpy()
                out[ch] = m[iy, ix]
            out["_moved"] = moved[iy, ix]
            own = (pdf["y"] // size == ty) & (pdf["x"] // size == tx)
            return out.loc[own, [*cols, "_moved"]]

        return fill

    done, active = 0, busy
    while done < sweeps:
        count = min(per_round, sweeps - done)
        halo = work.unionByName(rest).withColumns(at).join(around(active), where, "left_semi").drop("_ty", "_tx")
        swept = tiles(halo, (per_round, per_round), keys, tile=tile).join(active, where, "left_semi").groupBy(*where).applyInPandas(run(count), schema)
        if done:
            still = work.withColumns(at).join(active, where, "left_anti").drop("_ty", "_tx").withColumn("_moved", F.lit(False))
            swept = swept.unionByName(still)
        swept = cut_lineage(swept)
        work = swept.drop("_moved")
        done += count
        moved = swept.filter("_moved").withColumns(at).select(*where).distinct()
        active = cut_lineage(around(moved).join(busy, where, "left_semi"))
        if active.isEmpty():
            break
    filled = work.filter("_hole").select(*keys, "y", "x", *[F.col(ch).alias(f"_f_{ch}") for ch in channels])
    out = state.join(filled, [*keys, "y", "x"], "left")
    return out.withColumns({ch: F.coalesce(f"_f_{ch}", ch) for ch in channels}).select(*df.columns)
