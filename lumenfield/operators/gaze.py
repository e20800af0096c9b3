"""Gaze-weighted adaptation luminance and target exposure."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.numeric import c, dot

FLOOR = 1e-8


def subsample(pixels: DataFrame, per_axis: int = 256) -> DataFrame:
    """Systematic sample: every ⌈max(w, h)/N⌉-th pixel starting at half a step. A sampling operator by purpose."""
    n = max(64, min(1024, per_axis))
    step = F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / float(n)).cast("int"))
    start = F.floor(step / 2).cast("int")
    return pixels.filter((F.pmod(F.col("y") - start, step) == 0) & (F.pmod(F.col("x") - start, step) == 0))


def display_direction(y: Column, x: Column, size: tuple[int, int], ppi: float, distance_mm: float) -> list[Column]:
    """Direction in which a picture pixel, fitted to a display of ``size`` pixels, is seen."""
    fit = F.least(F.lit(float(size[0])) / c("width"), F.lit(float(size[1])) / c("height")) * (25.4 / ppi)
    px, py = (x + 0.5 - c("width") * 0.5) * fit, (c("height") * 0.5 - y - 0.5) * fit
    n = F.sqrt(px * px + py * py + distance_mm * distance_mm)
    return [px / n, py / n, F.lit(float(distance_mm)) / n]


def with_angle(pixels: DataFrame, gaze: DataFrame, keys: Sequence[str] = ("image_id",), display: dict | None = None) -> DataFrame:
    """Add ``angle`` (radians) from the gaze pixel ``gaze(keys, gy, gx)``: by direction, or on a physical display."""
    from lumenfield.functions.geometry import equidistant

    keys = list(keys)
    j = pixels.join(gaze, keys)
    if display:
        a = display_direction(c("y"), c("x"), **display)
        b = display_direction(c("gy"), c("gx"), **display)
        names = ("_ax", "_ay", "_az")
    else:
        a = [F.col(k) for k in ("dx", "dy", "dz")]
        g = equidistant("gx", "gy", "width", "height")
        b, names = [g[k] for k in ("dx", "dy", "dz")], ("_ax", "_ay", "_az")
    j = j.withColumns({**dict(zip(names, a)), **dict(zip(("_bx", "_by", "_bz"), b))})
    ang = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(names, ("_bx", "_by", "_bz")))))
    return j.withColumn("angle", ang).drop(*names, "_bx", "_by", "_bz", "gy", "gx")


def _weight(mode: str, sigma_deg: float) -> Column:
    s = max(math.radians(0.1), math.radians(sigma_deg))
    g = F.exp(F.col("angle") * F.col("angle") * (-0.5 / (s * s)))
    return {"uniform": F.lit(1.0), "centre": F.lit(0.15) + g * 0.85, "spot": g}[mode]


def adaptation(samples: DataFrame, mode: str, sigma_deg: float, keys: Sequence[str] = ("image_id",), value: str = "lum", signal: str = "signal") -> DataFrame:
    """Adaptation luminance and signal: logarithmic mean for ``uniform`` and ``centre``, linear mean for the gaze ``spot``."""
    w = _weight(mode, sigma_deg)
    f = (lambda v: F.greatest(F.col(v), F.lit(FLOOR))) if mode == "spot" else (lambda v: F.log(F.greatest(F.col(v), F.lit(FLOOR))))
    g = samples.groupBy(*keys).agg(
        (F.sum(w * f(value)) / F.sum(w)).alias("adaptation_lum"), (F.sum(w * f(signal)) / F.sum(w)).alias("adaptation_signal"), F.sum(w).alias("weight_sum"), F.count("*").alias("n_samples")
    )
    if mode != "spot":
        g = g.withColumns({k: F.exp(k) for k in ("adaptation_lum", "adaptation_signal")})
    return g


def target_exposure(
    samples: DataFrame, adapted: DataFrame, sigma_deg: float, keys: Sequence[str] = ("image_id",), grey: float = 0.18, display_scale: float = 1.0,
    radius_sigmas: float = 1.0, headroom: float = 0.9, mapping: str = "clip",
) -> DataFrame:
    """Exposure in EV that puts the adaptation signal at ``grey``, limited by highlights near the gaze (clip or Reinhard), ±16.

    ``samples`` carries ``signal`` and ``peak``; only one minimum per picture is aggregated.
    """
    keys = list(keys)
    s = max(math.radians(0.1), math.radians(sigma_deg)) * max(0.1, radius_sigmas)
    h = max(0.05, min(0.999, headroom))
    if mapping == "reinhard":
        den = F.col("peak") - F.col("signal") * h
        allowed = F.when(den > FLOOR, F.lit(h) / F.nullif(den, F.lit(0.0)))
    else:
        allowed = F.lit(h) / F.greatest(F.col("peak"), F.lit(FLOOR))
    lim = samples.filter(F.col("angle") <= s).groupBy(*keys).agg(F.min(F.when(allowed > 0, allowed)).alias("_limit"), F.max("peak").alias("highlight_peak"))
    clampev = lambda v: F.greatest(F.lit(-16.0), F.least(F.lit(16.0), v))
    j = adapted.join(lim, keys, "left")
    free = clampev(F.log2(F.lit(max(0.001, min(0.95, grey))) / (F.col("adaptation_signal") * display_scale)))
    cap = F.coalesce(clampev(F.log2(F.col("_limit") / display_scale)), F.lit(16.0))
    return j.withColumns({"free_ev": free, "limit_ev": cap}).withColumn("target_ev", F.least("free_ev", "limit_ev")).drop("_limit")
