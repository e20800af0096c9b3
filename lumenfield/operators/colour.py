"""Colour operators over pixel relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.functions import colour as C
from lumenfield.functions.numeric import Num, c, mat_vec
from lumenfield.operators import ranking as R


def apply_matrix(pixels: DataFrame, m: Sequence[Num], channels: Sequence[str] = C.RGB) -> DataFrame:
    """3 × 3 matrix on every pixel; elements may be numbers or columns of a per-picture profile."""
    return pixels.withColumns(dict(zip(channels, mat_vec(m, channels))))


def scale(pixels: DataFrame, factor: Num, exposure: Num = 1.0, channels: Sequence[str] = C.RGB) -> DataFrame:
    """Global factor, with a declared exposure divided out."""
    return pixels.withColumns({ch: F.col(ch) * c(factor) / c(exposure) for ch in channels})


def white_balance(pixels: DataFrame, factors: Sequence[Num], channels: Sequence[str] = C.RGB) -> DataFrame:
    return pixels.withColumns({ch: F.col(ch) * c(f) for ch, f in zip(channels, factors)})


def white_balance_patch(pixels: DataFrame, x0: int, y0: int, w: int, h: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Balance on a grey patch: reciprocal channel sums, scaled to mean 1."""
    from lumenfield.operators.regions import rect

    keys = list(keys)
    s = rect(pixels, x0, y0, w, h).groupBy(*keys).agg(*[(F.lit(1.0) / F.sum(ch)).alias(f"_{ch}") for ch in C.RGB])
    total = F.col("_r") + F.col("_g") + F.col("_b")
    s = s.select(*keys, *[(F.col(f"_{ch}") * 3.0 / total).alias(f"_{ch}") for ch in C.RGB])
    return white_balance(pixels.join(s, keys), ["_r", "_g", "_b"]).drop("_r", "_g", "_b")


def monochrome(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """True where all pixels of a picture have R = G = B."""
    return pixels.groupBy(*keys).agg(F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("monochrome"))


def display_range(pixels: DataFrame, value: str = "lum", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Display limits: 1st to 99th percentile of non-zero values, at most four decades."""
    p = R.percentiles(pixels.filter(F.col(value) != 0), keys, value, {"lo": ("linear", 0.01), "hi": ("linear", 0.99)})
    return p.withColumn("lo", F.greatest("lo", F.col("hi") / 1e4))


def tone_preview(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """8-bit preview: the 90th percentile of positive luminance goes to 0.8, then x/(1+x) and display encoding."""
    keys = list(keys)
    # Luminance row of the preview.
    lum = F.lit(0.2126) * F.col("r") + F.lit(0.7152) * F.col("g") + F.lit(0.0722) * F.col("b")
    p = R.percentiles(pixels.withColumn("_l", lum).filter("_l > 1e-8"), keys, "_l", {"_ref": ("linear", 0.9)}).select(*keys, "_ref")
    d = pixels.join(p, keys, "left").withColumns({f"_s{ch}": F.greatest(F.col(ch), F.lit(0.0)) * 0.8 / F.greatest("_ref", F.lit(1e-8)) for ch in C.RGB})
    d = d.withColumns({f"_m{ch}": F.col(f"_s{ch}") / (F.col(f"_s{ch}") + 1.0) for ch in C.RGB})
    out = {f"{ch}8": F.coalesce(F.rint(C.srgb_encode(F.col(f"_m{ch}")) * 255.0).cast("int"), F.lit(0)) for ch in C.RGB}
    return d.withColumns(out).drop("_ref", *[f"_{k}{ch}" for k in "sm" for ch in C.RGB])
