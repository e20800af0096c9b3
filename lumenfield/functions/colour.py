"""Colour formulas over Columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.numeric import Num, c, dot, mat_inverse, mat_mul, mat_vec

# Lumens per watt of equal-energy white, luminance rows and RGB → XYZ matrices that results depend on.
EFFICACY = 179.0
RADIANCE_WEIGHTS = (0.265, 0.670, 0.065)
RAD_TO_XYZ = (
    0.51408315, 0.32388874, 0.16202811,
    0.26507413, 0.67011463, 0.06481124,
    0.02409765, 0.12285435, 0.85334803,
)
SRGB_TO_XYZ = (
    0.4124564, 0.3575761, 0.1804375,
    0.2126729, 0.7151522, 0.0721750,
    0.0193339, 0.1191920, 0.9503041,
)
RAD_PRIMARIES = (0.640, 0.330, 0.290, 0.600, 0.150, 0.060, 0.3333, 0.3333)
SRGB_PRIMARIES = (0.6400, 0.3300, 0.3000, 0.6000, 0.1500, 0.0600, 0.3127, 0.3290)

RGB = ("r", "g", "b")


def luminance(
    rgb: Sequence[Num] = RGB,
    weights: Sequence[Num] = RADIANCE_WEIGHTS,
    exposure: Num = 1.0,
    efficacy: Num = EFFICACY,
    monochrome: Column | None = None,
) -> Column:
    """Luminance in cd/m². ``exposure`` is the product of the header's EXPOSURE lines and is divided out;
    a picture already in cd/m² takes ``efficacy`` 1. Monochrome pictures read the green channel."""
    v = dot(weights, rgb)
    if monochrome is not None:
        v = F.when(monochrome, c(rgb[1])).otherwise(v)
    return v * c(efficacy) / c(exposure)


def to_xyz(kind: Num, rgb: Sequence[Num] = RGB, exposure: Num = 1.0) -> list[Column]:
    """XYZ in cd/m² from ``rad``, ``srgb``, ``xyz`` (all W·sr⁻¹·m⁻²) or ``xyz_cdm2`` channels; ``kind`` may be a column."""
    kind = c(kind)
    scale = F.when(kind == "xyz_cdm2", F.lit(1.0)).otherwise(F.lit(EFFICACY)) / c(exposure)
    v = [c(ch) * scale for ch in rgb]
    srgb, rad = mat_vec(SRGB_TO_XYZ, v), mat_vec(RAD_TO_XYZ, v)
    return [
        F.when(kind.isin("xyz", "xyz_cdm2"), v[i]).when(kind == "srgb", srgb[i]).otherwise(rad[i]) for i in range(3)
    ]


def _denominator(v: Column) -> Column:
    return F.when(F.abs(v) < 1e-20, F.lit(1.0)).otherwise(v)


def xyz_to_xy(xyz: Sequence[Num]) -> list[Column]:
    x, y, z = (c(v) for v in xyz)
    d = _denominator(x + y + z)
    return [x / d, y / d]


def xyz_to_yuv(xyz: Sequence[Num]) -> list[Column]:
    """Y, u', v'."""
    x, y, z = (c(v) for v in xyz)
    d = _denominator(x + F.lit(15.0) * y + F.lit(3.0) * z)
    return [y, F.lit(4.0) * x / d, F.lit(9.0) * y / d]


def xyz_to_lab(xyz: Sequence[Num], white: Sequence[Num]) -> list[Column]:
    # The two constants of the CIE L*a*b* definition.
    eps, kappa = 216.0 / 24389.0, 24389.0 / 27.0
    f = []
    for v, w in zip(xyz, white):
        q = c(v) / c(w)
        f.append(F.when(q > eps, F.cbrt(q)).otherwise((F.lit(kappa) * q + 16.0) / F.lit(116.0)))
    return [F.lit(116.0) * f[1] - 16.0, F.lit(500.0) * (f[0] - f[1]), F.lit(200.0) * (f[1] - f[2])]


def primaries_to_xyz(p: Sequence[Num]) -> list[Column]:
    """RGB → XYZ matrix (row-major) from eight chromaticities rx ry gx gy bx by wx wy."""
    rx, ry, gx, gy, bx, by, wx, wy = (c(v) for v in p)
    one = F.lit(1.0)
    m = [rx, gx, bx, ry, gy, by, one - rx - ry, one - gx - gy, one - bx - by]
    wy = F.when(wy > 0, wy)
    scale = mat_vec(mat_inverse(m), [wx / wy, one, (one - wx - wy) / wy])
    return [m[3 * i + j] * scale[j] for i in range(3) for j in range(3)]


def primaries_to_weights(p: Sequence[Num]) -> list[Column]:
    """Luminance weights of a primary set; NULL when the set is degenerate or no weight is positive."""
    w = primaries_to_xyz(p)[3:6]
    usable = (w[0] > 0) | (w[1] > 0) | (w[2] > 0)
    return [F.when(usable, v) for v in w]


def _fixed_primaries(p: Sequence[float]) -> np.ndarray:
    m = np.array([[p[0], p[2], p[4]], [p[1], p[3], p[5]], [1 - p[0] - p[1], 1 - p[2] - p[3], 1 - p[4] - p[5]]])
    return m * np.linalg.solve(m, np.array([p[6] / p[7], 1.0, (1 - p[6] - p[7]) / p[7]]))


def with_camera_matrices(
    profiles: DataFrame, xyz_cam: Sequence[Num], target: str, cscale: Sequence[Num] = (1.0, 1.0, 1.0)
) -> DataFrame:
    """Add the camera → target matrix ``k0…k8``, luminance row ``l0…l2`` and white-saturation hint ``w0…w2`` per profile row.

    ``xyz_cam`` maps XYZ to camera channels (row-major). ``raw`` keeps camera channels and has no luminance row.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    df = profiles.withColumns({f"_c{i}": c(v) for i, v in enumerate(xyz_cam)})
    if target == "raw":
        m, lum, white = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], [F.lit(None).cast("double")] * 3, [one] * 3
    elif target == "xyz":
        m, lum, white = mat_inverse([f"_c{i}" for i in range(9)]), [zero, one, zero], [one] * 3
    else:
        to = _fixed_primaries(RAD_PRIMARIES if target == "rad" else SRGB_PRIMARIES)
        cam = mat_mul([f"_c{i}" for i in range(9)], [float(v) for v in to.ravel()])
        df = df.withColumns({f"_d{i}": v for i, v in enumerate(cam)})
        m, lum = mat_inverse([f"_d{i}" for i in range(9)]), [F.lit(float(v)) for v in to[1]]
        sums = [c(f"_d{3 * i}") + c(f"_d{3 * i + 1}") + c(f"_d{3 * i + 2}") for i in range(3)]
        top = F.greatest(*sums)
        white = [F.when(top > 0, s / top).otherwise(one) for s in sums]
    out = {f"k{i}": c(cscale[i // 3]) * v for i, v in enumerate(m)}
    out.update({f"l{i}": v for i, v in enumerate(lum)})
    out.update({f"w{i}": v for i, v in enumerate(white)})
    return df.withColumns(out).drop(*[f"_{p}{i}" for p in "cd" for i in range(9)])


def scotopic_from_xyz(xyz: Sequence[Num]) -> Column:
    x = F.greatest(c(xyz[0]), F.lit(1e-8))
    y, z = F.greatest(c(xyz[1]), F.lit(0.0)), F.greatest(c(xyz[2]), F.lit(0.0))
    ratio = F.lit(1.33) * (F.lit(1.0) + (y + z) / x) - F.lit(1.68)
    return F.greatest(F.lit(0.0), y * ratio)


def scotopic_from_rgb(rgb: Sequence[Num] = RGB) -> Column:
    r, g, b = (F.greatest(c(v), F.lit(0.0)) for v in rgb)
    return F.greatest(F.lit(0.0), F.lit(412.0) * (F.lit(0.062) * r + F.lit(0.608) * g + F.lit(0.330) * b))


def _chroma_poly(x: Column, y: Column) -> Column:
    # Coefficients of the chromaticity term of the equivalent-luminance model.
    return (
        F.lit(-0.0054) - F.lit(0.21) * x + F.lit(0.77) * y + F.lit(1.44) * x * x - F.lit(2.97) * x * y
        + F.lit(1.59) * y * y - F.lit(2.11) * (F.lit(1.0) - x - y) * y * y
    )


def equivalent_luminance(xyz: Sequence[Num], scotopic: Num) -> Column:
    """Equivalent luminance: photopic and scotopic blend times a chromatic factor referred to 555 nm."""
    x, lp, z = (F.greatest(c(v), F.lit(0.0)) for v in xyz)
    ls = F.greatest(c(scotopic), F.lit(0.0))
    s = x + lp + z
    safe = (lp > 0) & (ls > 0) & (s > 0)
    xs, ys = x / F.nullif(s, F.lit(0.0)), lp / F.nullif(s, F.lit(0.0))
    # XYZ of 555 nm light.
    s555 = 0.5120501 + 1.0 + 0.005749999
    x555, y555 = F.lit(0.5120501 / s555), F.lit(1.0 / s555)
    a = _chroma_poly(xs, ys)
    ok = F.when(safe & (a > 0), a)

    def f(p: Column, q: Column) -> Column:
        return F.log(p) / F.lit(2.0) - F.log(q)

    ref = f(_chroma_poly(x555, y555), y555)
    ac = F.lit(1.3) * F.sqrt(lp) / (F.sqrt(lp) + F.lit(2.24))
    mix = lp / (lp + F.lit(0.05))
    v = F.pow(lp, mix) * F.pow(ls, F.lit(1.0) - mix) * F.exp(ac * (f(ok, ys) - ref))
    return F.coalesce(F.when(v > 0, v), F.lit(0.0))


def srgb_encode(v: Num) -> Column:
    """Linear 0–1 → display value 0–1."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(v)))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.lit(1.055) * F.pow(v, F.lit(1.0 / 2.4)) - F.lit(0.055))
