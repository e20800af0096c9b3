"""Pixel → direction, direction → pixel, solid angle and position index as Column formulas.

Rows count down from the top everywhere. Directions are (right, forward, up) in the camera frame of the default view
(looking along +y, up +z); ``to_world`` turns them for any other view.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.numeric import Num, c, clamp, cross, dot, unit

PI = math.pi
RAD = PI / 180.0


@dataclass(frozen=True)
class View:
    """Projection parameters: numbers, column names or columns.

    ``type``: a angular (equidistant), v perspective, h hemispherical, c cylindrical, s planisphere,
    l parallel, e equisolid. ``circle_h``/``circle_v`` give the full picture's angle when ``vh``/``vv`` describe a crop.
    """

    type: Num = "a"
    vh: Num = 180.0
    vv: Num = 180.0
    hoff: Num = 0.0
    voff: Num = 0.0
    circle_h: Num | None = None
    circle_v: Num | None = None
    literal_type: bool = True

    def type_is(self, letter: str) -> Column:
        t = F.lit(self.type) if self.literal_type and isinstance(self.type, str) else c(self.type)
        return t == letter


def frame_xy(x: Num, y: Num, width: Num, height: Num, view: View = View()) -> tuple[Column, Column]:
    """Pixel centre as picture fractions from the middle, shift to the right and lift upward applied."""
    nx = (c(x) + 0.5) / c(width) - 0.5 + c(view.hoff)
    ny = (c(y) + 0.5) / c(height) - 0.5 - c(view.voff)
    return nx, ny


def circle_radius(nx: Column, ny: Column, view: View) -> Column:
    """Radius in the uncropped picture, whose circle has radius 0.5."""
    cx = nx * c(view.vh) / c(view.circle_h if view.circle_h is not None else view.vh)
    cy = ny * c(view.vv) / c(view.circle_v if view.circle_v is not None else view.vv)
    return F.sqrt(cx * cx + cy * cy)


def equidistant(x: Num, y: Num, width: Num, height: Num, view: View = View()) -> dict[str, Column]:
    """Direction, angle from the axis, differential solid angle and validity of an equidistant fisheye pixel."""
    nx, ny = frame_xy(x, y, width, height, view)
    radius = circle_radius(nx, ny, view)
    hr, vr = c(view.vh) * RAD, c(view.vv) * RAD
    u, v = nx * hr, ny * vr
    theta = F.sqrt(u * u + v * v)
    s = F.when(theta <= 1e-12, F.lit(1.0)).otherwise(F.sin(theta) / theta)
    inside = radius <= 0.5
    omega = F.when(inside, hr * vr / (c(width) * c(height)) * s).otherwise(F.lit(0.0))
    return {
        "nx": nx, "ny": ny, "radius": radius, "theta": theta, "omega": omega,
        "dx": u * s, "dy": F.cos(theta), "dz": -v * s,
        "valid": inside & (omega > 0) & (F.cos(theta) >= 0),
    }


def equisolid(x: Num, y: Num, width: Num, height: Num, vh: Num = 180.0, vv: Num = 180.0) -> dict[str, Column]:
    """Equisolid fisheye: r = 2 sin(θ/2); every pixel of the full 180° circle covers 8/(w·h) sr."""
    nx, ny = frame_xy(x, y, width, height)
    u = nx * 4.0 * F.sin(c(vh) * (RAD * 0.25))
    v = ny * 4.0 * F.sin(c(vv) * (RAD * 0.25))
    r = F.sqrt(u * u + v * v)
    ok = r <= 2.0
    theta = F.when(ok, F.lit(2.0) * F.asin(F.least(r * 0.5, F.lit(1.0))))
    s = F.when(r <= 1e-12, F.lit(1.0)).otherwise(F.sin(theta) / r)
    return {
        "theta": theta, "dx": u * s, "dy": F.cos(theta), "dz": -v * s,
        "omega": F.lit(8.0) / (c(width) * c(height)), "valid": ok,
    }


def _plane(letter: str, h: Column, v: Column) -> tuple[Column, Column]:
    """Width and height of the projection plane for the requested angles."""

    def tan2(a: Column) -> Column:
        return F.lit(2.0) * F.tan(a * (RAD / 2.0))

    def sin2(a: Column) -> Column:
        return F.lit(2.0) * F.sin(a * (RAD / 2.0))

    def plan(a: Column) -> Column:
        return sin2(a) / (F.lit(1.0) + F.cos(a * (RAD / 2.0)))

    return {
        "v": (tan2(h), tan2(v)), "h": (sin2(h), sin2(v)), "c": (h * RAD, tan2(v)),
        "a": (h / 180.0, v / 180.0), "s": (plan(h), plan(v)), "l": (h, v),
    }[letter]


def _ray(letter: str, p: Column, q: Column, k: Column) -> list[Column]:
    """Direction from plane coordinates; ``k`` is the staged radial factor of the type."""
    one = F.lit(1.0)
    return {
        "l": [F.lit(0.0), one, F.lit(0.0)],
        "v": [p / k, one / k, q / k],
        "h": [F.when(k.isNotNull(), p), k, F.when(k.isNotNull(), q)],
        "c": [F.sin(p) / k, F.cos(p) / k, q / k],
        "a": [p * k, F.cos(F.lit(PI) * F.sqrt(p * p + q * q)), q * k],
        "s": [p * (one + k), k, q * (one + k)],
    }[letter]


def _radial(letter: str, p: Column, q: Column) -> Column:
    one, r2 = F.lit(1.0), p * p + q * q
    d = F.sqrt(r2)
    return {
        "l": one,
        "v": F.sqrt(one + r2),
        "h": F.when(r2 <= 1.0, F.sqrt(F.greatest(one - r2, F.lit(0.0)))),
        "c": F.sqrt(one + q * q),
        "a": F.when(d <= 1e-6, F.lit(PI)).when(d <= 1.0, F.sin(F.lit(PI) * d) / d),
        "s": (one - r2) / (one + r2),
    }[letter]


TYPES = ("l", "v", "h", "c", "a", "s")


def with_direction(
    df: DataFrame, fx: Num, fy: Num, view: View, names: Sequence[str] = ("dx", "dy", "dz")
) -> DataFrame:
    """Add the unit direction at picture fractions (right, **up**, both from the lower left); NULL outside the view.

    A literal view type plans only its own formula; a column type plans all six. Steps are separate projections, so no
    sub-expression is repeated in the plan.
    """
    letters = [view.type] if view.literal_type and isinstance(view.type, str) else list(TYPES)

    def pick(values: list[Column]) -> Column:
        if len(values) == 1:
            return values[0]
        e = F.when(view.type_is(letters[0]), values[0])
        for t, v in zip(letters[1:], values[1:]):
            e = e.when(view.type_is(t), v)
        return e

    p, q, k = (f"_{names[0]}_{s}" for s in "pqk")
    planes = [_plane(t, c(view.vh), c(view.vv)) for t in letters]
    df = df.withColumns({
        p: (c(fx) + c(view.hoff) - 0.5) * pick([a for a, _ in planes]),
        q: (c(fy) + c(view.voff) - 0.5) * pick([b for _, b in planes]),
    })
    df = df.withColumn(k, pick([_radial(t, c(p), c(q)) for t in letters]))
    rays = [_ray(t, c(p), c(q), c(k)) for t in letters]
    return df.withColumns({n: pick([r[i] for r in rays]) for i, n in enumerate(names)}).drop(p, q, k)


def with_pixel_direction(df: DataFrame, view: View, names: Sequence[str] = ("dx", "dy", "dz")) -> DataFrame:
    """Direction of pixel centres, rows counted from the top."""
    return with_direction(df, (c("x") + 0.5) / c("width"), F.lit(1.0) - (c("y") + 0.5) / c("height"), view, names)


def to_world(d: Sequence[Column], vdir: Sequence[Num], vup: Sequence[Num]) -> list[Column]:
    """Camera-frame direction turned into the frame of ``vdir``/``vup``."""
    f = unit([c(v) for v in vdir])
    right = unit(cross(f, [c(v) for v in vup]))
    up = cross(right, f)
    return [d[0] * right[i] + d[1] * f[i] + d[2] * up[i] for i in range(3)]


def angular_pixel(d: Sequence[Num], width: Num, height: Num) -> tuple[Column, Column]:
    """Nearest pixel of a direction in a 180° equidistant picture; NULL behind the picture plane."""
    x, f, z = (c(v) for v in d)
    theta = F.acos(clamp(f, -1.0, 1.0))
    side = F.sqrt(x * x + z * z)
    scale = F.when(side > 0, theta / PI / side).otherwise(F.lit(0.0))
    ok = theta <= PI / 2
    fx = (x * scale + 0.5) * c(width) - 0.5
    fy = (F.lit(0.5) - z * scale) * c(height) - 0.5
    return F.when(ok, F.floor(fx + 0.5).cast("int")), F.when(ok, F.floor(fy + 0.5).cast("int"))


def with_quad_solid_angle(df: DataFrame, view: View, name: str = "omega") -> DataFrame:
    """Add the exact solid angle of the spherical quadrilateral between the four corner rays; 0 when a corner has no ray."""
    w, h = c("width"), c("height")
    x0, x1 = c("x") / w, (c("x") + 1.0) / w
    top, bottom = F.lit(1.0) - c("y") / h, F.lit(1.0) - (c("y") + 1.0) / h
    drop = []
    for i, (px, py) in enumerate(((x0, bottom), (x0, top), (x1, top), (x1, bottom))):
        names = [f"_q{i}{j}" for j in range(3)]
        df = with_direction(df, px, py, view, names)
        drop += names
    normals = {}
    for i in range(4):
        a, b = ([c(f"_q{k}{j}") for j in range(3)] for k in (i, (i + 1) % 4))
        normals.update({f"_n{i}{j}": v for j, v in enumerate(cross(a, [q - p for p, q in zip(a, b)]))})
    df = df.withColumns(normals)
    lengths = {f"_l{i}": F.sqrt(dot([f"_n{i}{j}" for j in range(3)], [f"_n{i}{j}" for j in range(3)])) for i in range(4)}
    df = df.withColumns(lengths)
    total = F.lit(-2.0 * PI)
    for i in range(4):
        k = (i + 1) % 4
        d = dot([f"_n{i}{j}" for j in range(3)], [f"_n{k}{j}" for j in range(3)]) / F.nullif(c(f"_l{i}") * c(f"_l{k}"), F.lit(0.0))
        total = total + PI - F.acos(clamp(d, -1.0, 1.0))
    df = df.withColumn("_excess", total)
    ok = (F.col("_excess") >= 0) & (F.col("_excess") <= 2 * PI)
    df = df.withColumn(name, F.coalesce(F.when(ok, F.col("_excess")), F.lit(0.0)))
    return df.drop("_excess", *drop, *normals, *lengths)


def perspective_solid_angle(x: Num, y: Num, width: Num, height: Num, vh: Num, vv: Num) -> Column:
    """Solid angle of a perspective pixel from the antiderivative at its corners."""
    fx = c(width) / (F.lit(2.0) * F.tan(c(vh) * (RAD / 2)))
    fy = c(height) / (F.lit(2.0) * F.tan(c(vv) * (RAD / 2)))

    def corner(px: Column, py: Column) -> Column:
        a = (px - c(width) * 0.5) / fx
        b = (py - c(height) * 0.5) / fy
        return F.atan2(a * b, F.sqrt(F.lit(1.0) + a * a + b * b))

    x0, y0 = c(x), c(y)
    x1, y1 = x0 + 1.0, y0 + 1.0
    return F.abs(corner(x1, y1) - corner(x1, y0) - corner(x0, y1) + corner(x0, y0))


def angle_between(a: Sequence[Num], b: Sequence[Num]) -> Column:
    return F.acos(clamp(dot(a, b), -1.0, 1.0))


def sight_angles(d: Sequence[Num]) -> dict[str, Column]:
    """Angles from the line of sight, radians: ``sigma`` off-axis, ``tau`` from the vertical, ``phi`` elevation."""
    x, f, z = (c(v) for v in d)
    sigma = F.acos(clamp(f, -1.0, 1.0))
    side = F.sqrt(x * x + z * z)
    tau = F.acos(clamp(F.when(side > 0, z / side * F.when(f < 0, -1.0).otherwise(1.0)).otherwise(F.lit(0.0)), -1.0, 1.0))
    return {"sigma": sigma, "tau": tau, "phi": F.lit(PI / 2) - F.acos(clamp(z, -1.0, 1.0))}


# Fixed value: degrees per radian as rounded in the position-index definition.
DEG = 180.0 / 3.1415927


def with_position_index(df: DataFrame, name: str = "pos", model: str = "guth", d: Sequence[Num] = ("dx", "dy", "dz")) -> DataFrame:
    """Add the Guth position index with the Iwata form below the line of sight, capped at 16; ``kim`` for the other model.

    Angles are a projection of their own, so the formula stays small in the plan.
    """
    df = df.withColumns({f"_{name}_{k}": v for k, v in sight_angles(d).items()})
    out = df.withColumn(name, _position_index(*[F.col(f"_{name}_{k}") for k in ("sigma", "tau", "phi")], model))
    return out.drop(*[f"_{name}_{k}" for k in ("sigma", "tau", "phi")])


def _position_index(sigma_rad: Column, tau_rad: Column, phi: Column, model: str) -> Column:
    tau, sigma = tau_rad * DEG, sigma_rad * DEG
    phi = F.when(phi == 0, F.lit(1e-5)).otherwise(phi)
    t2, t3 = tau * tau, tau * tau * tau
    if model == "kim":
        # Coefficients of the published formula.
        top = sigma - (F.lit(-0.000009) * t3 + F.lit(0.0014) * t2 + F.lit(0.0866) * tau + F.lit(21.633))
        return F.exp(top / (F.lit(-0.000009) * t3 + F.lit(0.0013) * t2 + F.lit(0.0853) * tau + F.lit(8.772)))
    # Coefficients of the published formulas.
    above = F.exp(
        (F.lit(35.2) - F.lit(0.31889) * tau - F.lit(1.22) * F.exp(F.lit(-2.0) * tau / 9.0)) / 1000.0 * sigma
        + (F.lit(21.0) + F.lit(0.26667) * tau - F.lit(0.002963) * t2) / 100000.0 * sigma * sigma
    )
    ct = F.cos(tau_rad)
    beta = F.atan(F.tan(sigma_rad) * F.sqrt(F.lit(1.0) + F.lit(0.3225) * ct * ct)) * DEG
    below = F.exp(F.lit(6.49) / 1000.0 * beta + F.lit(21.0) / 100000.0 * beta * beta)
    return F.least(F.lit(16.0), F.when(phi < 0, below).otherwise(above))


def with_field_cut(df: DataFrame, name: str = "cut", mode: str = "both_eyes", d: Sequence[Num] = ("dx", "dy", "dz")) -> DataFrame:
    """Add True where a pixel lies outside the field of view: ``both_eyes`` or ``central``."""
    df = df.withColumns({f"_{name}_{k}": v * DEG for k, v in sight_angles(d).items()})
    sigma, tau, phi = (F.col(f"_{name}_{k}") for k in ("sigma", "tau", "phi"))
    t = F.lit(180.0) - tau
    # Fitted border curves of the human field of view.
    if mode == "both_eyes":
        up = F.lit(7.7458218) + F.lit(0.00057407915) * tau - F.lit(0.00021746318) * tau * tau + F.lit(8.5572726e-6) * tau * tau * tau
        low = F.lit(1.0) / (
            F.lit(-0.014699242) - F.lit(1.5541106e-5) * t + F.lit(4.6898068e-6) * t * t - F.lit(5.1539687e-8) * t * t * t
        )
        cut = F.when(phi > 0, sigma > up * up).otherwise((-sigma < low) & (tau > 135.0))
    else:
        low = (F.lit(68.227109) - F.lit(2.9524084) * t + F.lit(0.046674262) * t * t) / (
            F.lit(1.0) - F.lit(0.042317294) * t + F.lit(0.00075698419) * t * t - F.lit(6.5364285e-7) * t * t * t
        )
        cut = F.when(phi > 0, sigma > 60.0).otherwise(sigma > F.when(t > 73.0, F.lit(60.0)).otherwise(low))
    return df.withColumn(name, cut).drop(*[f"_{name}_{k}" for k in ("sigma", "tau", "phi")])
