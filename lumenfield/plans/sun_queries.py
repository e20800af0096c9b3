"""Queries on the merge of shaded captures. Both captures are derived from the pixel fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import sunmerge as M
from lumenfield.plans import fixtures as X
from lumenfield.plans.registry import query
from lumenfield.plans.views import view

PXK = ("image_id", "y", "x")
BAND = 20.0


@query(
    "su1_colour_agreement",
    "SELECT set_id, count(*) n_inputs, min(colour) colour, min(colour)=max(colour) agreed FROM (SELECT image_id//3 set_id, CASE WHEN image_id%4=3 THEN 'srgb' ELSE 'rad' END colour FROM images) GROUP BY set_id",
    "images",
)
def su1(spark, sf):
    i = X.px(spark, sf).select("image_id").distinct()
    d = i.select(F.floor(F.col("image_id") / 3).alias("set_id"), F.when(F.col("image_id") % 4 == 3, "srgb").otherwise("rad").alias("colour"))
    return M.colour_agreement(d, ["set_id"])


@query(
    "su2_align",
    "SELECT image_id, CAST(y-4-(image_id%3-1) AS INT) y, CAST(x-4-2 AS INT) x, g FROM px WHERE y-4-(image_id%3-1) BETWEEN 0 AND 55 AND x-6 BETWEEN 0 AND 55",
    "px",
    "g",
)
def su2(spark, sf):
    return M.align(X.px(spark, sf), 2, F.col("image_id") % 3 - 1, 4).select(*PXK, "g")


@query(
    "su3_estimate_shift",
    """SELECT image_id, arg_max(dx, corr)::INT dx, arg_max(dy, corr)::INT dy, max(corr) corr, abs(arg_max(dx, corr))<4 AND abs(arg_max(dy, corr))<4 inside FROM (SELECT a.image_id, dx, dy, corr(ln(greatest(a.lum,1e-6)), ln(greatest(b.lum,1e-6))) corr FROM lum a,
        (SELECT unnest(range(-4,5)) dx), (SELECT unnest(range(-4,5)) dy), (SELECT image_id, y-2 y, x+3 x, lum*1.5e0 lum FROM lum WHERE y>=2 AND x<=60) b
        WHERE a.y>=32 AND b.image_id=a.image_id AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY ALL) GROUP BY image_id""",
    "lum",
    "corr",
)
def su3(spark, sf):
    a = X.lum(spark, sf)
    b = a.withColumns({"y": F.col("y") - 2, "x": F.col("x") + 3, "lum": F.col("lum") * 1.5}).filter("y >= 0 and x <= 63")
    return M.estimate_shift(a, b)


_V = "(0.265e0*r+0.670e0*g+0.065e0*b)"
view("cone0", f"SELECT image_id, y, x, omega, dx, dy, dz, {_V} v FROM gv WHERE dz>0 AND {_V}>5e0", "gv")
view(
    "cone",
    """SELECT c.*, tv, row_number() OVER w-1 i, sum(omega*v) OVER w cum, sum(omega*v) OVER p tot, count(*) OVER p n, avg(v) FILTER (v>=tv*0.75e0) OVER p*0.05e0 esun FROM cone0 c JOIN
        (SELECT image_id, first(dx) tx, first(dy) ty, first(dz) tz, first(v) tv FROM (SELECT * FROM cone0 ORDER BY image_id, v DESC, x, y DESC) GROUP BY image_id) t USING (image_id)
        WHERE dx*tx+dy*ty+dz*tz>cos(sqrt(0.05e0/pi())*4e0) WINDOW w AS (PARTITION BY image_id ORDER BY v DESC, x, y DESC ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY image_id)""",
    "cone0",
)
view(
    "sun",
    """SELECT image_id, sum(dx*omega*v)/nn sx, sum(dy*omega*v)/nn sy, sum(dz*omega*v)/nn sz FROM (SELECT *, sqrt(pow(sum(dx*omega*v) OVER w,2e0)+pow(sum(dy*omega*v) OVER w,2e0)+pow(sum(dz*omega*v) OVER w,2e0)) nn FROM
       (SELECT *, CASE WHEN st=0 THEN n ELSE st END stop FROM (SELECT *, CASE WHEN tot>esun THEN count(*) FILTER (cum<=esun) OVER q ELSE count(*) FILTER (v>=tv/4e0) OVER q END st FROM cone WINDOW q AS (PARTITION BY image_id))) WHERE i<stop WINDOW w AS (PARTITION BY image_id)) GROUP BY image_id, nn""",
    "cone",
)


def sun(spark, sf):
    return M.sun_from_peak(X.geo(spark, sf), 0.05, 5.0, 5.0)


@query("su4_sun_position", "SELECT * FROM sun", "sun", "sx sy sz")
def su4(spark, sf):
    return sun(spark, sf)


@query("su5_blend_masks", dbl="blend near dist_deg:4")
def su5(spark, sf):
    return M.blend_masks(X.geo(spark, sf), sun(spark, sf), BAND, 64).select(*PXK, "blend", "near", "dist_deg")


view("hv", "SELECT image_id, y, x, r, g, b, r*(0.7e0+0.1e0*(x%7)) vr, g*(0.7e0+0.1e0*(x%7)) vg, b*(0.7e0+0.1e0*(x%7)) vb, (y%10)/9e0 bl, (x%10)/9e0 nr FROM px", "px")


def vertical(px):
    return px.withColumns({ch: F.col(ch) * (F.lit(0.7) + F.lit(0.1) * (F.col("x") % 7)) for ch in "rgb"})


@query(
    "su6_blend",
    "SELECT image_id, y, x, " + ", ".join(f"(v{ch}*bl+{ch}*(1e0-bl))*(1e0-nr)+greatest(v{ch},{ch})*nr {ch}" for ch in "rgb") + " FROM hv",
    "hv",
    "r g b",
)
def su6(spark, sf):
    px = X.px(spark, sf)
    m = px.select(*PXK, ((F.col("y") % 10) / 9.0).alias("blend"), ((F.col("x") % 10) / 9.0).alias("near"))
    return M.blend(px, vertical(px), m).select(*PXK, "r", "g", "b")


@query("su7_fill_near_source", dbl="r:4 g:4 b:4")
def su7(spark, sf):
    g = M.blend_masks(X.geo(spark, sf), sun(spark, sf), BAND, 64)
    return M.fill_near_source(g, BAND / 180.0 * 64).select(*PXK, "r", "g", "b")


view(
    "sund",
    "SELECT *, degrees(acos(greatest(-1e0,least(1e0,dx*sx+dy*sy+dz*sz)))) dd FROM g JOIN sun USING (image_id)",
    "g sun",
)


view("nearpx", "SELECT *, greatest(0e0,least(1e0,1e0-dd/40e0)) near FROM sund", "sund")


@query(
    "su7_nearest_ring",
    """WITH t AS (SELECT * FROM nearpx WHERE valid AND near>0.01e0), s AS (SELECT *, least(300, greatest(1, floor(0.2e0*count(*) OVER (PARTITION BY image_id)))) k FROM nearpx WHERE valid AND near>1e0/6e0 AND near<0.5e0),
       d AS (SELECT t.image_id, t.y, t.x, s.y sy, s.x sx, s.r, s.g, s.b, k, (t.dx-s.dx)*(t.dx-s.dx)+(t.dy-s.dy)*(t.dy-s.dy)+(t.dz-s.dz)*(t.dz-s.dz) d2 FROM t JOIN s USING (image_id)),
       n AS (SELECT *, avg(d2) OVER (PARTITION BY image_id, y, x) m FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY image_id, y, x ORDER BY round(d2,12), sy, sx)<=k)),
       f AS (SELECT image_id, y, x, sum(r*w)/sum(w) fr, sum(g*w)/sum(w) fg, sum(b*w)/sum(w) fb FROM (SELECT *, exp(-d2/(2e0*m)) w FROM n) GROUP BY ALL)
       SELECT image_id, y, x, """
    + ", ".join(f"CASE WHEN f{ch} IS NULL THEN {ch} ELSE {ch}*(1e0-near)+f{ch}*near END {ch}" for ch in "rgb")
    + " FROM nearpx LEFT JOIN f USING (image_id, y, x)",
    "nearpx",
    "r g b",
)
def su7b(spark, sf):
    """Nearness by a plain ramp about the brightest pixel; many of a target's ring pixels are equally near."""
    g = X.geo(spark, sf).join(sun(spark, sf).select("image_id", "sx", "sy", "sz"), "image_id")
    dd = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dx") * F.col("sx") + F.col("dy") * F.col("sy") + F.col("dz") * F.col("sz")))))
    g = g.withColumn("near", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - dd / 40.0)))
    return M.fill_near_source(g, 6.0).select(*PXK, "r", "g", "b")


@query(
    "su8_extrapolate",
    "SELECT image_id, y, x, "
    + ", ".join(f"CASE WHEN valid AND dd<30e0 AND least(cr,cg,cb)<-0.02e0 THEN greatest({ch},{ch}*least(1e0,dd/30e0)+i{ch}*(1e0-least(1e0,dd/30e0))) ELSE {ch} END {ch}" for ch in "rgb")
    + " FROM sund LEFT JOIN (SELECT image_id, " + ", ".join(f"regr_intercept({ch},dd) i{ch}, corr({ch},dd) c{ch}" for ch in "rgb") + " FROM sund WHERE valid AND dd>30e0 AND dd<40e0 GROUP BY image_id) USING (image_id)",
    "sund",
    "r g b",
)
def su8(spark, sf):
    """Noise pictures hardly fall with distance, so the correlation limit is lowered for the check."""
    g = X.geo(spark, sf).join(sun(spark, sf), "image_id")
    from lumenfield.functions.numeric import dot

    d = g.withColumn("dist_deg", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(("dx", "dy", "dz"), ("sx", "sy", "sz")))))))
    return M.extrapolate(d, BAND, limit=-0.02).select(*PXK, "r", "g", "b")


@query(
    "su9_source_rgb",
    "SELECT image_id, " + ", ".join(f"sum({ch}*omega)/0.05e0 {ch}" for ch in "rgb") + " FROM gv JOIN sun USING (image_id) WHERE dx*sx+dy*sy+dz*sz>=cos(radians(10e0)) GROUP BY image_id",
    "gv sun",
    "r g b",
)
def su9(spark, sf):
    return M.source_rgb(X.geo(spark, sf), sun(spark, sf), 20.0, 0.05)


@query("su10_add_source", dbl="r:4 g:4 b:4")
def su10(spark, sf):
    g, s = X.geo(spark, sf), sun(spark, sf)
    return M.add_source(g, s, M.source_rgb(g, s, 20.0, 0.05), 0.05, (64, 64)).select(*PXK, "r", "g", "b")


