"""Queries on exposure brackets: frame metadata from the event table, mosaics from the pixel fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions.numeric import c
from lumenfield.operators import bracket as B
from lumenfield.operators import colour as OC
from lumenfield.plans import fixtures as X
from lumenfield.plans.registry import query
from lumenfield.plans.views import view

BLACK, WHITE = 512.0, 12000.0
SHUTTERS = (1 / 30.0, 1 / 125.0, 1 / 500.0, 1 / 2000.0, 1 / 8000.0)

view(
    "frames",
    """SELECT CAST(event_id//5 AS BIGINT) bracket_id, CAST(event_id AS BIGINT) frame_id, (1+event_id%40)*0.001e0 shutter, 2.8e0*(1+user_id%4) aperture,
       100e0*(1+(event_id//5+CAST(event_id%11=0 AS INT))%3) iso, CAST(64+CAST(event_id%97=0 AS INT) AS INT) width, CAST(64 AS INT) height, 'RGGB' cfa,
       CAST(512+event_id%7 AS INT) black, CAST(15000+100*CAST(event_id%50=0 AS INT) AS INT) white FROM events""",
)


def frames(spark, sf):
    ev, us = F.col("event_id"), F.col("user_id")
    return X.table(spark, sf, "events").select(
        F.floor(ev / 5).alias("bracket_id"), ev.cast("bigint").alias("frame_id"), ((1 + ev % 40) * F.lit(0.001)).alias("shutter"),
        (F.lit(2.8) * (1 + us % 4)).alias("aperture"),
        (F.lit(100.0) * (1 + (F.floor(ev / 5) + (ev % 11 == 0).cast("int")) % 3)).alias("iso"),
        (64 + (ev % 97 == 0).cast("int")).alias("width"), F.lit(64).alias("height"), F.lit("RGGB").alias("cfa"),
        (512 + ev % 7).cast("int").alias("black"), (15000 + 100 * (ev % 50 == 0).cast("int")).cast("int").alias("white"),
    )


view("fe", "SELECT CAST(f AS INT) frame_id, t*100e0/(100e0*8e0*8e0*0.01e0) e FROM (VALUES (1,1/30e0),(2,1/125e0),(3,1/500e0),(4,1/2000e0),(5,1/8000e0)) v(f,t)")
view(
    "frame_px",
    """SELECT image_id bracket_id, frame_id, y, x, e, least(12000e0, floor(512e0+11488e0*e*(CASE WHEN y%2=0 AND x%2=0 THEN r WHEN y%2=1 AND x%2=1 THEN b ELSE g END)+0.5e0)) dn,
       CASE WHEN y%2=0 AND x%2=0 THEN 0 WHEN y%2=1 AND x%2=1 THEN 2 ELSE 1 END k FROM px CROSS JOIN fe""",
    "px fe",
)


def _exposures():
    return F.array(*[
        F.struct(F.lit(i).alias("frame_id"), F.lit(t * 100.0 / (100.0 * 8.0 * 8.0 * 0.01)).alias("e")) for i, t in enumerate(SHUTTERS, 1)
    ])


def frame_px(spark, sf):
    px = X.px(spark, sf)
    k = B.cfa_colour("y", "x")
    v = F.when(k == 0, F.col("r")).when(k == 2, F.col("b")).otherwise(F.col("g"))
    f = px.select(F.col("image_id").alias("bracket_id"), "y", "x", "width", "height", v.alias("_v"), F.inline(_exposures()))
    dn = F.least(F.lit(WHITE), F.floor(F.lit(BLACK) + F.lit(WHITE - BLACK) * F.col("e") * F.col("_v") + 0.5).cast("double"))
    return f.withColumn("dn", dn).drop("_v")


PX = ("bracket_id", "y", "x")


@query("br1_third_stop", "SELECT frame_id, pow(2e0, sign(log2(shutter))*floor(abs(log2(shutter)*3e0)+0.5e0)/3e0) t FROM frames", "frames", "t")
def br1(spark, sf):
    return frames(spark, sf).select("frame_id", B.third_stop("shutter").alias("t"))


@query(
    "br2_aperture",
    """SELECT frame_id, CASE WHEN abs(aperture-5.6e0)/5.6e0<1e-5 THEN 5.55e0 WHEN abs(aperture-11.2e0)/11.2e0<1e-5 THEN 11.3e0
       ELSE pow(2e0, floor(log2(aperture*aperture)*3e0+0.5e0)/6e0) END n FROM frames""",
    "frames",
    "n",
)
def br2(spark, sf):
    return frames(spark, sf).select("frame_id", B.corrected_aperture("aperture", [(5.6, 5.55), (11.2, 11.3)]).alias("n"))


@query("br3_shutter_curve", "SELECT frame_id, 1e0/((1e0/shutter)*exp(-0.0001e0/shutter)) t FROM frames", "frames", "t:9")
def br3(spark, sf):
    return frames(spark, sf).select("frame_id", B.shutter_curve("shutter", -0.0001).alias("t"))


@query("br4_effective_exposure", "SELECT frame_id, shutter*iso/(100e0*aperture*aperture*1.7e0*pow(10e0,-3e0)) e FROM frames", "frames", "e")
def br4(spark, sf):
    return frames(spark, sf).select("frame_id", B.effective_exposure("shutter", "iso", "aperture", 1.7, -3.0).alias("e"))


@query(
    "br5_validate",
    " UNION ALL ".join(
        f"SELECT bracket_id, '{r}' AS rule FROM frames GROUP BY bracket_id HAVING min({r})<>max({r})" for r in ("width", "height", "cfa", "iso", "aperture")
    ),
    "frames",
)
def br5(spark, sf):
    return B.validate(frames(spark, sf))


@query(
    "br6_measured_range",
    """SELECT frame_id, mx range_max, mx*0.005e0 range_min, min(mx*0.005e0) OVER w bracket_min, max(mx) OVER w bracket_max
       FROM (SELECT *, (1e0-0.05e0)*1.2e0/(shutter*iso/(100e0*aperture*aperture)) mx FROM frames) WINDOW w AS (PARTITION BY bracket_id)""",
    "frames",
    "range_max:3 range_min bracket_min bracket_max:3",
)
def br6(spark, sf):
    f = frames(spark, sf).withColumn("e", B.effective_exposure("shutter", "iso", "aperture"))
    return B.measured_range(f, 1.2, 0.05).select("frame_id", "range_max", "range_min", "bracket_min", "bracket_max")


@query(
    "br7_repair_white",
    """SELECT bracket_id, frame_id, count(*) n, count(*) FILTER (d>least(65535,62+2*(9000-62))) n_above, max(d) top,
        CASE WHEN max(d)-62>2*(9000-62) AND max(d)>=32768 AND count(*) FILTER (d>least(65535,62+2*(9000-62)))>=greatest(64,floor(count(*)/1e6))
             THEN greatest(9000e0, CASE WHEN max(d)>=65280 THEN 65280e0 ELSE max(d) END) ELSE 9000e0 END white_fixed
       FROM (SELECT *, dn*(frame_id%3+1)*1.5e0 d FROM frame_px) GROUP BY ALL""",
    "frame_px",
    "top white_fixed",
)
def br7(spark, sf):
    f = frame_px(spark, sf).withColumn("dn", F.col("dn") * (F.col("frame_id") % 3 + 1) * 1.5)
    return B.repair_white(f, 62.0, 9000.0).select("bracket_id", "frame_id", "n", "n_above", "top", "white_fixed")


@query(
    "br8_normalise",
    """SELECT bracket_id, frame_id, y, x, CASE WHEN greatest(0,d-fb)>=fw-fb THEN 65535 ELSE 4095+(greatest(0,d-fb)*61440+(fw-fb)//2)//(fw-fb) END::INT dn
       FROM (SELECT *, dn::BIGINT d, 500+frame_id*3 fb, 12000-frame_id*100 fw FROM frame_px)""",
    "frame_px",
)
def br8(spark, sf):
    f = frame_px(spark, sf)
    dn = B.normalise(F.col("dn"), 500 + F.col("frame_id") * 3, 12000 - F.col("frame_id") * 100, 4095, 65535)
    return f.select("bracket_id", "frame_id", "y", "x", dn.alias("dn"))


@query(
    "br9_level_warnings",
    """SELECT bracket_id, 'black_off' kind, frame_id, (black-513)::INT detail FROM frames WHERE abs(black-513)>4
       UNION ALL SELECT bracket_id, 'black_spread', -1, (max(black)-min(black))::INT FROM frames GROUP BY bracket_id HAVING max(black)-min(black)>4
       UNION ALL SELECT bracket_id, 'white_spread', -1, (max(white)-min(white))::INT FROM frames GROUP BY bracket_id HAVING max(white)<>min(white)""",
    "frames",
)
def br9(spark, sf):
    return B.level_warnings(frames(spark, sf), 513).withColumn("frame_id", F.coalesce("frame_id", F.lit(-1).cast("bigint")))


@query(
    "br10_raw_multipliers",
    """SELECT bracket_id, frame_id, y, x, CASE k WHEN 1 THEN dn ELSE floor(least(12000e0,greatest(0e0,512e0+(dn-512e0)*(CASE k WHEN 0 THEN 1.9e0 ELSE 1.4e0 END)/1e0))+0.5e0) END dn FROM frame_px""",
    "frame_px",
)
def br10(spark, sf):
    return B.raw_multipliers(frame_px(spark, sf), (1.9, 1.0, 1.4), BLACK, WHITE).select("bracket_id", "frame_id", "y", "x", "dn")


@query(
    "br11_saturation",
    """SELECT bracket_id, (max(dn) FILTER (i=floor(n*0.999e0))-512e0)/11488e0 saturation FROM
        (SELECT bracket_id, dn, row_number() OVER (PARTITION BY bracket_id ORDER BY dn)-1 i, count(*) OVER (PARTITION BY bracket_id) n FROM frame_px WHERE frame_id=1) GROUP BY bracket_id""",
    "frame_px",
    "saturation",
)
def br11(spark, sf):
    return B.saturation_level(frame_px(spark, sf), BLACK, WHITE)


_PW = "CASE WHEN {s}>0 AND {s}<1 THEN exp(0.4e0)*exp(-0.1e0*(1e0/{s}+1e0/(1e0-{s}))) ELSE 0e0 END"
_NW = "CASE WHEN {s}<0 OR {s}>{l} THEN 0e0 WHEN {s}=0 OR {s}={l} THEN 1e-6 ELSE exp(-0.01e0/{s}-0.01e0/({l}-{s}))+1e-6 END"


@query(
    "br12_pixel_weight",
    f"SELECT bracket_id, frame_id, y, x, {_PW.format(s='s')} w FROM (SELECT *, (dn-512e0)/(0.9e0*11488e0) s FROM frame_px)",
    "frame_px",
    "w",
)
def br12(spark, sf):
    s = (c("dn") - BLACK) / (0.9 * (WHITE - BLACK))
    return frame_px(spark, sf).select("bracket_id", "frame_id", "y", "x", B.pixel_weight(s).alias("w"))


@query(
    "br13_neighbourhood_weight",
    f"SELECT bracket_id, frame_id, y, x, {_NW.format(s='s', l='0.9e0')} w FROM (SELECT *, (dn-512e0)/11488e0 s FROM frame_px)",
    "frame_px",
    "w",
)
def br13(spark, sf):
    s = (c("dn") - BLACK) / (WHITE - BLACK)
    return frame_px(spark, sf).select("bracket_id", "frame_id", "y", "x", B.neighbourhood_weight(s, 0.9).alias("w"))


view(
    "merged",
    f"""SELECT bracket_id, y, x, any_value(k) k, CASE WHEN sum(e*w2)>0 THEN sum(s*w2)/sum(e*w2) WHEN bool_and(s<0.002e0) THEN min(s/e) WHEN bool_and(s>=0.95e0) THEN greatest(0e0,max(least(s,ws)/e)) ELSE any_value(ref) END val
     FROM (SELECT *, CASE WHEN pr>0 AND pr<65535 THEN {_PW.format(s='((floor(pr+0.5e0)-512e0)/(0.95e0*11488e0))')} ELSE 0e0 END w2 FROM
      (SELECT *, ref*e*11488e0+512e0 pr FROM
       (SELECT f.*, CASE WHEN ew>0 THEN sw/ew WHEN und THEN lo WHEN ovr THEN hi ELSE ss END ref FROM
         (SELECT *, (dn-512e0)/11488e0 s, CASE k WHEN 0 THEN 0.95e0 WHEN 1 THEN 1e0 ELSE 0.9e0 END ws FROM frame_px) f
         JOIN (SELECT bracket_id, y, x, sum(s*w) sw, sum(e*w) ew, sum(s) ss, min(s/e) lo, greatest(0e0,max(least(s,ws)/e)) hi, bool_and(s<0.002e0) und, bool_and(s>=0.95e0) ovr FROM
           (SELECT *, {_PW.format(s='((dn-512e0)/(0.95e0*11488e0))')} w FROM (SELECT *, (dn-512e0)/11488e0 s, CASE k WHEN 0 THEN 0.95e0 WHEN 1 THEN 1e0 ELSE 0.9e0 END ws FROM frame_px)) GROUP BY bracket_id, y, x)
         USING (bracket_id, y, x)))) GROUP BY bracket_id, y, x""",
    "frame_px",
)


def merged(spark, sf):
    return B.merge(frame_px(spark, sf), BLACK, WHITE, 0.95, 0.002, (0.95, 1.0, 0.9))


@query("br14_merge_pixel", "SELECT bracket_id, y, x, val AS value FROM merged", "merged", "value")
def br14(spark, sf):
    return merged(spark, sf)


@query(
    "br15_merge_neighbourhood",
    f"""SELECT bracket_id, y, x, CASE WHEN bool_and(s<0.01e0) THEN min(s/e) WHEN bool_and(top>=0.9e0) THEN max(least(s,1e0)/e)
          WHEN sum(e*w)>0 THEN sum(s*w)/sum(e*w) ELSE max(least(s,1e0)/e) END AS value FROM
        (SELECT *, CASE WHEN top>=0.9e0 OR s<0.01e0 THEN 0e0 ELSE least({_NW.format(s='top', l='0.9e0')}, {_NW.format(s='lo', l='0.9e0')}) END w FROM
          (SELECT a.bracket_id, a.frame_id, a.y, a.x, any_value(a.e) e, any_value(a.s) s, max(b.s) top, min(b.s) lo
             FROM sc a JOIN sc b ON a.bracket_id=b.bracket_id AND a.frame_id=b.frame_id AND b.y BETWEEN a.y-2 AND a.y+2 AND b.x BETWEEN a.x-2 AND a.x+2 GROUP BY ALL)) GROUP BY bracket_id, y, x""",
    "sc",
    "value",
)
def br15(spark, sf):
    return B.merge_neighbourhood(frame_px(spark, sf), BLACK, WHITE, 0.9, 0.01)


view("sc", "SELECT bracket_id, frame_id, y, x, e, greatest(0e0,least(1e0,(dn-512e0)/11488e0)) s FROM frame_px", "frame_px")


@query("br16_single_frame", "SELECT bracket_id, frame_id, y, x, (dn-512e0)/11488e0/e AS value FROM frame_px", "frame_px", "value")
def br16(spark, sf):
    return B.single_frame(frame_px(spark, sf), BLACK, WHITE).select("bracket_id", "frame_id", "y", "x", "value")


_M17 = (1.2, -0.1, -0.05, -0.1, 1.15, 0.0, 0.02, -0.2, 1.3)


@query(
    "br17_merge_rgb",
    f"""SELECT bracket_id, y, x, """
    + ", ".join(f"CASE WHEN bool_and(un) THEN min({ch}/e) WHEN bool_and(ov) OR sum(w*e)=0 THEN max(least({ch},{ws})/e) ELSE sum(w*{ch})/sum(w*e) END {ch}" for ch, ws in zip("rgb", ("1e0", "0.98e0", "0.97e0")))
    + f""" FROM (SELECT *, CASE WHEN ov OR un THEN 0e0 ELSE least({_NW.format(s='hi', l='0.95e0')},{_NW.format(s='lo', l='0.95e0')}) END w FROM
        (SELECT *, hi>=0.95e0 OR greatest(o0,o1,o2)>=0.95e0 ov, lo<0.004e0 OR least(o0,o1,o2)<0.004e0 un FROM
        (SELECT *, greatest(r,g,b) hi, least(r,g,b) lo, greatest(0e0,1.2e0*r-0.1e0*g-0.05e0*b) o0, greatest(0e0,-0.1e0*r+1.15e0*g) o1, greatest(0e0,0.02e0*r-0.2e0*g+1.3e0*b) o2 FROM
        (SELECT image_id bracket_id, y, x, e, least(1e0,r*e) r, least(1e0,g*e) g, least(1e0,b*e) b FROM px CROSS JOIN fe)))) GROUP BY bracket_id, y, x""",
    "px fe",
    "r g b",
)
def br17(spark, sf):
    px = X.px(spark, sf)
    f = px.select(F.col("image_id").alias("bracket_id"), "y", "x", "r", "g", "b", F.inline(_exposures()))
    f = f.withColumns({ch: F.col(ch) * F.col("e") for ch in "rgb"})
    return B.merge_rgb(f, 0.95, 0.004, _M17, (1.0, 0.98, 0.97))


@query(
    "br18_channel_samples",
    """SELECT bracket_id, frame_id, CAST(k AS INT) colour, avg(s/e) FILTER (s>=0.01e0 AND s<0.9e0) mean, count(*) FILTER (s>=0.01e0 AND s<0.9e0)*1e0/count(*) share, count(*) n
       FROM (SELECT *, (dn-512e0)/11488e0 s FROM frame_px) GROUP BY ALL""",
    "frame_px",
    "mean share",
)
def br18(spark, sf):
    return B.channel_samples(frame_px(spark, sf), BLACK, WHITE, 0.9, 0.01)


# every 97th site and a dense cluster around (20, 20) that needs the wider ring
view("bad", "SELECT DISTINCT y, x FROM px WHERE (y*64+x)%97=5 OR (y BETWEEN 18 AND 22 AND x BETWEEN 18 AND 22)", "px")


@query(
    "br19_bad_pixels",
    """SELECT bracket_id, frame_id, y, x, coalesce(fix, dn) dn FROM frame_px LEFT JOIN (
        SELECT bracket_id, frame_id, ty y, tx x, CASE WHEN count(*) FILTER (d<=2)>=3 THEN (list(dn ORDER BY dn) FILTER (d<=2))[count(*) FILTER (d<=2)//2+1] ELSE list(dn ORDER BY dn)[count(*)//2+1] END fix
        FROM (SELECT f.bracket_id, f.frame_id, t.y ty, t.x tx, f.dn, greatest(abs(f.y-t.y),abs(f.x-t.x)) d
              FROM bad t JOIN frame_px f ON f.y BETWEEN t.y-4 AND t.y+4 AND f.x BETWEEN t.x-4 AND t.x+4
              WHERE f.k=CASE WHEN t.y%2=0 AND t.x%2=0 THEN 0 WHEN t.y%2=1 AND t.x%2=1 THEN 2 ELSE 1 END AND (f.y, f.x) NOT IN (SELECT (y, x) FROM bad)) GROUP BY ALL) USING (bracket_id, frame_id, y, x)""",
    "frame_px bad",
)
def br19(spark, sf):
    px = X.px(spark, sf)
    bad = px.filter(((F.col("y") * 64 + F.col("x")) % 97 == 5) | (F.col("y").between(18, 22) & F.col("x").between(18, 22))).select("y", "x")
    return B.repair_bad_pixels(frame_px(spark, sf), bad).select("bracket_id", "frame_id", "y", "x", "dn")


@query(
    "br19_bad_pixels_by_camera",
    """SELECT * FROM (WITH cb AS (SELECT s_suppkey%3 camera, y+s_suppkey%3 y, x FROM bad, supplier WHERE s_suppkey IN (1, 2)), f AS (SELECT *, bracket_id%3 camera FROM frame_px)
       SELECT bracket_id, frame_id, y, x, coalesce(fix, dn) dn FROM frame_px LEFT JOIN (
        SELECT bracket_id, frame_id, ty y, tx x, CASE WHEN count(*) FILTER (d<=2)>=3 THEN (list(dn ORDER BY dn) FILTER (d<=2))[count(*) FILTER (d<=2)//2+1] ELSE list(dn ORDER BY dn)[count(*)//2+1] END fix
        FROM (SELECT f.bracket_id, f.frame_id, t.y ty, t.x tx, f.dn, greatest(abs(f.y-t.y),abs(f.x-t.x)) d
              FROM cb t JOIN f ON f.camera=t.camera AND f.y BETWEEN t.y-4 AND t.y+4 AND f.x BETWEEN t.x-4 AND t.x+4
              WHERE f.k=CASE WHEN t.y%2=0 AND t.x%2=0 THEN 0 WHEN t.y%2=1 AND t.x%2=1 THEN 2 ELSE 1 END AND (f.camera, f.y, f.x) NOT IN (SELECT (camera, y, x) FROM cb)) GROUP BY ALL) USING (bracket_id, frame_id, y, x))""",
    "frame_px bad",
)
def br19b(spark, sf):
    """Bad pixels that lie elsewhere in each camera; the third has none."""
    px = X.px(spark, sf)
    bad = px.filter(((F.col("y") * 64 + F.col("x")) % 97 == 5) | (F.col("y").between(18, 22) & F.col("x").between(18, 22))).select("y", "x")
    cameras = X.table(spark, sf, "supplier").where("s_suppkey IN (1, 2)").select((F.col("s_suppkey") % 3).alias("camera"))
    bad = bad.crossJoin(F.broadcast(cameras)).select("camera", (F.col("y") + F.col("camera")).cast("int").alias("y"), "x")
    return B.repair_bad_pixels(frame_px(spark, sf).withColumn("camera", F.col("bracket_id") % 3), bad, by=["camera"]).select("bracket_id", "frame_id", "y", "x", "dn")


@query(
    "br20_cfa_shift",
    "SELECT image_id, y, x, (CASE WHEN (y+1)%2=0 AND x%2=0 THEN 0 WHEN (y+1)%2=1 AND x%2=1 THEN 2 ELSE 1 END)::INT colour FROM px",
    "px",
)
def br20(spark, sf):
    """Colours after a crop by one row, from the shifted pattern."""
    return X.px(spark, sf).select("image_id", "y", "x", B.cfa_colour("y", "x", B.shift_pattern(B.RGGB, 1, 0)).alias("colour"))


view("mosaic", "SELECT image_id bracket_id, y, x, CASE WHEN y%2=0 AND x%2=0 THEN r WHEN y%2=1 AND x%2=1 THEN b ELSE g END val, CASE WHEN y%2=0 AND x%2=0 THEN 0 WHEN y%2=1 AND x%2=1 THEN 2 ELSE 1 END k FROM px", "px")


def mosaic(spark, sf):
    k = B.cfa_colour("y", "x")
    v = F.when(k == 0, F.col("r")).when(k == 2, F.col("b")).otherwise(F.col("g"))
    return X.px(spark, sf).select(F.col("image_id").alias("bracket_id"), "y", "x", "width", "height", v.alias("value"))


@query(
    "br21_interpolate_colours",
    "SELECT a.bracket_id, a.y, a.x, "
    + ", ".join(f"CASE WHEN any_value(a.k)={i} THEN any_value(a.val) ELSE coalesce(avg(b.val) FILTER (b.k={i}),1e0) END {ch}" for i, ch in enumerate("rgb"))
    + " FROM mosaic a JOIN mosaic b ON a.bracket_id=b.bracket_id AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY ALL",
    "mosaic",
    "r g b",
)
def br21(spark, sf):
    return B.interpolate_colours(mosaic(spark, sf))


@query(
    "br22_sparse_grid",
    "SELECT bracket_id, y, x, " + ", ".join(f"CASE WHEN k={i} THEN val ELSE 0e0 END {ch}" for i, ch in enumerate("rgb")) + " FROM mosaic",
    "mosaic",
    "r g b",
)
def br22(spark, sf):
    return B.sparse_grid(mosaic(spark, sf))


view("smooth_px", "SELECT image_id bracket_id, frame_id, y, x, e, least(12000e0, floor(512e0+11488e0*e*rate*(1e0+0.002e0*((x*7+y*3)%5))+0.5e0)) dn FROM px CROSS JOIN fe JOIN (SELECT image_id, y//20 py, x//20 px_, 0.9e0*exp(0.004e0*((image_id*31+(y//20)*17+(x//20)*29)%1000)) rate FROM px GROUP BY ALL) t USING (image_id) WHERE t.py=y//20 AND t.px_=x//20", "px fe")


def smooth_px(spark, sf):
    """A nearly uniform scene per 20 × 20 patch, on the key grid of the pixel fixture."""
    px = X.px(spark, sf)
    cell = (F.col("image_id") * 31 + F.floor(F.col("y") / 20) * 17 + F.floor(F.col("x") / 20) * 29) % 1000
    f = px.select(F.col("image_id").alias("bracket_id"), "y", "x", (F.lit(0.9) * F.exp(F.lit(0.004) * cell)).alias("rate"), F.inline(_exposures()))
    ripple = F.lit(1.0) + F.lit(0.002) * ((F.col("x") * 7 + F.col("y") * 3) % 5)
    dn = F.floor(F.lit(BLACK) + F.lit(WHITE - BLACK) * F.col("e") * F.col("rate") * ripple + 0.5).cast("double")
    return f.withColumn("dn", F.least(F.lit(WHITE), dn)).drop("rate")


@query(
    "br23_uniform_patches",
    """SELECT bracket_id, frame_id, e, (y//20)::INT py, (x//20)::INT px, min(s) lo, max(s) hi, avg(s) mean, stddev_samp(s)/abs(avg(s)) rel_std, min(s)>0.01e0 AND max(s)<0.95e0-0.05e0 AND stddev_samp(s)/abs(avg(s))<0.1e0 good
       FROM (SELECT *, (dn-512e0)/11488e0 s FROM smooth_px WHERE (y+x)%2=1) GROUP BY ALL""",
    "smooth_px",
    "e lo hi mean rel_std",
)
def br23(spark, sf):
    return B.patches(smooth_px(spark, sf), BLACK, WHITE, 0.95)


@query("br24_fit_exposures", dbl="nominal fitted")
def br24(spark, sf):
    return B.fit_exposures(B.patches(smooth_px(spark, sf), BLACK, WHITE, 0.95).filter("good"))


@query(
    "br25_exposure_map",
    "SELECT frame_id, shutter AS nominal, CASE WHEN shutter<0.0305e0 THEN shutter*1.03e0 END actual FROM frames",
    "frames",
    "nominal actual",
)
def br25(spark, sf):
    f = frames(spark, sf).select("frame_id", F.col("shutter").alias("nominal"))
    rep = spark.range(1, 31).select((F.col("id") * F.lit(0.001) * F.lit(1.000001)).alias("nominal"), (F.col("id") * F.lit(0.001) * F.lit(1.03)).alias("actual"))
    return B.exposure_map(f, rep)


@query(
    "bracket_to_luminance",
    """SELECT bracket_id, y, x, 179e0*(0.265e0*r+0.670e0*g+0.065e0*b) lum FROM (SELECT bracket_id, y, x, 1.2e0*r-0.1e0*g-0.05e0*b r, -0.1e0*r+1.15e0*g g, 0.02e0*r-0.2e0*g+1.3e0*b b FROM
        (SELECT a.bracket_id, a.y, a.x, """
    + ", ".join(f"CASE WHEN any_value(a.k)={i} THEN any_value(a.val) ELSE coalesce(avg(b.val) FILTER (b.k={i}),1e0) END {ch}" for i, ch in enumerate("rgb"))
    + " FROM merged a JOIN merged b ON a.bracket_id=b.bracket_id AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY a.bracket_id, a.y, a.x))",
    "merged",
    "lum",
)
def bracket_to_luminance(spark, sf):
    """Merge, interpolate colours, apply the camera matrix and convert to cd/m²."""
    from lumenfield.functions.colour import luminance

    m = merged(spark, sf).withColumns({"width": F.lit(64), "height": F.lit(64)})
    rgb = OC.apply_matrix(B.interpolate_colours(m), _M17)
    return rgb.select("bracket_id", "y", "x", luminance().alias("lum"))
