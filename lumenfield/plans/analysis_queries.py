"""Queries on calibration, spectra, view volume and gaze adaptation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import calibrate as K
from lumenfield.operators import gaze as Z
from lumenfield.operators import volume as VV
from lumenfield.plans import fixtures as X
from lumenfield.plans.pixel_queries import XYZ, _with_xyz
from lumenfield.plans.registry import query
from lumenfield.plans.views import view

PXK = ("image_id", "y", "x")

# --- shutter calibration: samples from the event table ---

view(
    "samples",
    """SELECT user_id%5 camera, (event_id//20)%6 seq, ((event_id//20)%6)*2+event_id%6 shutter_key, 10e0*pow(2e0,((event_id//20)%6)*2+event_id%6) shutter,
         (100e0+event_id%7)/(1e0+0.1e0*(((event_id//20)%6)*2+event_id%6)) mean, 1e0-0.02e0*CAST(event_id%9=0 AS INT) share FROM events""",
)


def samples(spark, sf):
    e = F.col("event_id")
    seq = F.floor(e / 20) % 6
    key = seq * 2 + e % 6
    return X.table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("camera"), seq.alias("seq"), key.alias("shutter_key"), (F.lit(10.0) * F.pow(F.lit(2.0), key.cast("double"))).alias("shutter"),
        ((F.lit(100.0) + e % 7) / (F.lit(1.0) + F.lit(0.1) * key)).alias("mean"), (F.lit(1.0) - F.lit(0.02) * (e % 9 == 0).cast("int")).alias("share"),
    )


view("smeans", "SELECT camera, seq, shutter_key, avg(mean) val, max(shutter) shutter FROM samples WHERE share>0.99e0 GROUP BY camera, seq, shutter_key", "samples")


@query("ca1_shutter_means", "SELECT camera, seq, shutter_key, val AS value, shutter FROM smeans", "smeans", "value shutter")
def ca1(spark, sf):
    return K.shutter_means(samples(spark, sf))


# sequences of the fixture start at keys 0, 2, 4 …: a sequence's scale comes from the four keys it shares with the one before it


def _chain_sql():
    """Fold over the six sequences, one subquery per step."""
    q = "SELECT camera, shutter_key, shutter, val v FROM smeans WHERE seq=0"
    for s in range(1, 6):
        cur = f"SELECT camera, shutter_key, shutter, val FROM smeans WHERE seq={s}"
        q = f"""SELECT coalesce(b.camera,m.camera) camera, coalesce(b.shutter_key,m.shutter_key) shutter_key, coalesce(b.shutter,m.shutter) shutter, coalesce(b.v,m.v) v FROM ({q}) m FULL JOIN
          (SELECT c.camera, c.shutter_key, c.shutter, c.val*r.scale v FROM ({cur}) c JOIN (SELECT c.camera, avg(m.v/c.val) scale FROM ({cur}) c JOIN ({q}) m USING (camera, shutter_key) GROUP BY c.camera) r USING (camera)) b USING (camera, shutter_key)"""
    return q


view("chained", f"SELECT camera, shutter_key, shutter, v/arg_min(v, shutter) OVER (PARTITION BY camera) relative FROM ({_chain_sql()})", "smeans")


@query("ca2_chain_sequences", "SELECT camera, shutter_key, shutter, relative FROM chained", "chained", "shutter relative")
def ca2(spark, sf):
    return K.chain(K.shutter_means(samples(spark, sf)))


@query("ca3_fit_shutter", "SELECT camera, regr_slope(-ln(relative), shutter) a, exp(regr_intercept(-ln(relative), shutter)) b FROM chained GROUP BY camera", "chained", "a:9 b")
def ca3(spark, sf):
    return K.fit_shutter(ca2(spark, sf))


view("aseq", "SELECT user_id%50 camera, event_id seq, 2.8e0*(1+event_id%4) aperture, 50e0+event_id%13 mean FROM events")


@query("ca4_aperture_correction", "SELECT camera, seq, sqrt(aperture*aperture*first(mean) OVER (PARTITION BY camera ORDER BY seq)/mean) corrected FROM aseq", "aseq", "corrected")
def ca4(spark, sf):
    d = X.table(spark, sf, "events").select((F.col("user_id") % 50).alias("camera"), F.col("event_id").alias("seq"), (F.lit(2.8) * (1 + F.col("event_id") % 4)).alias("aperture"), (F.lit(50.0) + F.col("event_id") % 13).alias("mean"))
    return K.aperture_correction(d).select("camera", "seq", "corrected")


# --- chart: 6 × 4 cells of 8 × 12 pixels ---

view("cells", "SELECT (i+1)::INT cell_id, (1+10*(i%6))::INT x, (2+15*(i//6))::INT y, 8::INT w, 12::INT h FROM (SELECT unnest(range(24)) i)")
view("cellrgb", "SELECT image_id, cell_id, avg(r)*2e0 r, avg(g)*2e0 g, avg(b)*2e0 b, count(*) n_px FROM px JOIN cells c ON px.x>=c.x AND px.x<c.x+c.w AND px.y>=c.y AND px.y<c.y+c.h GROUP BY image_id, cell_id", "px cells")


def cells(spark):
    return spark.range(24).select((F.col("id") + 1).cast("int").alias("cell_id"), (1 + 10 * (F.col("id") % 6)).cast("int").alias("x"), (2 + 15 * F.floor(F.col("id") / 6)).cast("int").alias("y"), F.lit(8).alias("w"), F.lit(12).alias("h"))


def cellrgb(spark, sf):
    return K.sample_cells(X.px(spark, sf), cells(spark), 2.0)


@query("ca5_sample_cells", "SELECT * FROM cellrgb", "cellrgb", "r g b")
def ca5(spark, sf):
    return cellrgb(spark, sf)


@query(
    "ca5_cells_by_camera",
    """SELECT image_id, (image_id%3)::INT camera, cell_id, avg(r)*2e0 r, avg(g)*2e0 g, avg(b)*2e0 b, count(*) n_px FROM px JOIN (SELECT cells.*, s_suppkey%3 camera FROM cells, supplier WHERE s_suppkey IN (1, 2)) c
         ON camera=image_id%3 AND px.x>=c.x+camera AND px.x<c.x+camera+c.w AND px.y>=c.y AND px.y<c.y+c.h-camera GROUP BY image_id, cell_id""",
    "px cells",
    "r g b",
)
def ca5b(spark, sf):
    """Charts that stand elsewhere before each camera; the third has none."""
    cameras = X.table(spark, sf, "supplier").where("s_suppkey IN (1, 2)").select((F.col("s_suppkey") % 3).cast("int").alias("camera"))
    c = cells(spark).crossJoin(F.broadcast(cameras)).withColumns({"x": F.col("x") + F.col("camera"), "h": F.col("h") - F.col("camera")})
    return K.sample_cells(X.px(spark, sf).withColumn("camera", (F.col("image_id") % 3).cast("int")), c, 2.0, by=["camera"])


view(
    "pairs",
    """SELECT *, 0.5e0*r+0.3e0*g+0.15e0*b+0.01e0*(cell_id%3) ref_x, 0.27e0*r+0.67e0*g+0.06e0*b+0.02e0*(cell_id%4) ref_y, 0.02e0*r+0.12e0*g+0.85e0*b+0.01e0*(cell_id%5) ref_z FROM cellrgb""",
    "cellrgb",
)


def pairs(spark, sf):
    i = F.col("cell_id")
    return cellrgb(spark, sf).withColumns({
        "ref_x": F.lit(0.5) * F.col("r") + F.lit(0.3) * F.col("g") + F.lit(0.15) * F.col("b") + F.lit(0.01) * (i % 3),
        "ref_y": F.lit(0.27) * F.col("r") + F.lit(0.67) * F.col("g") + F.lit(0.06) * F.col("b") + F.lit(0.02) * (i % 4),
        "ref_z": F.lit(0.02) * F.col("r") + F.lit(0.12) * F.col("g") + F.lit(0.85) * F.col("b") + F.lit(0.01) * (i % 5),
    })


START = (0.514, 0.324, 0.162, 0.265, 0.670, 0.065, 0.024, 0.123, 0.853)


@query(
    "ca6_luminance_fit",
    """SELECT image_id, any_value(k) AS scale, sqrt(avg(pow((v-ref_y)/ref_y,2e0))) rms_before, sqrt(avg(pow((v*k-ref_y)/ref_y,2e0))) rms_after FROM
        (SELECT *, sum(v*ref_y) OVER w/sum(v*v) OVER w k FROM (SELECT *, 0.265e0*r+0.670e0*g+0.065e0*b v FROM pairs) WINDOW w AS (PARTITION BY image_id)) GROUP BY image_id""",
    "pairs",
    "scale rms_before rms_after",
)
def ca6(spark, sf):
    d = pairs(spark, sf).select("image_id", F.col("ref_y").alias("ref"), (F.lit(0.265) * F.col("r") + F.lit(0.670) * F.col("g") + F.lit(0.065) * F.col("b")).alias("y"))
    return K.luminance_fit(d)


@query("ca7_channel_scales", "SELECT image_id, sum(r*ref_x)/sum(r*r) scale_r, sum(g*ref_y)/sum(g*g) scale_g, sum(b*ref_z)/sum(b*b) scale_b FROM pairs GROUP BY image_id", "pairs", "scale_r scale_g scale_b")
def ca7(spark, sf):
    return K.channel_scales(_ref_rgb(pairs(spark, sf)))


def _ref_rgb(d):
    return d.withColumns({f"ref_{ch}": F.col(f"ref_{v}") for ch, v in zip("rgb", "xyz")})


def _fit_sql():
    """Normal equations by Cramer's rule, one row of the matrix per reference channel."""
    b = [["rr", "rg", "rb"], ["rg", "gg", "gb"], ["rb", "gb", "bb"]]

    def det(m):
        return f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]})-{m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})+{m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"

    cols = []
    for i, v in enumerate("xyz"):
        for k in range(3):
            m = [row[:] for row in b]
            for j, ch in enumerate("rgb"):
                m[j][k] = f"{v}{ch}"
            cols.append(f"{det(m)}/{det(b)} m{3 * i + k}")
    sums = [f"sum({p}*{q}) {p}{q}" for p, q in ("rr", "rg", "rb", "gg", "gb", "bb")] + [f"sum(ref_{v}*{ch}) {v}{ch}" for v in "xyz" for ch in "rgb"]
    return f"SELECT image_id, {', '.join(cols)} FROM (SELECT image_id, {', '.join(sums)} FROM pairs GROUP BY image_id)"


view("fit9", _fit_sql(), "pairs")
_M9 = " ".join(f"m{i}:4" for i in range(9))


@query("ca8_fit_matrix", "SELECT * FROM fit9", "fit9", _M9)
def ca8(spark, sf):
    return K.fit_matrix(_ref_rgb(pairs(spark, sf)))


def _err_sql(src):
    """Errors from a view (image_id, candidate, cell_id, x, y, z, ref_x, ref_y, ref_z)."""
    lab = "CASE WHEN {q}>216e0/24389e0 THEN cbrt({q}) ELSE (24389e0/27e0*{q}+16e0)/116e0 END"
    f = ", ".join(f"{lab.format(q='(' + p + v + '/w' + v + ')')} {n}{v}" for p, n in (("", "t"), ("ref_", "r")) for v in "xyz")
    uv = ", ".join(f"4e0*{p}x/({p}x+15e0*{p}y+3e0*{p}z) {n}u, 9e0*{p}y/({p}x+15e0*{p}y+3e0*{p}z) {n}v, {p}x/({p}x+{p}y+{p}z) {n}cx, {p}y/({p}x+{p}y+{p}z) {n}cy" for p, n in (("", "t"), ("ref_", "r")))
    return f"""SELECT image_id, candidate, sqrt(avg(pow(tu-ru,2e0)+pow(tv-rv,2e0))) d_uv, sqrt(avg(pow((y-ref_y)/ref_y,2e0)+pow(tu-ru,2e0)+pow(tv-rv,2e0))/2e0) d_yuv,
        sqrt(avg(pow(116e0*(ty-ry),2e0)+pow(500e0*((tx-ty)-(rx-ry)),2e0)+pow(200e0*((ty-tz)-(ry-rz)),2e0)))/2.3e0 d_lab, sqrt(avg(pow(tcx-rcx,2e0)+pow(tcy-rcy,2e0))/2e0) d_xy, avg((y-ref_y)/ref_y) d_lum
       FROM (SELECT *, {f}, {uv} FROM (SELECT *, CASE WHEN fy_r>fy_t THEN f_rx ELSE f_tx END wx, CASE WHEN fy_r>fy_t THEN fy_r ELSE fy_t END wy, CASE WHEN fy_r>fy_t THEN f_rz ELSE f_tz END wz FROM
         (SELECT *, first(x) OVER w f_tx, first(y) OVER w fy_t, first(z) OVER w f_tz, first(ref_x) OVER w f_rx, first(ref_y) OVER w fy_r, first(ref_z) OVER w f_rz FROM {src} WINDOW w AS (PARTITION BY image_id, candidate ORDER BY cell_id)))) GROUP BY image_id, candidate"""


_ST = ["0.514e0*r+0.324e0*g+0.162e0*b", "0.265e0*r+0.670e0*g+0.065e0*b", "0.024e0*r+0.123e0*g+0.853e0*b"]
view("started", "SELECT *, " + ", ".join(f"{e} {v}" for e, v in zip(_ST, "xyz")) + " FROM pairs", "pairs")
view(
    "cands",
    """WITH k AS (SELECT image_id, sum(y*ref_y)/sum(y*y) k, sum(x*ref_x)/sum(x*x) kx, sum(z*ref_z)/sum(z*z) kz FROM started GROUP BY image_id)
       SELECT image_id, 'start' candidate, cell_id, x, y, z, ref_x, ref_y, ref_z FROM started
       UNION ALL SELECT image_id, 'lum', cell_id, x*k, y*k, z*k, ref_x, ref_y, ref_z FROM started JOIN k USING (image_id)
       UNION ALL SELECT image_id, 'channel', cell_id, x*kx, y*k, z*kz, ref_x, ref_y, ref_z FROM started JOIN k USING (image_id)
       UNION ALL SELECT image_id, 'matrix', cell_id, m0*r+m1*g+m2*b, m3*r+m4*g+m5*b, m6*r+m7*g+m8*b, ref_x, ref_y, ref_z FROM started JOIN fit9 USING (image_id)""",
    "started fit9",
)
_DE = "d_uv d_yuv d_lab:4 d_xy d_lum"


@query("ca9_colour_errors", f"SELECT * EXCLUDE (candidate) FROM ({_err_sql('cands')}) WHERE candidate='start'", "cands", _DE)
def ca9(spark, sf):
    from lumenfield.functions.numeric import mat_vec

    d = pairs(spark, sf)
    return K.colour_errors(d.withColumns(dict(zip("xyz", mat_vec(START, ["r", "g", "b"])))))


@query("ca10_candidate_table", _err_sql("cands"), "cands", _DE)
def ca10(spark, sf):
    return K.candidate_table(pairs(spark, sf), START)


@query(
    "ca11_chart_profiles",
    "SELECT 'row' axis, image_id, y pos, avg(lum) mean FROM lum GROUP BY image_id, y UNION ALL SELECT 'column', image_id, x, avg(lum) FROM lum GROUP BY image_id, x",
    "lum",
    "mean",
)
def ca11(spark, sf):
    d = X.lum(spark, sf)
    a, b = (K.chart_profile(d, ax).select(F.lit(n).alias("axis"), "image_id", "pos", "mean") for n, ax in (("row", "y"), ("column", "x")))
    return a.unionByName(b)


@query("ca12_dark_bands", dbl="level score")
def ca12(spark, sf):
    return K.dark_bands(K.chart_profile(X.lum(spark, sf), "x"), 4)


@query(
    "ca13_cell_scores",
    """SELECT image_id, row_no, any_value(ws) best_white, CASE WHEN count(*)>=3 THEN 0.55e0*greatest(0e0,1e0-avg(ch))+0.25e0*greatest(0e0,1e0-least(sum(greatest(0e0,-coalesce(dd,0e0))),sum(greatest(0e0,coalesce(dd,0e0))))/(greatest(1e-8,max(yy)-min(yy))*(count(*)-1)+1e-8))
         +0.20e0*(max(yy)-min(yy))/max(yy) ELSE 0e0 END score FROM (SELECT *, yy-lag(yy) OVER (PARTITION BY image_id, row_no ORDER BY cell_id) dd, max(yy-0.35e0*ch*greatest(r,g,b)) OVER (PARTITION BY image_id) ws FROM
         (SELECT *, (cell_id-1)//6 row_no, 0.265e0*r+0.670e0*g+0.065e0*b yy, (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b) ch FROM cellrgb)) GROUP BY image_id, row_no""",
    "cellrgb",
    "best_white score",
)
def ca13(spark, sf):
    d = cellrgb(spark, sf).withColumn("row_no", F.floor((F.col("cell_id") - 1) / 6).cast("int"))
    best = d.groupBy("image_id").agg(F.max(K.white_score()).alias("best_white"))
    return K.grey_strip_scores(d, line="row_no", order="cell_id").join(best, "image_id")


@query(
    "ca14_grid_dimensions",
    """SELECT p_partkey, arg_min(cols, (score, rws))::INT AS cols, arg_min(rws, (score, rws))::INT AS rows FROM (SELECT *, abs(ln((cols*1e0/rws)/(w/h)))+CASE WHEN cols<rws THEN 0.25e0 ELSE 0e0 END+0.03e0*abs(cols-rws) score FROM
        (SELECT p_partkey, n//r cols, r rws, w, h FROM (SELECT p_partkey, p_size n, 300e0+p_partkey%400 w, 200e0+p_partkey%90 h FROM part), (SELECT unnest(range(1,51)) r) WHERE r<=n AND n%r=0)) GROUP BY p_partkey""",
)
def ca14(spark, sf):
    k = F.col("p_partkey")
    d = X.table(spark, sf, "part").select("p_partkey", (F.lit(300.0) + k % 400).alias("width"), (F.lit(200.0) + k % 90).alias("height"), F.col("p_size").cast("int").alias("patches"))
    return K.grid_dimensions(d).select("p_partkey", "cols", "rows")


# --- spectra: curves from the part table ---


def _curves(spark, sf, which):
    k = F.col("p_partkey")
    d = X.table(spark, sf, "part").select(k.cast("int").alias(which), F.explode(F.sequence(F.lit(380), F.lit(780), F.lit(20))).alias("n"), (k % 11).alias("q"))
    shape = F.exp(-F.pow((F.col("n") - 450 - F.col("q") * 20) / 60.0, F.lit(2.0)))
    return d.select(which, F.col("n").cast("double").alias("nm"), (shape + 0.1).alias("v1"))


@query(
    "co10_spectral_integration",
    """WITH c AS (SELECT p_partkey::INT curve, range::DOUBLE nm, exp(-pow((range-450-(p_partkey%11)*20)/60e0,2e0))+0.1e0 v FROM part, range(380,781,20)),
       d AS (SELECT *, lead(nm) OVER w x1, lead(v) OVER w y1, lag(nm) OVER w x0, lag(v) OVER w y0 FROM c WINDOW w AS (PARTITION BY curve ORDER BY nm)),
       e AS (SELECT *, x1-nm h, nm-x0 hp, (y1-v)/(x1-nm) dn, (v-y0)/(nm-x0) dp FROM d),
       f AS (SELECT *, CASE WHEN x0 IS NULL THEN dn WHEN x1 IS NULL THEN dp WHEN dn*dp<=0 THEN 0e0 ELSE (3e0*h+3e0*hp)/((2e0*h+hp)/dp+(h+2e0*hp)/dn) END m FROM e),
       k AS (SELECT *, lead(m) OVER (PARTITION BY curve ORDER BY nm) m1 FROM f),
       s AS (SELECT curve, x, (x-nm)/h t, v, y1, m*h a, m1*h b FROM k, (SELECT range::DOUBLE x FROM range(380,781)) WHERE x1 IS NOT NULL AND x>=nm AND (x<x1 OR x=780 AND x1=780)),
       r AS (SELECT curve, x, exp(-pow((x-555e0)/50e0,2e0))*(v*(2e0*t*t*t-3e0*t*t+1e0)+a*(t*t*t-2e0*t*t+t)+y1*(3e0*t*t-2e0*t*t*t)+b*(t*t*t-t*t)) p FROM s)
       SELECT curve, 'y' receptor, sum(q) integral FROM (SELECT curve, (p+lag(p) OVER w)*0.5e0*(x-lag(x) OVER w) q FROM r WINDOW w AS (PARTITION BY curve ORDER BY x)) GROUP BY curve""",
    "",
    "integral",
)
def co10(spark, sf):
    """Emission curves resampled to 1 nm, integrated against one reference response."""
    grid = spark.range(380, 781).select(F.col("id").cast("double").alias("nm"))
    resp = grid.select(F.lit("y").alias("receptor"), "nm", F.exp(-F.pow((F.col("nm") - 555.0) / 50.0, F.lit(2.0))).alias("v1"))
    return K.curve_integral(_curves(spark, sf, "curve"), resp, ("curve", "receptor"))


_LMS = (0.15514, 0.54312, -0.03286, -0.15514, 0.45684, 0.03286, 0.0, 0.0, 0.00801, -0.1, 0.6, 0.5)


@query(
    "co11_receptor_response",
    """SELECT image_id, y, x, greatest(0e0,0.15514e0*cx+0.54312e0*cy-0.03286e0*cz) l, greatest(0e0,-0.15514e0*cx+0.45684e0*cy+0.03286e0*cz) m, greatest(0e0,0.00801e0*cz) s, greatest(0e0,-0.1e0*cx+0.6e0*cy+0.5e0*cz) rod FROM xyz""",
    "xyz",
    "l m s rod",
)
def co11(spark, sf):
    return K.receptor_response(_with_xyz(spark, sf), _LMS, xyz=XYZ).select(*PXK, "l", "m", "s", "rod")


# --- view volume ---

view(
    "vol",
    """SELECT image_id, y, x, omega, dy, valid, (2e0+0.5e0*(x%20)+0.1e0*y)*CASE WHEN (x*y)%37=0 THEN 0e0 ELSE 1e0 END dm, CASE WHEN valid AND dy>1e-6 THEN 1.5e0/dy WHEN valid THEN 'inf'::DOUBLE ELSE 0e0 END gm FROM g""",
    "g",
)
view("vclamp", "SELECT *, CASE WHEN dm>0 THEN greatest(3e0,least(12e0,dm)) ELSE 0e0 END dc FROM vol", "vol")
view("cats", "SELECT image_id, y, x, 'built' category FROM px WHERE (x+y)%4=0 UNION ALL SELECT image_id, y, x, 'green' FROM px WHERE (x+2*y)%7=1", "px")
view("volpx", "SELECT image_id, y, x, category, omega, dc depth_m, CASE WHEN isinf(gm) THEN 0e0 ELSE omega*greatest(dc*dc*dc-gm*gm*gm,0e0)/3e0 END volume_m3 FROM vclamp JOIN cats USING (image_id, y, x) WHERE valid", "vclamp cats")


def depth(spark, sf):
    g = X.geo(spark, sf)
    d = (F.lit(2.0) + F.lit(0.5) * (F.col("x") % 20) + F.lit(0.1) * F.col("y")) * F.when((F.col("x") * F.col("y")) % 37 == 0, 0.0).otherwise(1.0)
    return g.withColumns({"depth_m": d, "glazing_m": VV.glazing_distance(1.5, "dy", F.col("valid"))})


def cats(spark, sf):
    p = X.px(spark, sf).select(*PXK)
    a = p.filter((F.col("x") + F.col("y")) % 4 == 0).withColumn("category", F.lit("built"))
    return a.unionByName(p.filter((F.col("x") + 2 * F.col("y")) % 7 == 1).withColumn("category", F.lit("green")))


def volumes(spark, sf):
    return VV.view_volume(VV.clamp_depth(depth(spark, sf), 3.0, 12.0).filter("valid"), cats(spark, sf))


@query("vv1_stitch_faces", dbl="depth_m coverage")
def vv1(spark, sf):
    """Five 32 × 32 tiles cut from every picture's luminance as depth."""
    px = X.lum(spark, sf)
    tile = F.array(*[F.struct(F.lit(i).alias("face"), F.lit(oy).alias("oy"), F.lit(ox).alias("ox")) for i, (oy, ox) in enumerate(((0, 0), (0, 32), (32, 0), (32, 32), (16, 16)))])
    f = px.select("image_id", "y", "x", "lum", F.inline(tile)).filter((F.col("y") - F.col("oy")).between(0, 31) & (F.col("x") - F.col("ox")).between(0, 31))
    f = f.select("image_id", "face", (F.col("y") - F.col("oy")).alias("y"), (F.col("x") - F.col("ox")).alias("x"), (F.lit(1.0) + F.log10(F.col("lum") + 1.0)).alias("depth_m"))
    return VV.stitch_faces(f, px, 32, 100.0)


@query("vv2_clamp_depth", "SELECT image_id, sum(dc) total, count(*) FILTER (dm>0 AND dm<3e0) n_below, count(*) FILTER (dm>12e0) n_above FROM vclamp GROUP BY image_id", "vclamp", "total")
def vv2(spark, sf):
    return VV.clamp_depth(depth(spark, sf), 3.0, 12.0).groupBy("image_id").agg(F.sum("depth_m").alias("total"), F.count_if("below").alias("n_below"), F.count_if("above").alias("n_above"))


@query(
    "vv3_glazing_distance",
    """SELECT image_id, y, x, gm glazing_m, 1.5e0*sqrt(1e0+pow((x+0.5e0-32e0)*tan(radians(30e0))/32e0,2e0)+pow((y+0.5e0-32e0)*tan(radians(22.5e0))/32e0,2e0)) perspective_m FROM vol""",
    "vol",
    "glazing_m:5 perspective_m",
)
def vv3(spark, sf):
    return depth(spark, sf).select(*PXK, "glazing_m", VV.perspective_glazing(1.5, 60.0, 45.0).alias("perspective_m"))


@query("vv4_volume", "SELECT image_id, y, x, category, volume_m3 FROM volpx", "volpx", "volume_m3")
def vv4(spark, sf):
    return volumes(spark, sf).select(*PXK, "category", "volume_m3")


view("catsum", "SELECT image_id, category, count(*) n_px, sum(omega) omega, sum(volume_m3) volume_m3, median(depth_m) FILTER (depth_m>0) median_depth_m FROM volpx GROUP BY image_id, category", "volpx")


@query("vv5_category_summary", "SELECT * FROM catsum", "catsum", "omega volume_m3 median_depth_m")
def vv5(spark, sf):
    return VV.category_summary(volumes(spark, sf))


@query(
    "vv6_satisfaction",
    """SELECT image_id, 0.8e0*log10(1e0+coalesce(max(volume_m3) FILTER (category='built'),0e0))+1.2e0*log10(1e0+coalesce(max(volume_m3) FILTER (category='green'),0e0))-0.5e0 score FROM catsum GROUP BY image_id""",
    "catsum",
    "score",
)
def vv6(spark, sf):
    g = volumes(spark, sf).groupBy("image_id").agg(*[F.coalesce(F.sum(F.when(F.col("category") == k, F.col("volume_m3"))), F.lit(0.0)).alias(k) for k in ("built", "green")])
    return g.select("image_id", VV.satisfaction("built", "green", 0.8, 1.2, -0.5).alias("score"))


_REFD = "(dm*(1e0+0.02e0*((x%5)-2)))"


@query(
    "vv7_depth_errors",
    f"SELECT image_id, count(*) n_px, avg(dm-{_REFD}) bias_m, avg(abs(dm-{_REFD})) mae_m, sqrt(avg(pow(dm-{_REFD},2e0))) rmse_m, avg(abs(dm-{_REFD})/greatest({_REFD},1e-6))*100e0 mape, median(abs(dm-{_REFD})) median_ae_m FROM vol WHERE valid AND dm>0 GROUP BY image_id",
    "vol",
    "bias_m mae_m rmse_m mape median_ae_m",
)
def vv7(spark, sf):
    d = depth(spark, sf).filter("valid").withColumn("ref_m", F.col("depth_m") * (F.lit(1.0) + F.lit(0.02) * ((F.col("x") % 5) - 2)))
    return VV.depth_errors(d, ["image_id"])


view("outpx", "SELECT image_id, y, x, category, omega, depth_m*1.05e0 depth_m, volume_m3*1.1e0 volume_m3 FROM volpx WHERE (x+y)%8<>0", "volpx")


def outside(spark, sf):
    return volumes(spark, sf).filter("(x + y) % 8 <> 0").withColumns({"depth_m": F.col("depth_m") * 1.05, "volume_m3": F.col("volume_m3") * 1.1})


@query(
    "vv8_paired_report",
    """SELECT a.*, b.volume_out, b.n_in_out n_both, a.n n_any, b.n_in_out*1e0/a.n iou, a.volume_in-b.volume_out volume_error, (a.volume_in-b.volume_out)/b.volume_out*100e0 volume_error_pct, b.bias_m, b.mae_m FROM
        (SELECT image_id, category, count(*) n, sum(volume_m3) volume_in FROM volpx GROUP BY ALL) a JOIN
        (SELECT o.image_id, o.category, count(*) n_in_out, sum(o.volume_m3) volume_out, avg(i.depth_m-o.depth_m) FILTER (i.depth_m>0) bias_m, avg(abs(i.depth_m-o.depth_m)) FILTER (i.depth_m>0) mae_m FROM outpx o JOIN volpx i USING (image_id, category, y, x) GROUP BY ALL) b USING (image_id, category)""",
    "volpx outpx",
    "volume_in volume_out iou volume_error volume_error_pct bias_m mae_m",
)
def vv8(spark, sf):
    r = VV.paired_report(volumes(spark, sf), outside(spark, sf))
    return r.select("image_id", "category", F.col("n_any").alias("n"), "volume_in", "volume_out", "n_both", "n_any", "iou", "volume_error", "volume_error_pct", "bias_m", "mae_m")


@query("vv8_report_json")
def vv8b(spark, sf):
    return VV.report_json(VV.paired_report(volumes(spark, sf), outside(spark, sf)))


_VV9 = "pn>=256 AND pr BETWEEN 0.1e0 AND 20e0 THEN {} WHEN bn>=256 THEN {} WHEN inn>=256 THEN {} WHEN n_all>=256 THEN {} END"


@query(
    "vv9_window_distance",
    f"""SELECT * FROM (WITH d AS (SELECT image_id, x, y, dy, dm depth_m, dm-1e0 ref_m, image_id%4 i, (x+y)%3=0 m FROM vol WHERE valid),
       e AS (SELECT *, i<>3 AND m inside, i=0 AND m outside, i=1 AND x BETWEEN 10 AND 20 near_window, greatest(1e-4,least(1e0,dy)) cs FROM d),
       f AS (SELECT *, depth_m*depth_m-ref_m*ref_m*greatest(0e0,1e0-cs*cs) disc, depth_m*cs axial FROM e),
       ok AS (SELECT *, axial v FROM f WHERE axial BETWEEN 0.1e0 AND 20e0),
       cut AS (SELECT image_id, quantile_cont(v,0.4) c, count(*) n_all FROM ok GROUP BY image_id),
       u AS (SELECT image_id, 'paired' w, sqrt(disc)-ref_m*cs v FROM f WHERE depth_m>0 AND ref_m>0 AND inside AND outside AND disc>=0 UNION ALL SELECT image_id, 'boundary', v FROM ok WHERE near_window
         UNION ALL SELECT image_id, 'indoor', v FROM ok WHERE inside AND NOT outside UNION ALL SELECT image_id, 'near', v FROM ok JOIN cut USING (image_id) WHERE v<=c),
       q AS (SELECT image_id, w, count(*) n, quantile_cont(v,0.1) lo, quantile_cont(v,0.9) hi FROM u GROUP BY ALL),
       t AS (SELECT image_id, w, any_value(n) n, median(v) FILTER (v BETWEEN lo AND hi) r FROM u JOIN q USING (image_id, w) GROUP BY ALL),
       p AS (SELECT image_id, max(n) FILTER (w='paired') pn, max(r) FILTER (w='paired') pr, max(n) FILTER (w='boundary') bn, max(r) FILTER (w='boundary') br, max(n) FILTER (w='indoor') inn, max(r) FILTER (w='indoor') inr,
             max(r) FILTER (w='near') nr FROM t GROUP BY image_id)
       SELECT image_id, CASE WHEN {_VV9.format("'paired'", "'boundary'", "'indoor'", "'near'")} AS method, CASE WHEN {_VV9.format('pr', 'br', 'inr', 'nr')} distance_m
       FROM (SELECT DISTINCT image_id FROM d) LEFT JOIN p USING (image_id) LEFT JOIN cut USING (image_id))""",
    "vol",
    "distance_m",
)
def vv9(spark, sf):
    """Pictures take different fallbacks: paired masks only for every fourth."""
    d = depth(spark, sf).filter("valid")
    i = F.col("image_id") % 4
    d = d.withColumns({
        "ref_m": F.col("depth_m") - F.lit(1.0), "inside": F.when(i == 3, False).otherwise((F.col("x") + F.col("y")) % 3 == 0),
        "outside": F.when(i == 0, (F.col("x") + F.col("y")) % 3 == 0).otherwise(F.lit(False)), "near_window": F.when(i == 1, F.col("x").between(10, 20)).otherwise(F.lit(False)),
    })
    return VV.window_distance(d)


@query(
    "vv10_quality_warnings",
    """SELECT image_id, array_to_string([w FOR w IN [CASE WHEN image_id%2=0 THEN 'blinds' END, CASE WHEN bo*1e0/least(a,b)>0.25e0 THEN 'overlap' END, CASE WHEN image_id%3=0 THEN 'no window distance' END] IF w IS NOT NULL], ',') warnings FROM
        (SELECT image_id, count(*) FILTER (p) a, count(*) FILTER (q) b, count(*) FILTER (p AND q) bo FROM (SELECT image_id, (x+y)%4=0 p, (x+2*y)%(3+image_id%5)=1 q FROM px) GROUP BY image_id)""",
    "px",
)
def vv10(spark, sf):
    px = X.px(spark, sf).withColumns({"p": (F.col("x") + F.col("y")) % 4 == 0, "q": (F.col("x") + 2 * F.col("y")) % (3 + F.col("image_id") % 5) == 1})
    s = px.groupBy("image_id").agg(F.count_if("p").alias("built_px"), F.count_if("q").alias("green_px"), F.count_if(F.col("p") & F.col("q")).alias("overlap_px"))
    i = F.col("image_id")
    s = s.withColumns({"window_m": F.when(i % 3 == 0, 0.0).otherwise(2.0), "path": F.when(i % 2 == 0, "room_blind_1.hdr").otherwise("room.hdr")})
    return VV.quality_warnings(s).select("image_id", F.array_join("warnings", ",").alias("warnings"))


# --- gaze ---


@query(
    "gz1_subsample",
    "SELECT image_id//4 frame_id, count(*) n_px, sum(g) total FROM px WHERE (y+64*((image_id%4)//2))%2=1 AND (x+64*(image_id%2))%2=1 GROUP BY image_id//4",
    "px",
    "total",
)
def gz1(spark, sf):
    """Four pictures tiled to a 128-pixel frame, sampled at 64 per axis: every second pixel from the first."""
    i = F.col("image_id")
    d = X.px(spark, sf).withColumns({
        "frame_id": F.floor(i / 4), "y": (F.col("y") + 64 * F.floor((i % 4) / 2)).cast("int"), "x": (F.col("x") + 64 * (i % 2)).cast("int"), "width": F.lit(128), "height": F.lit(128),
    })
    return Z.subsample(d, 64).groupBy("frame_id").agg(F.count("*").alias("n_px"), F.sum("g").alias("total"))


view("gz", "SELECT *, acos(greatest(-1e0,least(1e0,dx*ax+dy*ay+dz*az))) ang, lum/100e0 sg, greatest(r,g,b)*1.79e0 pk FROM gv, (SELECT dx ax, dy ay, dz az FROM geo WHERE y=25 AND x=38)", "gv geo")


def gaze_samples(spark, sf, **kw):
    g = X.geo_valid(spark, sf).withColumns({"signal": F.col("lum") / 100.0, "peak": F.greatest("r", "g", "b") * 1.79})
    at = X.px(spark, sf).select("image_id").distinct().withColumns({"gy": F.lit(25.0), "gx": F.lit(38.0)})
    return Z.with_angle(g, at, **kw)


_GW = "exp(-0.5e0*ang*ang/(radians(10e0)*radians(10e0)))"


@query(
    "gz2_adaptation",
    f"""SELECT image_id, exp(avg(ln(lum))) uniform, exp(sum((0.15e0+0.85e0*{_GW})*ln(lum))/sum(0.15e0+0.85e0*{_GW})) centre, sum({_GW}*lum)/sum({_GW}) spot FROM gz GROUP BY image_id""",
    "gz",
    "uniform centre spot",
)
def gz2(spark, sf):
    s, out = gaze_samples(spark, sf), None
    for m in ("uniform", "centre", "spot"):
        r = Z.adaptation(s, m, 10.0).select("image_id", F.col("adaptation_lum").alias(m))
        out = r if out is None else out.join(r, "image_id")
    return out


_FIT = "(least(1920e0/64e0,1080e0/64e0)*25.4e0/110e0)"
_PX, _PY, _QX, _QY = f"((x+0.5e0-32e0)*{_FIT})", f"((32e0-y-0.5e0)*{_FIT})", f"((38e0+0.5e0-32e0)*{_FIT})", f"((32e0-25e0-0.5e0)*{_FIT})"


@query(
    "gz3_display_angle",
    f"SELECT image_id, y, x, acos(least(1e0,({_PX}*{_QX}+{_PY}*{_QY}+600e0*600e0)/(sqrt({_PX}*{_PX}+{_PY}*{_PY}+360000e0)*sqrt({_QX}*{_QX}+{_QY}*{_QY}+360000e0)))) angle FROM gv",
    "gv",
    "angle:5",
)
def gz3(spark, sf):
    return gaze_samples(spark, sf, display={"size": (1920, 1080), "ppi": 110.0, "distance_mm": 600.0}).select(*PXK, "angle")


@query(
    "gz4_target_exposure",
    f"""SELECT image_id, greatest(-16e0,least(16e0,log2(0.18e0/ad))) free_ev, greatest(-16e0,least(16e0,log2(lim))) limit_ev, least(greatest(-16e0,least(16e0,log2(0.18e0/ad))), greatest(-16e0,least(16e0,log2(lim)))) target_ev FROM
        (SELECT image_id, sum({_GW}*sg)/sum({_GW}) ad, min(0.9e0/pk) FILTER (ang<=radians(10e0)) lim FROM gz GROUP BY image_id)""",
    "gz",
    "free_ev limit_ev target_ev",
)
def gz4(spark, sf):
    s = gaze_samples(spark, sf)
    return Z.target_exposure(s, Z.adaptation(s, "spot", 10.0), 10.0).select("image_id", "free_ev", "limit_ev", "target_ev")


