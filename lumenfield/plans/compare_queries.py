"""Queries on neighbourhood filters and picture comparison. The test picture is a filtered copy of the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import compare as V
from lumenfield.operators import stencil as N
from lumenfield.plans import fixtures as X
from lumenfield.plans.region_queries import mask_b
from lumenfield.plans.registry import query
from lumenfield.plans.views import view

PXK = ("image_id", "y", "x")

# last row of each picture, for reflection at the lower border (the last picture may be partly captured: rows below are missing, not reflected)
_REF = "CASE WHEN {v}<0 THEN -{v}-1 WHEN {v}>63 THEN 127-{v} ELSE {v} END"


def _box(src, b, a, agg, edge="clip", val="lum"):
    """Brute force over the window; ``reflect`` maps positions outside the frame back."""
    off = f"(SELECT dy, dx FROM (SELECT unnest(range(-{b},{a}+1)) dy), (SELECT unnest(range(-{b},{a}+1)) dx))"
    yy, xx = "(p.y+o.dy)", "(p.x+o.dx)"
    if edge == "reflect":
        yy, xx = _REF.format(v=yy), _REF.format(v=xx)
    elif edge == "replicate":
        yy, xx = f"greatest(0,least(63,{yy}))", f"greatest(0,least(63,{xx}))"
    return f"SELECT p.image_id, p.y, p.x, any_value(p.{val}) {val}, {agg} FROM {src} p CROSS JOIN {off} o JOIN {src} q ON q.image_id=p.image_id AND q.y={yy} AND q.x={xx} GROUP BY p.image_id, p.y, p.x"


@query("nb1_box_mean", f"SELECT image_id, y, x, m mean FROM ({_box('lum', 2, 1, 'avg(q.lum) m', 'reflect')})", "lum", "mean")
def nb1(spark, sf):
    return N.box_mean(X.lum(spark, sf), "lum", 4).select(*PXK, "mean")


@query("nb2_box_max", f"SELECT image_id, y, x, m peak FROM ({_box('lum', 2, 2, 'max(q.lum) m')})", "lum", "peak")
def nb2(spark, sf):
    return N.box_max(X.lum(spark, sf), "lum", 5).select(*PXK, "peak")


_G = "exp(-0.5e0*(o.dy*o.dy+o.dx*o.dx)/({s}*{s}))"


@query(
    "nb3_gaussian",
    f"SELECT image_id, y, x, m blur FROM ({_box('lum', 6, 6, 'sum(q.lum*' + _G.format(s='0.7e0') + ')/sum(' + _G.format(s='0.7e0') + ') m', 'reflect')})",
    "lum",
    "blur:5",
)
def nb3(spark, sf):
    return N.gaussian(X.lum(spark, sf), "lum", 0.7).select(*PXK, "blur")


@query("nb4_local_mean", f"SELECT image_id, y, x, m AS local FROM ({_box('lum', 3, 3, 'avg(q.lum) m')})", "lum", "local")
def nb4(spark, sf):
    return N.local_mean(X.lum(spark, sf), "lum", 3).select(*PXK, "local")


def _proxy(src):
    return f"SELECT image_id, y, x, greatest(0e0,abs(log10(greatest(lum,1e-6))-log10(greatest(m,1e-6)))-pow(10e0,-2e0)) contrast FROM ({_box(src, 2, 2, 'avg(q.lum) m')})"


view("contrast_ref", _proxy("lum"), "lum")
view("lum_test", "SELECT image_id, y, x, lum*(0.8e0+0.1e0*((x*3+y)%3))+20e0 lum FROM lum", "lum")
view("contrast_test", _proxy("lum_test"), "lum_test")


def lum_test(spark, sf):
    d = X.lum(spark, sf)
    return d.withColumn("lum", F.col("lum") * (F.lit(0.8) + F.lit(0.1) * ((F.col("x") * 3 + F.col("y")) % 3)) + 20.0)


@query("nb5_contrast_proxy", "SELECT * FROM contrast_ref", "contrast_ref", "contrast")
def nb5(spark, sf):
    return N.contrast_proxy(X.lum(spark, sf), 48.0, 0.0).select(*PXK, "contrast")


_S6 = f"{10.0**-0.781367 * 8.52!r}e0"


_TAPS6 = f"(SELECT range::INT d, exp(-0.5e0*pow(range::DOUBLE/{_S6},2e0)) w FROM range(-12,13))"


@query(
    "nb6_local_adaptation",
    f"""SELECT a.image_id, a.y, a.x, exp(sum(b.m*k.w)/sum(k.w)) adapt FROM lum a CROSS JOIN {_TAPS6} k JOIN
        (SELECT a.image_id, a.y, a.x, sum(ln(greatest(q.lum,1e-6))*k.w)/sum(k.w) m FROM lum a CROSS JOIN {_TAPS6} k JOIN lum q ON q.image_id=a.image_id AND q.y=a.y AND q.x=greatest(0,least(63,a.x+k.d)) GROUP BY ALL) b
        ON b.image_id=a.image_id AND b.x=a.x AND b.y=greatest(0,least(63,a.y+k.d)) GROUP BY a.image_id, a.y, a.x""",
    "lum",
    "adapt",
)
def nb6(spark, sf):
    return N.local_adaptation(X.lum(spark, sf), 8.52).select(*PXK, "adapt")


@query("nb7_mean3", f"SELECT image_id, y, x, m/9e0 mean3 FROM ({_box('lum', 1, 1, 'sum(q.lum) m')})", "lum", "mean3")
def nb7(spark, sf):
    return N.box_sum3(X.lum(spark, sf), "lum").select(*PXK, "mean3")


@query("nb8_relax", dbl="lum:3")
def nb8(spark, sf):
    """Bright pixels filled from their surroundings."""
    d = X.lum(spark, sf)
    return N.relax(d, ["lum"], F.col("lum") > 4000.0).select(*PXK, "lum")


@query(
    "nb9_moving_average",
    """SELECT image_id, y, avg(m) OVER (PARTITION BY image_id ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) smooth FROM (SELECT image_id, y, avg(lum) m FROM lum GROUP BY image_id, y)""",
    "lum",
    "smooth",
)
def nb9(spark, sf):
    rows = X.lum(spark, sf).groupBy("image_id", "y").agg(F.avg("lum").alias("m"))
    return N.moving_average(rows, ["image_id"], "y", "m", 3).select("image_id", "y", "smooth")


@query("nb10_power_pool", f"SELECT image_id, y, x, pow(m/9e0,1e0/pow(10e0,0.3e0)) pooled FROM ({_box('lum', 1, 1, 'sum(pow(greatest(q.lum,0e0),pow(10e0,0.3e0))) m')})", "lum", "pooled")
def nb10(spark, sf):
    return N.power_pool(X.lum(spark, sf), "lum", 3, 0.3).select(*PXK, "pooled")


@query(
    "cv1_difference",
    "SELECT image_id, y, x, t.lum-r.lum e, abs(t.lum-r.lum) ae, pow(t.lum-r.lum,2e0) se, abs(t.lum-r.lum)/(r.lum+0.01e0) rae, pow(t.lum-r.lum,2e0)/(r.lum*r.lum+0.01e0) rse FROM lum_test t JOIN lum r USING (image_id, y, x)",
    "lum lum_test",
    "e ae se:3 rae rse",
)
def cv1(spark, sf):
    return V.difference(lum_test(spark, sf), X.lum(spark, sf))


view(
    "maps",
    """SELECT image_id, y, x, w, kept, r*w ref_map, t*w test_map, kept*r*w*w visibility FROM (SELECT image_id, y, x, coalesce(m.weight*1.6e0,0e0) w, r.contrast r, t.contrast t,
         CASE WHEN r.contrast>1e-9 THEN greatest(0e0,least(1e0,t.contrast/r.contrast)) ELSE 1e0 END kept FROM contrast_ref r JOIN contrast_test t USING (image_id, y, x) LEFT JOIN mask_b m USING (image_id, y, x))""",
    "contrast_ref contrast_test mask_b",
)


def maps(spark, sf):
    ref = N.contrast_proxy(X.lum(spark, sf), 48.0, 0.0)
    test = N.contrast_proxy(lum_test(spark, sf), 48.0, 0.0)
    m = mask_b(X.px(spark, sf)).withColumn("weight", F.col("weight") * 1.6)
    return V.preservation(test, ref, m)


@query("cv2_preservation", "SELECT image_id, y, x, kept, ref_map, test_map, visibility FROM maps", "maps", "kept ref_map test_map visibility")
def cv2(spark, sf):
    return maps(spark, sf).select(*PXK, "kept", "ref_map", "test_map", "visibility")


def _q(v):
    e = f"(floor(log2({v}))+1)"
    return f"(CASE WHEN {v}>1e-32 THEN (least(255e0,floor({v}*pow(2e0,8-{e})))+0.5e0)*pow(2e0,{e}-8) ELSE 0e0 END)"


@query(
    "cv3_view_summary",
    f"""SELECT image_id, n view_pixels, rt ref_total, vt visibility_total, n*128.5e0/128e0 view_size, rt/greatest(n*128.5e0/128e0,1e-9) baseline, vt/greatest(rt,1e-9) ratio, greatest(0e0,least(10e0,10e0*k/greatest(1,n))) quality FROM
        (SELECT image_id, count(*) FILTER (w>0.5e0) n, sum({_q('ref_map')}) rt, sum({_q('visibility')}) vt, sum(kept) FILTER (w>0.5e0) k FROM maps GROUP BY image_id)""",
    "maps",
    "ref_total visibility_total view_size baseline ratio quality",
)
def cv3(spark, sf):
    return V.view_summary(maps(spark, sf))


@query(
    "cv4_change_mask",
    "SELECT image_id, y, x, (x%4=0 AND 0.0015e0*(y%3)/1e0>0.001e0) OR (x%4=1 AND false) changed FROM px",
    "px",
)
def cv4(spark, sf):
    a = X.px(spark, sf)
    b = a.withColumn("g", F.when(F.col("x") % 4 == 0, F.col("g") * (F.lit(1.0) + F.lit(0.0015) * (F.col("y") % 3))).otherwise(F.col("g")))
    return V.change_mask(b, a)


@query("cv5_map_summary", "SELECT image_id, min(contrast) v_min, avg(contrast) v_mean, max(contrast) v_max, median(contrast) v_median FROM contrast_ref GROUP BY image_id", "contrast_ref", "v_min v_mean v_max v_median")
def cv5(spark, sf):
    return V.map_summary(nb5(spark, sf), "contrast")


@query(
    "cv6_step_comparison",
    "SELECT image_id, avg((rel>1.0001e0/128e0)::INT) beyond, avg((rel=0)::INT) identical, max(rel) worst FROM (SELECT image_id, CASE WHEN x%5=0 THEN 0.002e0*(y%10)/(1e0+0.002e0*(y%10)) ELSE 0e0 END rel FROM px) GROUP BY image_id",
    "px",
    "beyond identical worst",
)
def cv6(spark, sf):
    a = X.px(spark, sf)
    b = a.withColumn("r", F.when(F.col("x") % 5 == 0, F.col("r") * (F.lit(1.0) + F.lit(0.002) * (F.col("y") % 10))).otherwise(F.col("r")))
    return V.step_comparison(a, b)


