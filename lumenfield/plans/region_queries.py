"""Queries on regions, masks, aggregates, profiles and distributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F


from lumenfield.operators import colour as OC
from lumenfield.operators import geometry as OG
from lumenfield.operators import ranking as R
from lumenfield.operators import regions as RG
from lumenfield.operators import stats as S
from lumenfield.plans import fixtures as X
from lumenfield.plans.registry import query
from lumenfield.plans.views import view

PXK = ("image_id", "y", "x")

# masks: two patterns over all pixels, one with weights
view("mask_a", "SELECT image_id, y, x, 0.05e0*((x+y)%5) weight FROM px WHERE (x+y+image_id)%3=0", "px")
view("mask_b", "SELECT image_id, y, x, 1e0 weight FROM px WHERE (x+2*y)%5 IN (0,1)", "px")


def mask_a(px):
    return px.filter((F.col("x") + F.col("y") + F.col("image_id")) % 3 == 0).select(*PXK, (F.lit(0.05) * ((F.col("x") + F.col("y")) % 5)).alias("weight"))


def mask_b(px):
    return px.filter(((F.col("x") + 2 * F.col("y")) % 5).isin(0, 1)).select(*PXK, F.lit(1.0).alias("weight"))


_SUMMARY = "count(*) n_px, sum(omega) omega, min(lum) v_min, max(lum) v_max, avg(lum) v_mean, stddev_pop(lum) v_std"
_SD = "omega v_min v_max v_mean v_std"


@query("rg1_rect", f"SELECT image_id, {_SUMMARY} FROM g WHERE x BETWEEN 50 AND 79 AND y BETWEEN 20 AND 34 GROUP BY image_id", "g", _SD)
def rg1(spark, sf):
    return S.region_stats(RG.rect(X.geo(spark, sf), 50, 20, 30, 15), ["image_id"])


@query(
    "rg2_circle",
    f"""SELECT image_id, {_SUMMARY} FROM gv JOIN (SELECT image_id, dx mx, dy my, dz mz FROM gv WHERE y=20+image_id%10 AND x=40-image_id%7) USING (image_id)
        WHERE degrees(acos(greatest(-1e0,least(1e0,dx*mx+dy*my+dz*mz))))<=15e0 GROUP BY image_id""",
    "gv",
    _SD,
)
def rg2(spark, sf):
    g = X.geo(spark, sf)
    centres = X.px(spark, sf).select("image_id").distinct().select(
        "image_id", (20 + F.col("image_id") % 10).cast("int").alias("cy"), (40 - F.col("image_id") % 7).cast("int").alias("cx")
    )
    return S.region_stats(RG.circle(g, centres, 15.0), ["image_id"])


@query("rg3_mask_region", f"SELECT image_id, {_SUMMARY} FROM g SEMI JOIN mask_a USING (image_id, y, x) GROUP BY image_id", "g mask_a", _SD)
def rg3(spark, sf):
    g = X.geo(spark, sf)
    return S.region_stats(RG.in_mask(g, mask_a(X.px(spark, sf))), ["image_id"])


@query("rg4_inside_circle", f"SELECT image_id, y, {_SUMMARY} FROM g WHERE omega>0 GROUP BY image_id, y", "g", _SD)
def rg4(spark, sf):
    return S.region_stats(RG.inside_circle_only(X.geo(spark, sf)), ["image_id", "y"])


@query(
    "rg5_left_eye",
    """SELECT image_id, count(*) n_px, avg(lum) v_mean FROM lum WHERE y<32 AND x<32 AND (x-15.5e0)*(x-15.5e0)+(y-15.5e0)*(y-15.5e0)<=15.5e0*15.5e0 GROUP BY image_id""",
    "lum",
    "v_mean",
)
def rg5(spark, sf):
    """Upper half of each picture read as a side-by-side frame of 64 × 32."""
    half = OG.crop(X.lum(spark, sf), 0, 0, 64, 32)
    return RG.left_eye(half).groupBy("image_id").agg(F.count("*").alias("n_px"), F.avg("lum").alias("v_mean"))


@query(
    "rg6_band",
    f"""SELECT image_id, {_SUMMARY} FROM gv JOIN (SELECT x, dx mx, dy my, dz mz FROM geo WHERE y=32) USING (x)
        WHERE dx*mx+dy*my+dz*mz>=cos(0.3e0) OR y=32 GROUP BY image_id""",
    "gv geo",
    _SD,
)
def rg6(spark, sf):
    return S.region_stats(RG.band(X.geo(spark, sf), 0.3), ["image_id"])


ZDIR = (0.3, math.sqrt(1 - 0.09 - 0.04), 0.2)
_Z = f"(dx*0.3e0+dy*sqrt(1e0-0.09e0-0.04e0)+dz*0.2e0)"
view("zones", f"SELECT *, CASE WHEN {_Z}>=cos(0.6e0/2e0) THEN 1 WHEN {_Z}>=cos(1.4e0/2e0) THEN 2 ELSE 0 END zone FROM gv", "gv")


@query("rg7_zones", f"SELECT image_id, CAST(zone AS INT) zone, {_SUMMARY} FROM zones GROUP BY ALL", "zones", _SD)
def rg7(spark, sf):
    return S.region_stats(X.geo_valid(spark, sf).withColumn("zone", RG.zone(ZDIR, 0.6, 1.4)), ["image_id", "zone"])


@query(
    "rg8_task_area",
    f"SELECT image_id, sum(lum*omega)/sum(omega) task_lum, count(*) task_px FROM gv WHERE {_Z}>=cos(0.8e0/2e0) GROUP BY image_id",
    "gv",
    "task_lum",
)
def rg8(spark, sf):
    return RG.task_luminance(X.geo(spark, sf), ZDIR, 0.8)


@query("rg9_luminance_mask", f"SELECT image_id, {_SUMMARY} FROM g JOIN mask_a USING (image_id, y, x) WHERE weight>0.1e0 GROUP BY image_id", "g mask_a", _SD)
def rg9(spark, sf):
    return S.region_stats(RG.luminance_mask(X.geo(spark, sf), mask_a(X.px(spark, sf))), ["image_id"])


@query("rg10_white_mask", "SELECT image_id, count(*) n_px, sum(1e0) total FROM px GROUP BY image_id", "px", "total")
def rg10(spark, sf):
    return RG.white_mask(X.px(spark, sf)).groupBy("image_id").agg(F.count("*").alias("n_px"), F.sum("weight").alias("total"))


view(
    "cand",
    """SELECT image_id, y, x, CASE WHEN k=0 THEN 'semantic' ELSE 'instance' END kind, k mask_id, CASE WHEN k=0 THEN 0.4e0 ELSE 0.3e0+0.1e0*k+0.1e0*(image_id%2) END score
       FROM px, (SELECT range k FROM range(5)) WHERE (k=0 AND (x+y)%4=0) OR (k>0 AND x BETWEEN 10*(k-k//4) AND 10*(k-k//4)+8 AND y BETWEEN 20 AND 30 + image_id%3)""",
    "px",
)


def candidates(px):
    d = px.select(*PXK).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")))
    j = F.col("k") - F.when(F.col("k") >= 4, 1).otherwise(0)
    keep = ((F.col("k") == 0) & ((F.col("x") + F.col("y")) % 4 == 0)) | (
        (F.col("k") > 0) & F.col("x").between(10 * j, 10 * j + 8) & F.col("y").between(F.lit(20), 30 + F.col("image_id") % 3)
    )
    score = F.when(F.col("k") == 0, F.lit(0.4)).otherwise(F.lit(0.3) + F.lit(0.1) * F.col("k") + F.lit(0.1) * (F.col("image_id") % 2))
    return d.filter(keep).select(
        *PXK, F.when(F.col("k") == 0, "semantic").otherwise("instance").alias("kind"), F.col("k").alias("mask_id"), score.alias("score")
    )


@query(
    "rg11_mask_union",
    """SELECT 'all' policy, image_id, count(*) n_px FROM (SELECT DISTINCT image_id, y, x FROM cand) GROUP BY image_id
       UNION ALL SELECT 'instances_first', image_id, count(*) FROM (SELECT DISTINCT image_id, y, x FROM cand a WHERE (kind='instance' AND score>=0.75e0)
          OR (kind='semantic' AND NOT EXISTS (SELECT 1 FROM cand b WHERE b.image_id=a.image_id AND b.kind='instance' AND b.score>=0.75e0))) GROUP BY image_id""",
    "cand",
)
def rg11(spark, sf):
    k = candidates(X.px(spark, sf))
    out = []
    for p in ("all", "instances_first"):
        u = RG.mask_union(k, policy=p, min_score=0.75).groupBy("image_id").agg(F.count("*").alias("n_px"))
        out.append(u.select(F.lit(p).alias("policy"), "image_id", "n_px"))
    return out[0].unionByName(out[1])


@query(
    "rg12_drop_overlap",
    """SELECT 'a' part, image_id, count(*) n_px FROM mask_a ANTI JOIN mask_b USING (image_id, y, x) GROUP BY image_id
       UNION ALL SELECT 'b', image_id, count(*) FROM mask_b ANTI JOIN mask_a USING (image_id, y, x) GROUP BY image_id
       UNION ALL SELECT 'both', image_id, count(*) FROM mask_b SEMI JOIN mask_a USING (image_id, y, x) GROUP BY image_id""",
    "mask_a mask_b",
)
def rg12(spark, sf):
    px = X.px(spark, sf)
    parts = zip(("a", "b", "both"), RG.drop_overlap(mask_a(px), mask_b(px)))
    out = None
    for n, p in parts:
        q = p.groupBy("image_id").agg(F.count("*").alias("n_px")).select(F.lit(n).alias("part"), "image_id", "n_px")
        out = q if out is None else out.unionByName(q)
    return out


@query(
    "rg13_unique_masks",
    """SELECT image_id, mask_id, kind, score, n_px FROM (SELECT *, row_number() OVER (PARTITION BY image_id, content ORDER BY (kind<>'instance'), score DESC, mask_id) rn FROM
        (SELECT image_id, mask_id, kind, score, count(*) n_px, list(y*64+x ORDER BY y, x)::VARCHAR content FROM cand GROUP BY ALL)) WHERE rn=1""",
    "cand",
    "score",
)
def rg13(spark, sf):
    return RG.unique_masks(candidates(X.px(spark, sf)))


@query(
    "rg14_iou",
    """SELECT image_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) n_both, count(*) n_any, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)*1e0/count(*) iou
       FROM (SELECT *, 1 a FROM mask_a) FULL JOIN (SELECT *, 1 b FROM mask_b) USING (image_id, y, x) GROUP BY image_id""",
    "mask_a mask_b",
    "iou",
)
def rg14(spark, sf):
    px = X.px(spark, sf)
    return RG.iou(mask_a(px), mask_b(px))


@query(
    "rg15_mask_resize",
    """SELECT image_id, ty y, tx x, weight FROM mask_a JOIN (SELECT range::INT ty, floor((range+0.5e0)*64e0/100e0)::INT y FROM range(100)) USING (y)
       JOIN (SELECT range::INT tx, floor((range+0.5e0)*64e0/48e0)::INT x FROM range(48)) USING (x)""",
    "mask_a",
    "weight",
)
def rg15(spark, sf):
    return OG.nearest_resize(mask_a(X.px(spark, sf)), (64, 64), (48, 100)).select(*PXK, "weight")


@query(
    "rg16_bounding_box",
    "SELECT image_id, min(x) x0, min(y) y0, max(x) x1, max(y) y1, count(*) n_px FROM lum WHERE lum>2000e0 GROUP BY image_id",
    "lum",
)
def rg16(spark, sf):
    return RG.bounding_box(X.lum(spark, sf).filter("lum > 2000"))


# --- aggregates ---


@query("ag1_region_summary", f"SELECT image_id, label, {_SUMMARY} FROM gv GROUP BY image_id, label", "gv", _SD)
def ag1(spark, sf):
    return S.region_stats(X.geo_valid(spark, sf), ["image_id", "label"])


@query(
    "ag1_wide",
    "SELECT k, line, count(v) n_px, min(v) v_min, max(v) v_max, avg(v) v_mean, stddev_pop(v) v_std FROM wide GROUP BY k, line",
    "wide",
    "v_min v_max v_mean:6 v_std:5",
)
def ag1w(spark, sf):
    return S.region_stats(X.wide(spark, sf), ["k", "line"], "v", None)


view("rankw", "SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v)-1 i, count(*) OVER (PARTITION BY k) n FROM wide", "wide")


@query(
    "ag2_median",
    "SELECT k, count(*) n, median(v) med FROM wide GROUP BY k",
    "wide",
    "med",
)
def ag2(spark, sf):
    return R.percentiles(X.wide(spark, sf), ["k"], "v", {"med": ("median", 0.5)})


@query(
    "ag3_paired_percentile",
    """SELECT k, any_value(n) n, (coalesce(max(v) FILTER (i=trunc(n*0.75e0)),0e0)+coalesce(max(v) FILTER (i=trunc(n*0.75e0-1e0)),0e0))/2e0 p75,
        (coalesce(max(v) FILTER (i=trunc(n*0.95e0)),0e0)+coalesce(max(v) FILTER (i=trunc(n*0.95e0-1e0)),0e0))/2e0 p95 FROM rankw GROUP BY k""",
    "rankw",
    "p75 p95",
)
def ag3(spark, sf):
    return R.percentiles(X.wide(spark, sf), ["k"], "v", {"p75": ("paired", 0.75), "p95": ("paired", 0.95)})


@query(
    "ag4_lower_percentile",
    "SELECT k, any_value(n) n, max(v) FILTER (i=floor(0.05e0*(n-1))) p05, max(v) FILTER (i=floor(0.35e0*(n-1))) p35 FROM rankw GROUP BY k",
    "rankw",
    "p05 p35",
)
def ag4(spark, sf):
    return R.percentiles(X.wide(spark, sf), ["k"], "v", {"p05": ("lower", 0.05), "p35": ("lower", 0.35)})


@query(
    "ag5_linear_quantile",
    "SELECT k, count(*) n, quantile_cont(v, 0.1) q10, quantile_cont(v, 0.9) q90 FROM wide GROUP BY k",
    "wide",
    "q10 q90",
)
def ag5(spark, sf):
    return R.percentiles(X.wide(spark, sf), ["k"], "v", {"q10": ("linear", 0.1), "q90": ("linear", 0.9)})


def _profile_sql(axis, weighting):
    w = "1e0" if weighting == "lines" else "CASE WHEN omega>0 THEN omega ELSE n_px END"
    return f"""SELECT image_id, {axis}, n_px, omega, lum_mean, {axis}-min({axis}) OVER (PARTITION BY image_id) line, sum(omega) OVER w omega_cum,
        sum(lum_mean*wt) OVER w/sum(wt) OVER w lum_run FROM (SELECT *, {w} wt FROM (SELECT image_id, {axis}, count(*) n_px, sum(omega) omega, avg(lum) lum_mean FROM g GROUP BY image_id, {axis}))
        WINDOW w AS (PARTITION BY image_id ORDER BY {axis} ROWS UNBOUNDED PRECEDING)"""


@query("ag6_row_profile", _profile_sql("y", "lines"), "g", "omega lum_mean omega_cum lum_run")
def ag6(spark, sf):
    return S.profile(X.geo(spark, sf), "y")


@query("ag6_column_profile_weighted", _profile_sql("x", "omega"), "g", "omega lum_mean omega_cum lum_run")
def ag6b(spark, sf):
    return S.profile(X.geo(spark, sf), "x", weighting="omega")


@query(
    "ag7_angle_axis",
    """SELECT image_id, y, lum_mean, CASE WHEN valid THEN degrees(acos(greatest(-1e0,least(1e0,dx*fx+dy*fy+dz*fz)))) END axis_deg FROM (SELECT image_id, y, avg(lum) lum_mean FROM g GROUP BY image_id, y)
       JOIN (SELECT y, valid, dx, dy, dz FROM geo WHERE x=20) USING (y), (SELECT dx fx, dy fy, dz fz FROM geo WHERE x=20 AND valid ORDER BY y LIMIT 1)""",
    "g",
    "lum_mean axis_deg:4",
)
def ag7(spark, sf):
    return S.angle_axis(S.profile(X.geo(spark, sf), "y"), "y", 20, (64, 64)).select("image_id", "y", "lum_mean", "axis_deg")


@query(
    "ag8_ranked_list",
    """SELECT image_id, y, x, lum, row_number() OVER w rank, sum(omega) OVER w omega_cum, avg(lum) OVER w running_mean FROM gv
       WINDOW w AS (PARTITION BY image_id ORDER BY lum DESC, y, x ROWS UNBOUNDED PRECEDING)""",
    "gv",
    "lum omega_cum running_mean",
)
def ag8(spark, sf):
    return S.ranked(X.geo_valid(spark, sf)).select(*PXK, "lum", "rank", "omega_cum", "running_mean")


@query(
    "ag8_ranked_weighted",
    """SELECT k, o, line, v, row_number() OVER q rank, sum(w) OVER q omega_cum, sum(v*w) OVER q/sum(w) OVER q running_mean FROM wide
       WINDOW q AS (PARTITION BY k ORDER BY v DESC, o, line, w ROWS UNBOUNDED PRECEDING)""",
    "wide",
    "v omega_cum running_mean:4",
)
def ag8b(spark, sf):
    df = X.wide(spark, sf).withColumnRenamed("w", "omega")
    return S.ranked(df, ["k"], "v", True, ("o", "line", "omega")).select("k", "o", "line", "v", "rank", "omega_cum", "running_mean")


def _curve_sql(src, key, value):
    """Sorted values at up to 4 097 evenly spaced ranks and the extra points."""
    extra = ",".join(f"{q!r}e0" for q in S.EXTRA_POINTS)
    return f"""WITH r AS (SELECT {key}, {value} v, row_number() OVER (PARTITION BY {key} ORDER BY {value})-1 idx, count(*) OVER (PARTITION BY {key}) n FROM {src}),
       s AS (SELECT {key}, any_value(n) n, greatest(2, least(4097, any_value(n))) m FROM r GROUP BY {key}),
       p AS (SELECT {key}, floor(range*1e0/((m-1)*1e0)*((n-1)*1e0)+0.5e0)::BIGINT idx FROM s, range(4097) WHERE range<m UNION SELECT {key}, floor(q*((n-1)*1e0)+0.5e0)::BIGINT FROM s, (SELECT unnest([{extra}]) q))
       SELECT {key}, idx, idx*1e0/(n-1) q, v FROM r JOIN p USING ({key}, idx)"""


@query("ag9_luminance_distribution", _curve_sql("gv", "image_id", "lum"), "gv", "q v")
def ag9(spark, sf):
    return S.luminance_distribution(X.geo_valid(spark, sf))


@query("ag9_distribution_wide", _curve_sql("(SELECT k%3 k, v FROM wide)", "k", "v"), "wide", "q v")
def ag9c(spark, sf):
    """Groups of more values than points."""
    return S.luminance_distribution(X.wide(spark, sf).withColumn("k", F.col("k") % 3), ["k"], "v")


@query("ag9_approximate")
def ag9b(spark, sf):
    return S.approximate_distribution(X.wide(spark, sf), ["k"], "v")


@query(
    "ag10_threshold_table",
    "SELECT image_id, t threshold, count(*) FILTER (lum>=t) n_above, count(*) FILTER (lum>=t)*1e0/count(*) share FROM gv, (SELECT unnest(["
    + ",".join(f"{t!r}e0" for t in S.THRESHOLDS)
    + "]) t) GROUP BY image_id, t",
    "gv",
    "share",
)
def ag10(spark, sf):
    return S.threshold_table(X.geo_valid(spark, sf))


@query(
    "ag11_tail_table",
    """SELECT r.image_id, f top_fraction, any_value(lo.lum)*(1e0-any_value(t))+any_value(hi.lum)*any_value(t) threshold, sum(r.lum) FILTER (r.i>=r.n-greatest(1,ceil(f*r.n)))/sum(r.lum) share
       FROM rankl r, (SELECT unnest(["""
    + ",".join(f"{t!r}e0" for t in S.TAILS)
    + """]) f) JOIN LATERAL (SELECT r.n) z ON true JOIN LATERAL (SELECT (r.n-1)*(1e0-f) p, (r.n-1)*(1e0-f)-floor((r.n-1)*(1e0-f)) t) y ON true
       JOIN rankl lo ON lo.image_id=r.image_id AND lo.i=floor(p) JOIN rankl hi ON hi.image_id=r.image_id AND hi.i=least(floor(p)+1, r.n-1) GROUP BY r.image_id, f""",
    "rankl",
    "threshold share",
)
def ag11(spark, sf):
    return S.tail_table(X.geo_valid(spark, sf))


view("rankl", "SELECT image_id, lum, row_number() OVER (PARTITION BY image_id ORDER BY lum)-1 i, count(*) OVER (PARTITION BY image_id) n FROM gv", "gv")


@query(
    "ag12_histogram",
    """SELECT image_id, CASE WHEN ll<0 THEN 0 WHEN ll>=4 THEN 33 ELSE floor(ll/4e0*32e0)+1 END::BIGINT bin, count(*) n_px, count(*) FILTER (lum BETWEEN 100e0 AND 500e0) n_in FROM (SELECT *, log10(lum) ll FROM gv) GROUP BY ALL""",
    "gv",
)
def ag12(spark, sf):
    df = S.highlight(X.geo_valid(spark, sf), 100.0, 500.0).withColumn("ll", F.log10("lum"))
    h = S.histogram(df, ["image_id"], F.col("ll"), 0.0, 4.0, 32)
    inside = df.filter("highlighted")
    n = S.histogram(inside, ["image_id"], F.col("ll"), 0.0, 4.0, 32).withColumnRenamed("n_px", "n_in")
    return h.join(n, ["image_id", "bin"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))


@query(
    "ag13_regression",
    "SELECT k, regr_slope(v, w) slope, regr_intercept(v, w) intercept, corr(v, w) corr, count(*) n FROM wide GROUP BY k",
    "wide",
    "slope:4 intercept:4 corr",
)
def ag13(spark, sf):
    return S.regression(X.wide(spark, sf), ["k"], "v", "w")


@query("ag14_scale_fit", "SELECT k, sum(v*w)/sum(w*w) scale FROM wide GROUP BY k", "wide", "scale:4")
def ag14(spark, sf):
    return X.wide(spark, sf).groupBy("k").agg(S.scale_fit(F.col("v"), F.col("w")).alias("scale"))


@query("ag15_minkowski_geometric", "SELECT k, pow(avg(pow(abs(w),3e0)),1e0/3e0) m3, exp(avg(ln(v))) gm FROM wide GROUP BY k", "wide", "m3 gm:4")
def ag15(spark, sf):
    return X.wide(spark, sf).groupBy("k").agg(S.minkowski_mean(F.col("w"), 3).alias("m3"), S.geometric_mean(F.col("v")).alias("gm"))


@query(
    "ag16_top_pixels",
    "SELECT image_id, y, x, lum, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY lum DESC, y, x)::INT rank FROM lum) WHERE rank<=20",
    "lum",
    "lum",
)
def ag16(spark, sf):
    return S.top_pixels(X.lum(spark, sf), 20).select(*PXK, "lum", "rank")


view("captures", "SELECT event_id capture_id, CAST(ts AS DATE) AS day, CAST(user_id AS BIGINT) camera, event_type kind, CAST(value AS DOUBLE) AS val FROM events")


def captures(spark, sf):
    return X.table(spark, sf, "events").select(
        F.col("event_id").alias("capture_id"), F.to_date("ts").cast("string").alias("day"), F.col("user_id").cast("bigint").alias("camera"),
        F.col("event_type").alias("kind"), F.col("value").cast("double").alias("val"),
    )


@query(
    "ag17_rollup",
    """SELECT day::VARCHAR AS day, kind, coalesce(camera,-1) camera, count(val) n_px, min(val) v_min, max(val) v_max, avg(val) v_mean, stddev_pop(val) v_std, grouping(day, kind, camera)::INT AS level
       FROM (SELECT day, kind, camera%10 camera, val FROM captures) GROUP BY ROLLUP (day, kind, camera)""",
    "captures",
    "v_min v_max v_mean:9 v_std:5",
)
def ag17(spark, sf):
    return S.rollup_stats(captures(spark, sf).withColumn("camera", F.col("camera") % 10), ["day", "kind", "camera"], "val").withColumn("camera", F.coalesce("camera", F.lit(-1).cast("bigint")))


@query(
    "ag17_cube",
    """SELECT kind, coalesce(camera,-1) camera, count(val) n_px, min(val) v_min, max(val) v_max, avg(val) v_mean, stddev_pop(val) v_std, grouping(kind, camera)::INT AS level
       FROM (SELECT kind, camera%10 camera, val FROM captures) GROUP BY CUBE (kind, camera)""",
    "captures",
    "v_min v_max v_mean:9 v_std:5",
)
def ag17b(spark, sf):
    return S.cube_stats(captures(spark, sf).withColumn("camera", F.col("camera") % 10), ["kind", "camera"], "val").withColumn("camera", F.coalesce("camera", F.lit(-1).cast("bigint")))


@query(
    "ag18_block_difference",
    """SELECT image_id, count(*) n_blocks, quantile_cont(d, 0.99) p99, max(d) worst FROM (SELECT *, abs(b-a)/a d, max(a) OVER (PARTITION BY image_id) top FROM
        (SELECT image_id, y//8 qy, x//8 qx, avg(lum) a, avg(lum*(1e0+0.01e0*((x+y)%3))) b FROM lum GROUP BY ALL)) WHERE a>top*1e-4 GROUP BY image_id""",
    "lum",
    "p99 worst",
)
def ag18(spark, sf):
    a = X.lum(spark, sf)
    return S.block_difference(a, a.withColumn("lum", F.col("lum") * (F.lit(1.0) + F.lit(0.01) * ((F.col("x") + F.col("y")) % 3))), 8)


# --- colour operators that need group statistics ---


@query(
    "hd8_monochrome",
    "SELECT image_id, bool_and(r=g AND g=b) monochrome FROM (SELECT image_id, CASE WHEN image_id%3=0 THEN g ELSE r END r, g, CASE WHEN image_id%3=0 THEN g ELSE b END b FROM px) GROUP BY image_id",
    "px",
)
def hd8(spark, sf):
    grey = F.col("image_id") % 3 == 0
    df = X.px(spark, sf).withColumns({ch: F.when(grey, F.col("g")).otherwise(F.col(ch)) for ch in ("r", "b")})
    return OC.monochrome(df)


@query(
    "co12_tone_preview",
    "SELECT image_id, y, x, "
    + ", ".join(f"round_even((CASE WHEN q{ch}<=0.0031308e0 THEN q{ch}*12.92e0 ELSE 1.055e0*pow(q{ch},1e0/2.4e0)-0.055e0 END)*255e0,0)::INT {ch}8" for ch in "rgb")
    + " FROM (SELECT *, " + ", ".join(f"{ch}*0.8e0/ref/(1e0+{ch}*0.8e0/ref) q{ch}" for ch in "rgb")
    + " FROM px JOIN (SELECT image_id, quantile_cont(0.2126e0*r+0.7152e0*g+0.0722e0*b, 0.9) ref FROM px GROUP BY image_id) USING (image_id))",
    "px",
)
def co12(spark, sf):
    return OC.tone_preview(X.px(spark, sf)).select(*PXK, "r8", "g8", "b8")


@query(
    "co13_display_range",
    "SELECT image_id, count(*) n, greatest(quantile_cont(lum,0.01), quantile_cont(lum,0.99)/1e4) lo, quantile_cont(lum,0.99) hi FROM lum WHERE lum<>0 GROUP BY image_id",
    "lum",
    "lo hi",
)
def co13(spark, sf):
    return OC.display_range(X.lum(spark, sf))



