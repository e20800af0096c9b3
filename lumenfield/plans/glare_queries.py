"""Queries on glare."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions import geometry as G
from lumenfield.operators import glare as L
from lumenfield.operators import regions as RG
from lumenfield.plans import fixtures as X
from lumenfield.plans.region_queries import ZDIR, mask_a
from lumenfield.plans.registry import query
from lumenfield.plans.views import view
from lumenfield.sources import tables as TB

PXK = ("image_id", "y", "x")
view("tot", "SELECT image_id, sum(omega) omega, sum(dy*omega*lum) ev, sum(lum*omega)/sum(omega) lum_mean, max(lum) lum_max FROM gv GROUP BY image_id", "gv")


@query("gl1_totals", "SELECT * FROM tot", "tot", "omega ev lum_mean lum_max")
def gl1(spark, sf):
    return L.totals(X.geo(spark, sf))


@query(
    "gl2_position_means",
    """SELECT image_id, sum(lum/p*omega)/sum(omega) av_lum_pos, sum(lum/p/p*omega)/sum(omega) av_lum_pos2, median(lum) med_lum, median(lum/p) med_lum_pos, median(lum/p/p) med_lum_pos2 FROM posidx GROUP BY image_id""",
    "posidx",
    "av_lum_pos av_lum_pos2 med_lum med_lum_pos med_lum_pos2",
)
def gl2(spark, sf):
    return L.position_means(X.geo(spark, sf))


@query(
    "gl3_edits",
    """SELECT 'clip' edit, image_id, sum(CASE WHEN lum>=3000e0 THEN 2500e0 ELSE lum END) total FROM g GROUP BY image_id
       UNION ALL SELECT 'disc', image_id, sum(CASE WHEN valid AND dx*0.6e0+dy*0.8e0>=cos(0.25e0) THEN 123e0 ELSE lum END) FROM g GROUP BY image_id
       UNION ALL SELECT 'fill_up', g.image_id, sum(CASE WHEN g.y<=9 THEN d.lum ELSE g.lum END) FROM g JOIN g d ON d.image_id=g.image_id AND d.x=g.x AND d.y=10 GROUP BY g.image_id
       UNION ALL SELECT 'ideal', image_id, sum(CASE WHEN valid AND lum>=2000e0 THEN least(2e9,(ev*1.3e0-ev+eh)/kh) ELSE lum END) FROM g
         JOIN (SELECT image_id, sum(dy*omega*lum) ev, sum(dy*omega*lum) FILTER (lum>=2000e0) eh, sum(dy*omega) FILTER (lum>=2000e0) kh FROM gv GROUP BY image_id) USING (image_id) GROUP BY image_id""",
    "g gv",
    "total:3",
)
def gl3(spark, sf):
    g = X.geo(spark, sf)
    meas = L.totals(g).select("image_id", (F.col("ev") * 1.3).alias("ev_measured"))
    out = None
    for name, d in (
        ("clip", L.clip_above(g, 3000.0, 2500.0)), ("disc", L.replace_disc(g, (0.6, 0.8, 0.0), 0.5, 123.0)), ("fill_up", L.fill_rows(g, 9, True)), ("ideal", L.ideal_value(g, meas, 2000.0)),
    ):
        s = d.groupBy("image_id").agg(F.sum("lum").alias("total")).select(F.lit(name).alias("edit"), "image_id", "total")
        out = s if out is None else out.unionByName(s)
    return out


@query(
    "gl4_threshold",
    "SELECT image_id, count(*) FILTER (lum>2000e0) n_fixed, count(*) FILTER (lum>5e0*lum_mean) n_mean FROM gv JOIN (SELECT image_id, lum_mean FROM tot) USING (image_id) GROUP BY image_id",
    "gv tot",
)
def gl4(spark, sf):
    g = X.geo(spark, sf)
    t = L.threshold(L.totals(g), 5.0)
    a = L.source_pixels(g).groupBy("image_id").agg(F.count("*").alias("n_fixed"))
    b = L.source_pixels(g, t).groupBy("image_id").agg(F.count("*").alias("n_mean"))
    return t.select("image_id").join(a, "image_id", "left").join(b, "image_id", "left").na.fill(0)


@query("gl5_local_only", "SELECT image_id, y, x, lum FROM gv SEMI JOIN mask_a USING (image_id, y, x) WHERE lum>2000e0", "gv mask_a", "lum")
def gl5(spark, sf):
    return RG.in_mask(L.source_pixels(X.geo(spark, sf)), mask_a(X.px(spark, sf))).select(*PXK, "lum")


def _closure(name, src, keys, cos_limit):
    """Transitive closure of nearness as recursive SQL; every pixel's label is the smallest pixel number it reaches."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{q}=b.{q}" for q in keys)
    onr = " AND ".join(f"r.{q}=e.{q}" for q in keys)
    view(f"{name}_edges", f"SELECT {', '.join('a.' + q for q in keys)}, a.y*64+a.x i, b.y*64+b.x j FROM {src} a JOIN {src} b ON {on} AND a.dx*b.dx+a.dy*b.dy+a.dz*b.dz>={cos_limit}", src)
    view(
        name,
        f"""SELECT s.*, lab.label FROM {src} s JOIN (WITH RECURSIVE r AS (SELECT {k}, i, j FROM {name}_edges UNION SELECT {', '.join('r.' + q for q in keys)}, r.i, e.j FROM r JOIN {name}_edges e ON {onr} AND r.j=e.i)
           SELECT {k}, i, min(j)::INT label FROM r GROUP BY {k}, i) lab ON {' AND '.join(f's.{q}=lab.{q}' for q in keys)} AND s.y*64+s.x=lab.i""",
        f"{src} {name}_edges",
    )


view("srcpx", "SELECT image_id, y, x, lum, omega, dx, dy, dz FROM gv WHERE lum>2000e0", "gv")
_closure("lab", "srcpx", ["image_id"], "cos(0.1e0)")


def labelled(spark, sf):
    return L.group_sources(L.source_pixels(X.geo(spark, sf)))


@query("gl6_group_sources", "SELECT image_id, y, x, label FROM lab", "lab")
def gl6(spark, sf):
    return labelled(spark, sf).select(*PXK, "label")


_PX = "(floor(64e0/180e0*30e0))"


@query(
    "gl7_patches",
    """SELECT image_id, y, x, CASE WHEN i1 BETWEEN 1 AND 49 THEN CASE WHEN i2>49 OR i2<1 OR (x-c1x)*(x-c1x)+(yb-c1y)*(yb-c1y)<(x-c2x)*(x-c2x)+(yb-c2y)*(yb-c2y) THEN i1 ELSE i2 END END::INT patch FROM
       (SELECT *, 5+((i2-1)//7%2)*5+((i2-1)%7)*10 c2x, 5+((i2-1)//7)*10 c2y FROM
        (SELECT *, CASE WHEN yb>c1y THEN i1+7 ELSE i1-7 END+CASE WHEN x>c1x THEN 0 ELSE -1 END+ln%2 i2 FROM
         (SELECT *, 5+((i1-1)//7%2)*5+((i1-1)%7)*10 c1x, 5+((i1-1)//7)*10 c1y FROM
          (SELECT *, ln*7+floor(greatest(0e0,x/10e0-0.5e0*(ln%2)))::INT+1 i1 FROM (SELECT *, 63-y yb, (63-y)//10 ln FROM srcpx)))))""",
    "srcpx",
)
def gl7(spark, sf):
    return L.source_pixels(X.geo(spark, sf)).select(*PXK, L.patch_label(30.0).alias("patch"))


#: The radius that a search angle of 0.8 rad gives in pictures of 64 pixels.
_R = L.smoothing_radius(64, 0.8)
_DISC = f"BETWEEN {{0}}-{int(_R)} AND {{0}}+{int(_R)}"


view("srcpx_w", "SELECT image_id, y, x, lum, omega, dx, dy, dz FROM gv WHERE lum>700e0", "gv")
_closure("lab_w", "srcpx_w", ["image_id"], "cos(0.1e0)")


@query(
    "gl8_secondary_pixels",
    f"""SELECT image_id, y, x, label FROM (SELECT p.image_id, p.y, p.x, l.label, sum(l.omega) part, any_value(w.total) total FROM gv p
         JOIN (SELECT a.image_id, a.y, a.x, sum(b.omega) total FROM g a JOIN g b ON a.image_id=b.image_id AND b.y {_DISC.format('a.y')} AND b.x {_DISC.format('a.x')} AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<={_R * _R!r}e0 GROUP BY ALL) w
           ON w.image_id=p.image_id AND w.y=p.y AND w.x=p.x
         JOIN lab_w l ON l.image_id=p.image_id AND l.y {_DISC.format('p.y')} AND l.x {_DISC.format('p.x')} AND (l.x-p.x)*(l.x-p.x)+(l.y-p.y)*(l.y-p.y)<={_R * _R!r}e0
         WHERE p.lum<=700e0 GROUP BY ALL) WHERE part>0.2e0*total""",
    "g gv lab_w",
)
def gl8(spark, sf):
    """Sources above 700 cd/m², so that neighbourhoods hold several of their pixels."""
    g = X.geo(spark, sf)
    return L.secondary_pixels(g, L.group_sources(L.source_pixels(g, 700.0)), _R)


view("labx", "SELECT * FROM lab", "lab")
view("peakpx", "SELECT image_id, y, x, lum, omega, dx, dy, dz, label AS parent FROM labx WHERE lum>=8000e0", "labx")
_closure("peaks", "peakpx", ["image_id", "parent"], "cos(0.1e0)")
view(
    "split",
    """SELECT image_id, y, x, lum, omega, dx, dy, dz, label FROM labx WHERE lum<8000e0 UNION ALL SELECT image_id, y, x, lum, omega, dx, dy, dz, -(label+1) FROM peaks""",
    "labx peaks",
)


def split(spark, sf):
    return L.split_peaks(labelled(spark, sf), 8000.0)


@query("gl9_split_peaks", "SELECT image_id, y, x, label FROM split", "split")
def gl9(spark, sf):
    return split(spark, sf).select(*PXK, "label")


# Directions and position index of every pixel of the frame, also of those outside the circle, where a centroid may fall
view(
    "framepos",
    """SELECT y, x, dx, dy, dz, least(16e0, CASE WHEN dz<0 THEN exp(6.49e0/1000e0*beta+21e0/100000e0*beta*beta)
          ELSE exp((35.2e0-0.31889e0*tau-1.22e0*exp(-2e0*tau/9e0))/1000e0*sg+(21e0+0.26667e0*tau-0.002963e0*tau*tau)/100000e0*sg*sg) END) p
     FROM (SELECT *, atan(tan(sg*3.1415927e0/180e0)*sqrt(1e0+0.3225e0*pow(cos(tau*3.1415927e0/180e0),2)))*180e0/3.1415927e0 beta
     FROM (SELECT *, acos(greatest(-1e0,least(1e0,dy)))*180e0/3.1415927e0 sg,
             acos(greatest(-1e0,least(1e0,dz/sqrt(dx*dx+dz*dz)*CASE WHEN dy<0 THEN -1e0 ELSE 1e0 END)))*180e0/3.1415927e0 tau FROM geo))""",
    "geo",
)


def _chain(sfx, keys, valid, lab, spots="(SELECT DISTINCT y, x, dx, dy, dz, p FROM posidx WHERE image_id=0)", needs="posidx"):
    """Views of the steps from labelled pixels to one row per source with its picture's values."""
    k, t = ", ".join(keys), f"tot{sfx}"
    if sfx:
        view(t, f"SELECT {k}, sum(omega) omega, sum(dy*omega*lum) ev, sum(lum*omega)/sum(omega) lum_mean, max(lum) lum_max FROM {valid} GROUP BY {k}", valid)
    view(
        f"sources{sfx}",
        f"""SELECT {k}, label, count(*) n_px, sum(omega) omega, sum(lum*omega)/sum(omega) lum, sum(omega*lum*x)/sum(omega*lum) cx, sum(omega*lum*y)/sum(omega*lum) cy, min(lum) lum_min, max(lum) lum_max,
         sum(dy*omega*lum) e_glare FROM {lab} GROUP BY {k}, label""",
        lab,
    )
    view(
        f"placed{sfx}",
        f"""SELECT s.*, p.dx, p.dy, p.dz, acos(greatest(-1e0,least(1e0,p.dy))) sigma, acos(greatest(-1e0,least(1e0,p.dy)))*180e0/3.1415927e0 theta, p.p pos
       FROM (SELECT *, floor(round(cx,9))::INT px, (63-floor(round(63-cy,9)))::INT py FROM sources{sfx}) s JOIN {spots} p ON p.y=s.py AND p.x=s.px""",
        f"sources{sfx} {needs}",
    )
    view(f"agg_s{sfx}", f"SELECT {k}, sum(e_glare) e_dir, sum(omega) os, sum(lum*omega) ls FROM placed{sfx} GROUP BY {k}", f"placed{sfx}")
    view(
        f"perimg{sfx}",
        f"""SELECT s.*, t.ev, t.lum_mean, (t.ev-a.e_dir)/3.1415927e0 lb, a.e_dir, t.ev/3.1415927e0 la, 2e0*pi()*(1e0-cos(radians(least(6.552e0, CASE WHEN base>0 THEN 2.346e0*(pow(CASE WHEN base>0 THEN base END,2.02609e0*sigma)+0.238658e0) ELSE 2.346e0*0.238658e0 END)))) lim
       FROM (SELECT *, cos(atan2(abs(dx),abs(dz)))*(sigma-0.230914e0)+sigma-0.284456e0 base FROM placed{sfx}) s JOIN {t} t USING ({k}) JOIN agg_s{sfx} a USING ({k})""",
        f"placed{sfx} {t} agg_s{sfx}",
    )


_chain("", ["image_id"], "gv", "labx")
_chain("_f", ["image_id"], "gv", "labx", "framepos", "framepos")


def sources(spark, sf):
    return L.source_table(labelled(spark, sf))


@query("gl10_source_table", "SELECT image_id, label, n_px, omega, lum, cx, cy, lum_min, lum_max FROM sources", "sources", "omega lum cx cy lum_min lum_max")
def gl10(spark, sf):
    return sources(spark, sf).select("image_id", "label", "n_px", "omega", "lum", "cx", "cy", "lum_min", "lum_max")


@query("gl11_direct_illuminance", "SELECT image_id, label, e_glare, sum(e_glare) OVER (PARTITION BY image_id) e_dir FROM sources", "sources", "e_glare e_dir")
def gl11(spark, sf):
    s = sources(spark, sf).select("image_id", "label", "e_glare")
    return s.join(s.groupBy("image_id").agg(F.sum("e_glare").alias("e_dir")), "image_id")


def placed(spark, sf):
    return L.locate(sources(spark, sf))


@query("gl12_locate", "SELECT image_id, label, px, py, dx, dy, dz, sigma, pos FROM placed_f", "placed_f", "dx dy dz sigma pos")
def gl12(spark, sf):
    return placed(spark, sf).select("image_id", "label", "px", "py", "dx", "dy", "dz", "sigma", "pos")


@query(
    "gl13_background",
    """SELECT image_id, (ev-coalesce(e_dir,0e0))/3.1415927e0 cosine, CASE WHEN os IS NULL THEN lum_mean ELSE (omega*lum_mean-ls)/(omega-os) END mean, ev/3.1415927e0 total FROM tot_f LEFT JOIN agg_s_f USING (image_id)""",
    "tot_f agg_s_f",
    "cosine mean total",
)
def gl13(spark, sf):
    s, t = placed(spark, sf), L.totals(X.geo(spark, sf))
    out = None
    for m in ("cosine", "mean", "total"):
        r = L.glare_indices(s, t, background_mode=m).select("image_id", F.col("lum_backg").alias(m))
        out = r if out is None else out.join(r, "image_id")
    return out


def indices(spark, sf, **kw):
    return L.glare_indices(placed(spark, sf), L.totals(X.geo(spark, sf)), **kw)


# The indices of pictures with sources, and their values where a picture has none
_T = "(1e0/(1e0+0.3275911e0*abs(z)))"
_ERF = f"(sign(z)*(1e0-(((((1.061405429e0*{_T}-1.453152027e0)*{_T})+1.421413741e0)*{_T}-0.284496736e0)*{_T}+0.254829592e0)*{_T}*exp(-z*z)))"
_DG = "least(1e0, 5.87e-5*any_value(ev)+0.159e0+0.092e0*log10(1e0+sum(lum*lum/pow(pos,2e0)*omega)/pow(any_value(ev),1.87e0)))"
_LOW = "CASE WHEN {0}<1000 THEN exp(0.024e0*{0}-4e0)/(1e0+exp(0.024e0*{0}-4e0)) ELSE 1e0 END*0.9e0"
_U = "sum(pow(lum/pos,2e0)*omega)"
_DGR = "pow(sum(0.5e0*lum*(20.4e0*omega+1.52e0*pow(omega,0.2e0)-0.075e0)/(pos*pow(lum_mean,0.44e0))), pow(count(*)::DOUBLE,-0.0914e0))"
_VCP = f"list_transform([{_DGR}], lambda d: CASE WHEN d>750 THEN 0e0 WHEN d<20 THEN 100e0 ELSE 50e0*{_ERF.replace('z', '((6.374e0-1.3227e0*ln(d))/1.414213562373e0)')}+50e0 END)[1]"
_NONE = "least(1e0, 5.87e-5*t.ev+0.159e0)"
INDEX = {
    "dgp": (_DG, _NONE), "dgp_low": (f"{_DG}*{_LOW.format('any_value(ev)')}", f"{_NONE}*{_LOW.format('t.ev')}"),
    "dgi": ("10e0*log10(sum(0.478e0*pow(lum,1.6e0)*pow(omega/pos/pos,0.8e0)/(lb+0.07e0*sqrt(omega)*lum)))", "0e0"),
    "dgi_mod": ("10e0*log10(sum(0.478e0*pow(lum,1.6e0)*pow(omega/pos/pos,0.8e0)/(pow(la,0.85e0)+0.07e0*sqrt(omega)*lum)))", "0e0"),
    "ugr": (f"8e0*log10(0.25e0/any_value(lb)*{_U})", "0e0"), "ugr_exp": ("8e0*log10(any_value(la))+8e0*log10(sum(lum*omega/pos/pos)/any_value(lb))", "0e0"),
    "ugp": (f"0.26e0*log10(0.25e0/any_value(lb)*{_U})", "0e0"), "ugp2": (f"1e0/pow(1e0+2e0/7e0*pow({_U}/any_value(lb),-0.2e0),10e0)", "0e0"),
    "dgr": (_DGR, "0e0"), "vcp": (_VCP, "100e0"), "cgi": (f"8e0*log10(2e0*(1e0+any_value(e_dir)/500e0)/any_value(ev)*{_U})", "0e0"),
    "lveil": ("5e0*sum(lum*cos(sigma+1e-11)*omega/(180e0/3.1415927e0*sigma+1e-11))", "0e0"), "lveil_cie": ("sum(10e0*e_glare/(theta*theta+1e-16))", "0e0"),
    "dgm": ("least(1e0, 5.87e-5*any_value(ev)+0.159e0+0.092e0*log10(1e0+sum(lum*lum*omega*omega/(greatest(omega,lim,1e-16)*pos*pos))/pow(any_value(ev),1.87e0)))", _NONE),
    "n_sources": ("count(*)", "0"), "e_v": ("any_value(ev)", "t.ev"),
}


def _index_sql(names, sfx="", keys=("image_id",)):
    k = ", ".join(keys)
    some = ", ".join(f"{INDEX[n][0]} {n}" for n in names.split())
    return f"""SELECT {k}, {', '.join(f'coalesce(s.{n}, {INDEX[n][1]}) {n}' for n in names.split())} FROM tot{sfx} t LEFT JOIN (SELECT {k}, {some} FROM perimg{sfx} GROUP BY {k}) s USING ({k})"""


@query("gl14_dgp", _index_sql("dgp dgp_low"), "tot perimg", "dgp dgp_low")
def gl14(spark, sf):
    a = indices(spark, sf).select("image_id", "dgp")
    b = indices(spark, sf, low_light=True, age_factor=0.9).select("image_id", F.col("dgp").alias("dgp_low"))
    return a.join(b, "image_id")


@query("gl15_dgi", _index_sql("dgi dgi_mod", "_f"), "tot_f perimg_f", "dgi dgi_mod")
def gl15(spark, sf):
    return indices(spark, sf).select("image_id", "dgi", "dgi_mod")


@query("gl16_ugr", _index_sql("ugr ugr_exp ugp ugp2", "_f"), "tot_f perimg_f", "ugr ugr_exp ugp ugp2")
def gl16(spark, sf):
    return indices(spark, sf).select("image_id", "ugr", "ugr_exp", "ugp", "ugp2")


@query("gl17_dgr_vcp", _index_sql("dgr vcp", "_f"), "tot_f perimg_f", "dgr vcp")
def gl17(spark, sf):
    return indices(spark, sf).select("image_id", "dgr", "vcp")


@query("gl18_cgi", _index_sql("cgi", "_f"), "tot_f perimg_f", "cgi")
def gl18(spark, sf):
    return indices(spark, sf).select("image_id", "cgi")


@query("gl19_veil", _index_sql("lveil lveil_cie", "_f"), "tot_f perimg_f", "lveil lveil_cie")
def gl19(spark, sf):
    return indices(spark, sf).select("image_id", "lveil", "lveil_cie")


_LB = "((2e0*3.14159265359e0*lum_mean-ml*mo)/(2e0*3.14159265359e0-mo))"


@query(
    "gl20_pgsv",
    f"""SELECT image_id, con pgsv_con, sat pgsv_sat, CASE WHEN ml/lb2>ev/(3.14159265359e0*lum_mean) THEN con ELSE sat END pgsv FROM
       (SELECT *, 3.2e0*log10(ml)-0.64e0*log10(mo)+(0.79e0*log10(mo)-0.61e0)*log10(lb2)-8.2e0 con, 3.3e0-(0.57e0+3.3e0)/(1e0+pow(ev/3.14159265359e0/1250e0,1.7e0)) sat FROM
       (SELECT *, {_LB} lb2 FROM (SELECT image_id, sum(lum*omega)/sum(omega) ml, sum(omega) mo FROM gv JOIN mask_a USING (image_id, y, x) WHERE weight>0.1e0 GROUP BY image_id) JOIN tot USING (image_id)))""",
    "gv mask_a tot",
    "pgsv_con pgsv_sat pgsv",
)
def gl20(spark, sf):
    g = X.geo_valid(spark, sf)
    m = L.zone_statistics(RG.luminance_mask(g, mask_a(X.px(spark, sf))), ["image_id"]).select("image_id", F.col("av_lum").alias("mask_lum"), F.col("omega").alias("mask_omega"))
    t = L.totals(g).select("image_id", "ev", "lum_mean", F.col("lum_mean").alias("task_lum"))
    return L.pgsv(t.join(m, "image_id")).select("image_id", "pgsv_con", "pgsv_sat", "pgsv")


@query("gl21_dgm", _index_sql("dgm"), "tot perimg", "dgm")
def gl21(spark, sf):
    return indices(spark, sf).select("image_id", "dgm")


@query(
    "gl22_contributions",
    f"""SELECT image_id, label, part/(0.092e0*log10(1e0+sum(q) OVER w/pow(ev,1.87e0))) r_contrast, part/dgp r_dgp, 10e0*e_glare/(theta*theta+1e-16) lveil_cie, theta FROM
        (SELECT *, lum*lum*omega/(pos*pos) q, 0.092e0*log10(1e0+lum*lum*omega/(pos*pos)/pow(ev,1.87e0)) part FROM perimg_f) JOIN (SELECT image_id, {_DG} dgp FROM perimg_f GROUP BY image_id) USING (image_id)
        WINDOW w AS (PARTITION BY image_id)""",
    "perimg_f",
    "r_contrast r_dgp lveil_cie theta",
)
def gl22(spark, sf):
    return L.contributions(placed(spark, sf), L.totals(X.geo(spark, sf))).select("image_id", "label", "r_contrast", "r_dgp", "lveil_cie", "theta")


_ZS = """count(*) n_px, sum(omega) omega, sum(lum*omega)/sum(omega) av_lum, stddev_pop(lum) std_lum, min(lum) lum_min, max(lum) lum_max, sum(dy*omega*lum) ev, median(lum) median_lum,
 (max(lum) FILTER (i=trunc(n*0.75e0))+max(lum) FILTER (i=trunc(n*0.75e0-1e0)))/2e0 perc_75, (max(lum) FILTER (i=trunc(n*0.95e0))+max(lum) FILTER (i=trunc(n*0.95e0-1e0)))/2e0 perc_95"""


@query(
    "gl23_zone_statistics",
    f"SELECT image_id, zone::INT zone, {_ZS} FROM (SELECT *, row_number() OVER (PARTITION BY image_id, zone ORDER BY lum)-1 i, count(*) OVER (PARTITION BY image_id, zone) n FROM zones) GROUP BY image_id, zone",
    "zones",
    "omega av_lum std_lum lum_min lum_max ev median_lum perc_75 perc_95",
)
def gl23(spark, sf):
    return L.zone_statistics(X.geo_valid(spark, sf).withColumn("zone", RG.zone(ZDIR, 0.6, 1.4)), ["image_id", "zone"])


@query(
    "gl24_split_by_zone",
    """SELECT image_id, label, zone::INT zone, count(*) n_px, sum(omega) omega, sum(dy*omega*lum) e_glare FROM labx JOIN (SELECT image_id, y, x, zone FROM zones) USING (image_id, y, x) GROUP BY ALL""",
    "labx zones",
    "omega e_glare",
)
def gl24(spark, sf):
    return L.split_by_zone(labelled(spark, sf), ZDIR, 0.6, 1.4).select("image_id", "label", "zone", "n_px", "omega", "e_glare")


@query("gl25_renumber", "SELECT image_id, label, dense_rank() OVER (PARTITION BY image_id ORDER BY label)::INT source_id FROM sources", "sources")
def gl25(spark, sf):
    return L.renumber(sources(spark, sf)).select("image_id", "label", "source_id")


view(
    "scanned",
    """SELECT g.* EXCLUDE (lum), 1::INT overlay_id, scan::INT scan, CASE WHEN y BETWEEN 20 AND 27 AND x BETWEEN 20 AND 27 THEN lum*5e0*factor ELSE lum END lum
       FROM gv g, (SELECT unnest([0, 1]) scan, unnest([1e0, 2.5e0]) factor)""",
    "gv",
)
view("srcpx_m", "SELECT image_id, overlay_id, scan, y, x, lum, omega, dx, dy, dz FROM scanned WHERE lum>2000e0", "scanned")
_closure("lab_m", "srcpx_m", ["image_id", "overlay_id", "scan"], "cos(0.1e0)")
_chain("_m", ["image_id", "overlay_id", "scan"], "scanned", "lab_m", "framepos", "framepos")


@query("gl26_multi_picture", _index_sql("n_sources dgp dgi ugr e_v", "_m", ("image_id", "overlay_id", "scan")), "tot_m perimg_m", "dgp dgi ugr e_v")
def gl26(spark, sf):
    """A bright rectangle of each picture overlaid at two scales; a picture captured only outside the rectangle stays as it is."""
    g = X.geo(spark, sf)
    every = g.filter("valid").select("image_id", F.lit(1).alias("overlay_id"))
    ov = RG.rect(g, 20, 20, 8, 8).select("image_id", F.lit(1).alias("overlay_id"), "y", "x", (F.col("lum") * 5.0).alias("value"))
    return L.multi_picture(g, ov, (1.0, 2.5), placed_on=every).select("image_id", "overlay_id", "scan", "n_sources", "dgp", "dgi", "ugr", "e_v")


@query("gl27_position_picture", "SELECT image_id, y, x, p, lum/p weighted FROM posidx", "posidx", "p weighted")
def gl27(spark, sf):
    g = G.with_position_index(X.geo_valid(spark, sf), "p")
    return g.select(*PXK, "p", (F.col("lum") / F.col("p")).alias("weighted"))


@query("io10_summary_text", f"SELECT image_id, printf('dgp,dgi,ugr: %.4f %.4f %.4f', dgp, dgi, ugr) line FROM ({_index_sql('dgp dgi ugr')})", "tot perimg")
def io10(spark, sf):
    return indices(spark, sf).select("image_id", TB.summary_line(("dgp", "dgi", "ugr"), 4).alias("line"))


_chain("_p", ["image_id"], "gv", "split", "framepos", "framepos")


@query("glare_evaluate", _index_sql("n_sources dgp dgi ugr vcp cgi lveil dgm", "_p"), "tot_p perimg_p", "dgp dgi ugr vcp cgi lveil dgm")
def glare_evaluate(spark, sf):
    """Whole chain with peaks split."""
    return L.evaluate(X.geo(spark, sf), split=8000.0).select("image_id", "n_sources", "dgp", "dgi", "ugr", "vcp", "cgi", "lveil", "dgm")
