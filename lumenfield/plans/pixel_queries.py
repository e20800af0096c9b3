"""Queries on single pixels, geometry, regions and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions import colour as C
from lumenfield.functions import geometry as G
from lumenfield.functions.numeric import c
from lumenfield.operators import geometry as OG
from lumenfield.operators import stats as S
from lumenfield.plans import fixtures as X
from lumenfield.plans.registry import query
from lumenfield.plans.views import view

# --- minimum slice ---


@query(
    "capture_summary",
    """SELECT image_id, count(*) n_px, sum(omega) omega_sr, sum(lum*omega)/sum(omega) lum_mean, max(lum) lum_max,
       sum(dy*omega*lum) ev_lux FROM gv GROUP BY image_id""",
    "gv",
    "omega_sr lum_mean lum_max ev_lux",
)
def capture_summary(spark, sf):
    return S.capture_summary(X.geo(spark, sf))


# --- colour ---

CAM = (0.8, -0.1, 0.05, -0.2, 1.1, 0.1, 0.02, -0.15, 0.9)


@query(
    "co1_matrix",
    """SELECT image_id, y, x, 0.8e0*r-0.1e0*g+0.05e0*b r, -0.2e0*r+1.1e0*g+0.1e0*b g, 0.02e0*r-0.15e0*g+0.9e0*b b FROM px""",
    "px",
    "r g b",
)
def co1(spark, sf):
    from lumenfield.operators.colour import apply_matrix

    return apply_matrix(X.px(spark, sf), CAM).select("image_id", "y", "x", "r", "g", "b")


INV3 = """SELECT *, a*(e*i-f*h)-b*(d*i-f*g)+c*(d*h-e*g) det FROM ({src})"""

view(
    "camprofile",
    """SELECT image_id, 0.8e0+0.01e0*(image_id%5) m0, -0.1e0 m1, 0.05e0 m2, -0.2e0 m3, 1.1e0 m4, 0.1e0 m5, 0.02e0 m6, -0.15e0 m7, 0.9e0 m8 FROM images""",
    "images",
)


def _prim_sql(rx, ry, gx, gy, bx, by, wx, wy):
    """RGB → XYZ matrix of fixed primaries as a one-row view, solved by Cramer's rule."""
    m = [rx, gx, bx, ry, gy, by, f"(1e0-{rx}-{ry})", f"(1e0-{gx}-{gy})", f"(1e0-{bx}-{by})"]
    w = [f"({wx}/{wy})", "1e0", f"((1e0-{wx}-{wy})/{wy})"]

    def det(q):
        return f"({q[0]}*({q[4]}*{q[8]}-{q[5]}*{q[7]})-{q[1]}*({q[3]}*{q[8]}-{q[5]}*{q[6]})+{q[2]}*({q[3]}*{q[7]}-{q[4]}*{q[6]}))"

    cols = []
    for k in range(3):
        q = list(m)
        for row in range(3):
            q[3 * row + k] = w[row]
        cols.append(f"{det(q)}/{det(m)}")
    return f"SELECT " + ", ".join(f"{m[3 * i + j]}*({cols[j]}) p{3 * i + j}" for i in range(3) for j in range(3))


E = "{}e0".format
view("prim_rad", _prim_sql(*(E(v) for v in C.RAD_PRIMARIES)))
view("prim_srgb", _prim_sql(*(E(v) for v in C.SRGB_PRIMARIES)))


def _inv_sql(m):
    """Nine cofactor expressions over their determinant."""
    a, b, cc, d, e, f, g, h, i = m
    det = f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{cc}*({d}*{h}-{e}*{g}))"
    cof = [
        f"{e}*{i}-{f}*{h}", f"{cc}*{h}-{b}*{i}", f"{b}*{f}-{cc}*{e}",
        f"{f}*{g}-{d}*{i}", f"{a}*{i}-{cc}*{g}", f"{cc}*{d}-{a}*{f}",
        f"{d}*{h}-{e}*{g}", f"{b}*{g}-{a}*{h}", f"{a}*{e}-{b}*{d}",
    ]
    return [f"({q})/{det}" for q in cof]


def _mul_sql(a, b):
    return ["(" + "+".join(f"({a[3 * i + k]})*({b[3 * k + j]})" for k in range(3)) + ")" for i in range(3) for j in range(3)]


_M = [f"m{i}" for i in range(9)]
_RC = _mul_sql(_M, [f"p{i}" for i in range(9)])
_SUM = [f"({_RC[3 * i]}+{_RC[3 * i + 1]}+{_RC[3 * i + 2]})" for i in range(3)]


@query(
    "co2_camera_matrices",
    " UNION ALL ".join(
        [
            f"SELECT image_id, '{t}' target, "
            + ", ".join(f"{q} k{i}" for i, q in enumerate(_inv_sql([f"q{i}" for i in range(9)])))
            + ", p3 l0, p4 l1, p5 l2, s0/greatest(s0,s1,s2) w0, s1/greatest(s0,s1,s2) w1, s2/greatest(s0,s1,s2) w2 FROM (SELECT image_id, p3, p4, p5, "
            + ", ".join(f"{q} q{i}" for i, q in enumerate(_RC))
            + ", "
            + ", ".join(f"{q} s{i}" for i, q in enumerate(_SUM))
            + f" FROM camprofile, prim_{t})"
            for t in ("rad", "srgb")
        ]
        + [
            "SELECT image_id, 'xyz' target, "
            + ", ".join(f"{q} k{i}" for i, q in enumerate(_inv_sql(_M)))
            + ", 0e0 l0, 1e0 l1, 0e0 l2, 1e0 w0, 1e0 w1, 1e0 w2 FROM camprofile"
        ]
    ),
    "camprofile prim_rad prim_srgb",
    " ".join([f"k{i}" for i in range(9)] + ["l0 l1 l2 w0 w1 w2"]),
)
def co2(spark, sf):
    prof = X.px(spark, sf).select("image_id").distinct()
    m = [c(0.8) + F.lit(0.01) * (F.col("image_id") % 5)] + [c(v) for v in CAM[1:]]
    out = None
    for t in ("rad", "srgb", "xyz"):
        part = C.with_camera_matrices(prof.withColumn("target", F.lit(t)), m, t)
        out = part if out is None else out.unionByName(part)
    return out


_KIND = "CASE image_id%4 WHEN 0 THEN 'rad' WHEN 1 THEN 'srgb' WHEN 2 THEN 'xyz' ELSE 'xyz_cdm2' END"


def _kind():
    k = F.col("image_id") % 4
    return F.when(k == 0, "rad").when(k == 1, "srgb").when(k == 2, "xyz").otherwise("xyz_cdm2")


view(
    "xyz",
    f"""SELECT *, CASE WHEN kind IN ('xyz','xyz_cdm2') THEN s*r WHEN kind='srgb' THEN s*(0.4124564e0*r+0.3575761e0*g+0.1804375e0*b)
            ELSE s*(0.51408315e0*r+0.32388874e0*g+0.16202811e0*b) END cx,
       CASE WHEN kind IN ('xyz','xyz_cdm2') THEN s*g WHEN kind='srgb' THEN s*(0.2126729e0*r+0.7151522e0*g+0.0721750e0*b)
            ELSE s*(0.26507413e0*r+0.67011463e0*g+0.06481124e0*b) END cy,
       CASE WHEN kind IN ('xyz','xyz_cdm2') THEN s*b WHEN kind='srgb' THEN s*(0.0193339e0*r+0.1191920e0*g+0.9503041e0*b)
            ELSE s*(0.02409765e0*r+0.12285435e0*g+0.85334803e0*b) END cz
   FROM (SELECT *, {_KIND} kind, CASE WHEN image_id%4=3 THEN 1e0 ELSE 179e0 END s FROM px)""",
    "px",
)


def _with_xyz(spark, sf):
    px = X.px(spark, sf)
    k = C.to_xyz(_kind())
    return px.withColumns({"kind": _kind(), "cx": k[0], "cy": k[1], "cz": k[2]})


XYZ = ("cx", "cy", "cz")


@query("co3_to_xyz", "SELECT image_id, y, x, kind, cx, cy, cz FROM xyz", "xyz", "cx cy cz")
def co3(spark, sf):
    return _with_xyz(spark, sf).select("image_id", "y", "x", "kind", *XYZ)


@query(
    "co4_luminance",
    """SELECT image_id, y, x, 179e0*(0.265e0*r+0.670e0*g+0.065e0*b)/(1e0+image_id%3) lum, 179e0*g mono FROM px""",
    "px",
    "lum mono",
)
def co4(spark, sf):
    px = X.px(spark, sf)
    return px.select(
        "image_id", "y", "x",
        C.luminance(exposure=F.lit(1.0) + F.col("image_id") % 3).alias("lum"),
        C.luminance(monochrome=F.lit(True)).alias("mono"),
    )


_LAB = "CASE WHEN {q} > 216e0/24389e0 THEN cbrt({q}) ELSE (24389e0/27e0*{q}+16e0)/116e0 END"


@query(
    "co5_xy_yuv_lab",
    f"""SELECT image_id, y, x, cx/(cx+cy+cz) chx, cy/(cx+cy+cz) chy, 4e0*cx/(cx+15e0*cy+3e0*cz) u, 9e0*cy/(cx+15e0*cy+3e0*cz) v,
        116e0*fy-16e0 lab_l, 500e0*(fx-fy) lab_a, 200e0*(fy-fz) lab_b
   FROM (SELECT *, {_LAB.format(q='(cx/950e0)')} fx, {_LAB.format(q='(cy/1000e0)')} fy, {_LAB.format(q='(cz/1089e0)')} fz FROM xyz)""",
    "xyz",
    "chx chy u v lab_l lab_a lab_b",
)
def co5(spark, sf):
    df = _with_xyz(spark, sf)
    xy, yuv, lab = C.xyz_to_xy(XYZ), C.xyz_to_yuv(XYZ), C.xyz_to_lab(XYZ, (950.0, 1000.0, 1089.0))
    return df.select(
        "image_id", "y", "x", xy[0].alias("chx"), xy[1].alias("chy"), yuv[1].alias("u"), yuv[2].alias("v"),
        lab[0].alias("lab_l"), lab[1].alias("lab_a"), lab[2].alias("lab_b"),
    )


@query(
    "co6_white_balance",
    """SELECT image_id, y, x, r*3e0*ir/(ir+ig+ib) r, g*3e0*ig/(ir+ig+ib) g, b*3e0*ib/(ir+ig+ib) b
   FROM px JOIN (SELECT image_id, 1e0/sum(r) ir, 1e0/sum(g) ig, 1e0/sum(b) ib FROM px WHERE x BETWEEN 10 AND 25 AND y BETWEEN 12 AND 19 GROUP BY image_id) USING (image_id)""",
    "px",
    "r g b",
)
def co6(spark, sf):
    from lumenfield.operators.colour import white_balance_patch

    return white_balance_patch(X.px(spark, sf), 10, 12, 16, 8).select("image_id", "y", "x", "r", "g", "b")


@query(
    "co7_scale",
    "SELECT image_id, y, x, r*2.5e0/(1e0+image_id%3) r, g*2.5e0/(1e0+image_id%3) g, b*2.5e0/(1e0+image_id%3) b FROM px",
    "px",
    "r g b",
)
def co7(spark, sf):
    from lumenfield.operators.colour import scale

    return scale(X.px(spark, sf), 2.5, exposure=F.lit(1.0) + F.col("image_id") % 3).select("image_id", "y", "x", "r", "g", "b")


view(
    "scot",
    """SELECT *, greatest(0e0, greatest(cy,0e0)*(1.33e0*(1e0+(greatest(cy,0e0)+greatest(cz,0e0))/greatest(cx,1e-8))-1.68e0)) s_xyz,
         412e0*(0.062e0*r+0.608e0*g+0.330e0*b) s_rgb FROM xyz""",
    "xyz",
)


@query("co8_scotopic", "SELECT image_id, y, x, s_xyz, s_rgb FROM scot", "scot", "s_xyz s_rgb")
def co8(spark, sf):
    return _with_xyz(spark, sf).select(
        "image_id", "y", "x", C.scotopic_from_xyz(XYZ).alias("s_xyz"), C.scotopic_from_rgb().alias("s_rgb")
    )


_FA = "(-0.0054e0-0.21e0*{x}+0.77e0*{y}+1.44e0*{x}*{x}-2.97e0*{x}*{y}+1.59e0*{y}*{y}-2.11e0*(1e0-{x}-{y})*{y}*{y})"
_S555 = "(0.5120501e0+1e0+0.005749999e0)"


@query(
    "co9_equivalent_luminance",
    f"""SELECT image_id, y, x, CASE WHEN cy>0 AND s_rgb>0 AND fa>0 THEN pow(cy, cy/(cy+0.05e0))*pow(s_rgb, 1e0-cy/(cy+0.05e0))
           *exp(1.3e0*sqrt(cy)/(sqrt(cy)+2.24e0)*((ln(CASE WHEN fa>0 THEN fa END)/2e0-ln(qy))-(ln(f0)/2e0-ln(q0)))) ELSE 0e0 END eqv
      FROM (SELECT *, {_FA.format(x='qx', y='qy')} fa, {_FA.format(x='p0', y='q0')} f0 FROM
        (SELECT *, cx/(cx+cy+cz) qx, cy/(cx+cy+cz) qy, 0.5120501e0/{_S555} p0, 1e0/{_S555} q0 FROM scot))""",
    "scot",
    "eqv:5",
)
def co9(spark, sf):
    return _with_xyz(spark, sf).select(
        "image_id", "y", "x", C.equivalent_luminance(XYZ, C.scotopic_from_rgb()).alias("eqv")
    )


# --- geometry ---


@query(
    "ge1_equidistant",
    "SELECT image_id, y, x, nx, ny, theta, dx, dy, dz, omega, valid FROM g",
    "g",
    "nx ny theta dx dy dz omega",
)
def ge1(spark, sf):
    return X.geo(spark, sf).select("image_id", "y", "x", "nx", "ny", "theta", "dx", "dy", "dz", "omega", "valid")


@query(
    "ge1_crop_shift_lift",
    """SELECT image_id, y, x, CASE WHEN rr<=0.5e0 THEN (120e0*pi()/180e0)*(90e0*pi()/180e0)/4096e0*sin(th)/th ELSE 0e0 END omega,
        sin(th)*u/th dx, cos(th) dy, -sin(th)*v/th dz, rr<=0.5e0 valid
   FROM (SELECT *, sqrt(u*u+v*v) th, sqrt((nx*120e0/180e0)*(nx*120e0/180e0)+(ny*90e0/180e0)*(ny*90e0/180e0)) rr FROM
     (SELECT *, nx*120e0*pi()/180e0 u, ny*90e0*pi()/180e0 v FROM
       (SELECT image_id, y, x, (x+0.5e0)/64e0-0.5e0+0.1e0 nx, (y+0.5e0)/64e0-0.5e0+0.05e0 ny FROM px)))""",
    "px",
    "omega dx dy dz",
)
def ge1b(spark, sf):
    v = G.View("a", vh=120.0, vv=90.0, hoff=0.1, voff=-0.05, circle_h=180.0, circle_v=180.0)
    return OG.with_geometry(X.px(spark, sf), v).select("image_id", "y", "x", "omega", "dx", "dy", "dz", "valid")


# every picture takes one of six projections by its number: perspective, hemispherical, cylindrical, angular, planisphere, parallel
_TYPES = ("v", "h", "c", "a", "s", "l")
_DEG = {"v": (60, 45), "h": (180, 180), "c": (200, 60), "a": (180, 180), "s": (220, 220), "l": (10, 10)}


def _dir_sql(t, fx, fy):
    """(x, forward, up) text of one projection at picture fractions; written per type, not shared with the Spark formulas."""
    vh, vv = _DEG[t]
    a, b = f"({fx}-0.5e0)", f"({fy}-0.5e0)"
    if t == "l":
        return "0e0", "1e0", "0e0"
    if t == "v":
        p, q = f"({a}*2e0*tan(radians({vh / 2}e0)))", f"({b}*2e0*tan(radians({vv / 2}e0)))"
        n = f"sqrt(1e0+{p}*{p}+{q}*{q})"
        return f"{p}/{n}", f"1e0/{n}", f"{q}/{n}"
    if t == "h":
        p, q = f"({a}*2e0)", f"({b}*2e0)"
        ok = f"{p}*{p}+{q}*{q}<=1e0"
        return (f"CASE WHEN {ok} THEN {p} END", f"CASE WHEN {ok} THEN sqrt(greatest(0e0,1e0-{p}*{p}-{q}*{q})) END", f"CASE WHEN {ok} THEN {q} END")
    if t == "c":
        p, q = f"({a}*radians({vh}e0))", f"({b}*2e0*tan(radians({vv / 2}e0)))"
        n = f"sqrt(1e0+{q}*{q})"
        return f"sin({p})/{n}", f"cos({p})/{n}", f"{q}/{n}"
    if t == "a":
        p, q = f"({a}*{vh / 180}e0)", f"({b}*{vv / 180}e0)"
        d = f"sqrt({p}*{p}+{q}*{q})"
        k = f"(CASE WHEN {d}<=1e-6 THEN pi() ELSE sin(pi()*{d})/{d} END)"
        return f"{p}*{k}", f"cos(pi()*{d})", f"{q}*{k}"
    k = f"(2e0*sin(radians({vh / 2}e0))/(1e0+cos(radians({vh / 2}e0))))"
    p, q = f"({a}*{k})", f"({b}*{k})"
    z = f"((1e0-{p}*{p}-{q}*{q})/(1e0+{p}*{p}+{q}*{q}))"
    return f"{p}*(1e0+{z})", z, f"{q}*(1e0+{z})"


def _case_type(parts):
    return "CASE image_id%6 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


_DIRS = [_dir_sql(t, "fx", "fy") for t in _TYPES]


def _typed(df):
    k = F.col("image_id") % 6

    def pick(vals):
        e = F.when(k == 0, vals[0])
        for i, v in enumerate(vals[1:], 1):
            e = e.when(k == i, v)
        return e

    return df.withColumns({
        "vtype": pick([F.lit(t) for t in _TYPES]),
        "vh": pick([F.lit(float(_DEG[t][0])) for t in _TYPES]),
        "vv": pick([F.lit(float(_DEG[t][1])) for t in _TYPES]),
    })


@query(
    "ge2_all_projections",
    "SELECT image_id, y, x, " + ", ".join(f"{_case_type([d[i] for d in _DIRS])} {n}" for i, n in enumerate(("dx", "dy", "dz")))
    + " FROM (SELECT image_id, y, x, (x+0.5e0)/64e0 fx, 1e0-(y+0.5e0)/64e0 fy FROM px)",
    "px",
    "dx dy dz",
)
def ge2(spark, sf):
    df = _typed(X.px(spark, sf))
    v = G.View(F.col("vtype"), "vh", "vv", literal_type=False)
    return G.with_pixel_direction(df, v).select("image_id", "y", "x", "dx", "dy", "dz")


@query(
    "ge3_equisolid",
    """SELECT image_id, y, x, CASE WHEN r<=2e0 THEN 2e0*asin(least(1e0,r/2e0)) END theta, CASE WHEN r<=2e0 THEN u*sin(2e0*asin(least(1e0,r/2e0)))/r END dx,
        CASE WHEN r<=2e0 THEN cos(2e0*asin(least(1e0,r/2e0))) END dy, 8e0/4096e0 omega
    FROM (SELECT *, sqrt(u*u+v*v) r FROM (SELECT image_id, y, x, ((x+0.5e0)/64e0-0.5e0)*4e0*sin(pi()/4e0) u, ((y+0.5e0)/64e0-0.5e0)*4e0*sin(pi()/4e0) v FROM px))""",
    "px",
    "theta dx dy omega",
)
def ge3(spark, sf):
    g = G.equisolid("x", "y", "width", "height")
    return X.px(spark, sf).select("image_id", "y", "x", *[g[k].alias(k) for k in ("theta", "dx", "dy", "omega")])


@query("ge4_direction_to_pixel", "SELECT image_id, y, x, x px_x, y px_y FROM gv", "gv")
def ge4(spark, sf):
    df = X.geo_valid(spark, sf)
    ix, iy = G.angular_pixel(("dx", "dy", "dz"), "width", "height")
    return df.select("image_id", "y", "x", ix.alias("px_x"), iy.alias("px_y"))


@query(
    "ge5_solid_angle_sum",
    "SELECT image_id, sum(omega) omega, sum(1e0/4096e0) flat FROM g GROUP BY image_id",
    "g",
    "omega flat",
)
def ge5(spark, sf):
    df = X.geo(spark, sf)
    flat = F.lit(1.0) / (c("width") * c("height"))
    return df.groupBy("image_id").agg(F.sum("omega").alias("omega"), F.sum(flat).alias("flat"))


def _ge6_sql():
    """Spherical excess of two triangles (half-angle tangent formula), an independent way to the same solid angle."""
    corner = {
        "p": ("x/64e0", "1e0-y/64e0"), "q": ("(x+1)/64e0", "1e0-y/64e0"),
        "s": ("(x+1)/64e0", "1e0-(y+1)/64e0"), "t": ("x/64e0", "1e0-(y+1)/64e0"),
    }
    cols = []
    for n, (fx, fy) in corner.items():
        for i, d in enumerate(_dir_sql("v", fx, fy)):
            cols.append(f"{d} {n}{i}")
    def dt(a, b):
        return f"({a}0*{b}0+{a}1*{b}1+{a}2*{b}2)"
    def tri(a, b, e):
        num = f"abs({a}0*({b}1*{e}2-{b}2*{e}1)-{a}1*({b}0*{e}2-{b}2*{e}0)+{a}2*({b}0*{e}1-{b}1*{e}0))"
        return f"2e0*atan2({num}, 1e0+{dt(a, b)}+{dt(b, e)}+{dt(a, e)})"
    return f"SELECT image_id, y, x, {tri('p', 'q', 's')}+{tri('p', 's', 't')} omega FROM (SELECT image_id, y, x, {', '.join(cols)} FROM px)"


@query("ge6_quad_solid_angle", _ge6_sql(), "px", "omega")
def ge6(spark, sf):
    v = G.View("v", 60.0, 45.0)
    return G.with_quad_solid_angle(X.px(spark, sf), v).select("image_id", "y", "x", "omega")


def _corner(x, y):
    fx, fy = "(64e0/(2e0*tan(radians(30e0))))", "(64e0/(2e0*tan(radians(22.5e0))))"
    a, b = f"(({x}-32e0)/{fx})", f"(({y}-32e0)/{fy})"
    return f"atan({a}*{b}/sqrt(1e0+{a}*{a}+{b}*{b}))"


@query(
    "ge7_perspective_solid_angle",
    f"SELECT image_id, y, x, abs({_corner('(x+1)', '(y+1)')}-{_corner('(x+1)', 'y')}-{_corner('x', '(y+1)')}+{_corner('x', 'y')}) omega FROM px",
    "px",
    "omega:9",
)
def ge7(spark, sf):
    return X.px(spark, sf).select(
        "image_id", "y", "x", G.perspective_solid_angle("x", "y", "width", "height", 60.0, 45.0).alias("omega")
    )


@query(
    "ge8_angle_to_neighbour",
    "SELECT image_id, y, x, degrees(acos(greatest(-1e0,least(1e0,dx*0.6e0+dy*0.8e0)))) deg FROM gv",
    "gv",
    "deg",
)
def ge8(spark, sf):
    return X.geo_valid(spark, sf).select(
        "image_id", "y", "x", F.degrees(G.angle_between(("dx", "dy", "dz"), (0.6, 0.8, 0.0))).alias("deg")
    )


view(
    "sight",
    """SELECT *, acos(greatest(-1e0,least(1e0,dy)))*180e0/3.1415927e0 sg, acos(greatest(-1e0,least(1e0,dz/sqrt(dx*dx+dz*dz))))*180e0/3.1415927e0 tau,
        asin(dz)*180e0/3.1415927e0 phi FROM gv""",
    "gv",
)
view(
    "posidx",
    """SELECT *, least(16e0, CASE WHEN phi<0 THEN exp(6.49e0/1000e0*beta+21e0/100000e0*beta*beta)
          ELSE exp((35.2e0-0.31889e0*tau-1.22e0*exp(-2e0*tau/9e0))/1000e0*sg+(21e0+0.26667e0*tau-0.002963e0*tau*tau)/100000e0*sg*sg) END) p
     FROM (SELECT *, atan(tan(sg*3.1415927e0/180e0)*sqrt(1e0+0.3225e0*pow(cos(tau*3.1415927e0/180e0),2)))*180e0/3.1415927e0 beta FROM sight)""",
    "sight",
)


@query(
    "ge9_position_index",
    """SELECT image_id, y, x, p guth, exp((sg-(-0.000009e0*tau*tau*tau+0.0014e0*tau*tau+0.0866e0*tau+21.633e0))
          /(-0.000009e0*tau*tau*tau+0.0013e0*tau*tau+0.0853e0*tau+8.772e0)) kim FROM posidx""",
    "posidx",
    "guth kim",
)
def ge9(spark, sf):
    g = G.with_position_index(X.geo_valid(spark, sf), "guth")
    return G.with_position_index(g, "kim", "kim").select("image_id", "y", "x", "guth", "kim")


_UP = "(7.7458218e0+0.00057407915e0*tau-0.00021746318e0*tau*tau+8.5572726e-6*tau*tau*tau)"
_LO2 = "(1e0/(-0.014699242e0-1.5541106e-5*t+4.6898068e-6*t*t-5.1539687e-8*t*t*t))"
_LOC = "(CASE WHEN t>73 THEN 60e0 ELSE (68.227109e0-2.9524084e0*t+0.046674262e0*t*t)/(1e0-0.042317294e0*t+0.00075698419e0*t*t-6.5364285e-7*t*t*t) END)"


@query(
    "ge10_field_cut",
    f"""SELECT image_id, count(*) n_px, sum(CASE WHEN both_eyes THEN 1 ELSE 0 END)::BIGINT cut_both, sum(CASE WHEN central THEN 1 ELSE 0 END)::BIGINT cut_central,
        sum(lum/p*omega) weighted FROM (
        SELECT *, CASE WHEN phi>0 THEN sg>{_UP}*{_UP} ELSE (-sg<{_LO2} AND tau>135) END both_eyes,
           CASE WHEN phi>0 THEN sg>60 ELSE sg>{_LOC} END central FROM (SELECT *, 180e0-tau t FROM posidx)) GROUP BY image_id""",
    "posidx",
    "weighted:4",
)
def ge10(spark, sf):
    df = G.with_position_index(X.geo_valid(spark, sf), "p")
    df = G.with_field_cut(G.with_field_cut(df, "b"), "cen", "central")
    return df.groupBy("image_id").agg(
        F.count("*").alias("n_px"), F.count_if("b").alias("cut_both"), F.count_if("cen").alias("cut_central"),
        F.sum(F.col("lum") / F.col("p") * F.col("omega")).alias("weighted"),
    )


@query(
    "ge11_crop",
    "SELECT image_id, CAST(y-5 AS INT) y, CAST(x-10 AS INT) x, g FROM px WHERE x BETWEEN 10 AND 39 AND y BETWEEN 5 AND 44",
    "px",
    "g",
)
def ge11(spark, sf):
    return OG.crop(X.px(spark, sf), 10, 5, 30, 40).select("image_id", "y", "x", "g")


@query(
    "ge12_flip_rotate",
    """SELECT image_id, '90' op, x y, CAST(63-y AS INT) x, g FROM px UNION ALL SELECT image_id, '180x' op, CAST(63-y AS INT) y, x, g FROM px
       UNION ALL SELECT image_id, '270y' op, x y, y x, g FROM px""",
    "px",
    "g",
)
def ge12(spark, sf):
    px = X.px(spark, sf)
    out = None
    for op, deg, fl in (("90", 90, ""), ("180x", 180, "x"), ("270y", 270, "y")):
        p = OG.flip_rotate(px, deg, fl).select("image_id", F.lit(op).alias("op"), "y", "x", "g")
        out = p if out is None else out.unionByName(p)
    return out


def gather_sql(sx: str, sy: str, valid: str, clamped: bool, src: str = "px", keys: str = "image_id", n: int = 64) -> str:
    """Bilinear gather as a four-way left join; target pixels without source are 0."""
    lim = f"{n - 1}e0"
    cx = f"greatest(0e0,least({lim},{sx}))" if clamped else sx
    cy = f"greatest(0e0,least({lim},{sy}))" if clamped else sy
    ok = valid if clamped else f"({valid}) AND sx>=0 AND sy>=0 AND sx<={lim} AND sy<={lim}"
    k = keys.split(", ")
    on = lambda a, yy, xx: " AND ".join([f"{a}.{q}=t.{q}" for q in k] + [f"{a}.y={yy}", f"{a}.x={xx}"])
    w = {"a": "(1e0-tx)*(1e0-ty)", "b": "tx*(1e0-ty)", "c": "(1e0-tx)*ty", "d": "tx*ty"}
    out = ", ".join(
        f"CASE WHEN ok THEN {'+'.join(f'coalesce({a}.{ch},0e0)*{e}' for a, e in w.items())} ELSE 0e0 END {ch}" for ch in "rgb"
    )
    return f"""SELECT {', '.join('t.' + q for q in k)}, t.y, t.x, {out}
      FROM (SELECT *, floor(sx) x0, floor(sy) y0, sx-floor(sx) tx, sy-floor(sy) ty, {ok} ok FROM (SELECT *, {cx} sx, {cy} sy FROM {src})) t
      LEFT JOIN {src} a ON {on('a', 'y0', 'x0')} LEFT JOIN {src} b ON {on('b', 'y0', 'x0+1')}
      LEFT JOIN {src} c ON {on('c', 'y0+1', 'x0')} LEFT JOIN {src} d ON {on('d', 'y0+1', 'x0+1')}"""


def _rgb(df, keys=("image_id",)):
    return df.select(*keys, "y", "x", "r", "g", "b")


_CA, _SA = "cos(radians(17e0))", "sin(radians(17e0))"


@query(
    "ge13_rotate",
    gather_sql(f"{_CA}*(x-31.5e0)-{_SA}*(y-31.5e0)+31.5e0", f"{_SA}*(x-31.5e0)+{_CA}*(y-31.5e0)+31.5e0", "true", False),
    "px",
    "r g b",
)
def ge13(spark, sf):
    return _rgb(OG.rotate(X.px(spark, sf), 17.0))


def _lens(expr):
    """Source coordinates for a radial rule ``expr`` of the fraction radius ``q``."""
    q = "sqrt(((x+0.5e0)/64e0-0.5e0)*((x+0.5e0)/64e0-0.5e0)+((y+0.5e0)/64e0-0.5e0)*((y+0.5e0)/64e0-0.5e0))"
    s = expr.replace("q", q)
    return tuple(f"(0.5e0+(({a}+0.5e0)/64e0-0.5e0)*({s})/{q})*64e0-0.5e0" for a in "xy") + (f"{q}<=0.5e0",)


_E1 = _lens("sin(0.5e0*pi()*q)/sqrt(2e0)".replace("sqrt", "SQRT").replace("q)", "q)"))
_E2 = _lens("0.5e0*sin(pi()*q)")


@query("ge14_equisolid_to_equidistant", gather_sql(*_E1, True), "px", "r g b")
def ge14(spark, sf):
    return _rgb(OG.reproject(X.px(spark, sf), "equisolid"))


@query("ge15_hemispherical_to_equidistant", gather_sql(*_E2, True), "px", "r g b")
def ge15(spark, sf):
    return _rgb(OG.reproject(X.px(spark, sf), "hemispherical"))


LENS = (1.02, -0.05, 0.03, -0.02, 0.02)


def _newton_view(src, n):
    """Four Newton steps as nested subqueries; adds u."""
    k = [f"{v}e0" for v in LENS]
    f = "+".join(f"({v})*" + "*".join(["u"] * (i + 1)) for i, v in enumerate(k))
    d = "+".join(f"({i + 1}e0*({v}))" + "".join("*u" for _ in range(i)) for i, v in enumerate(k))
    q = f"SELECT *, sqrt((x+0.5e0-{n}e0)*(x+0.5e0-{n}e0)+(y+0.5e0-{n}e0)*(y+0.5e0-{n}e0)) rr FROM {src}"
    q = f"SELECT *, rr/{n}e0 tg, greatest(0e0,least(1e0,rr/{n}e0)) u FROM ({q})"
    for _ in range(4):
        q = f"SELECT * REPLACE (greatest(0e0,least(1e0,u-(({f})-tg)/({d}))) AS u) FROM ({q})"
    return q


view("lens5", _newton_view("px", 32), "px")


@query(
    "ge16_calibrated_lens",
    gather_sql("32e0+(x+0.5e0-32e0)*30e0*u/rr-0.5e0", "32e0+(y+0.5e0-32e0)*30e0*u/rr-0.5e0", "rr<=32e0", True, "lens5"),
    "lens5",
    "r g b",
)
def ge16(spark, sf):
    return _rgb(OG.reproject(X.px(spark, sf), "calibrated", coefficients=LENS, source_radius=30.0, target_radius=32.0))


ANGLE_POLY = (0.7, -0.02, 0.01)
view(
    "polylens",
    """SELECT *, 0.7e0*a-0.02e0*a*a+0.01e0*a*a*a u FROM (SELECT *, pi()/2e0*rr/32e0 a FROM
       (SELECT *, sqrt((x+0.5e0-32e0)*(x+0.5e0-32e0)+(y+0.5e0-32e0)*(y+0.5e0-32e0)) rr FROM px))""",
    "px",
)


@query(
    "ge17_angle_polynomial",
    gather_sql("32e0+(x+0.5e0-32e0)*31e0*u/rr-0.5e0", "32e0+(y+0.5e0-32e0)*31e0*u/rr-0.5e0", "rr<32e0 AND u>=0 AND u<1", True, "polylens"),
    "polylens",
    "r g b",
)
def ge17(spark, sf):
    return _rgb(OG.reproject(X.px(spark, sf), "angle_polynomial", coefficients=ANGLE_POLY, source_radius=31.0, target_radius=32.0))


_RAD = "((-0.005e0*{0}+k1)*{0}+k0)*{0}"


@query(
    "ge18_valid_half_angle",
    f"""SELECT * FROM (WITH RECURSIVE b AS (SELECT p_partkey lens_id, 0.5e0+p_size/100e0 k0, 0.01e0*(p_size%7) k1, 0e0 lo, pi()/2e0 hi, 0 i FROM part
         UNION ALL SELECT lens_id, k0, k1, CASE WHEN {_RAD.format('((lo+hi)*0.5e0)')}<1e0 THEN (lo+hi)*0.5e0 ELSE lo END, CASE WHEN {_RAD.format('((lo+hi)*0.5e0)')}<1e0 THEN hi ELSE (lo+hi)*0.5e0 END, i+1 FROM b WHERE i<80)
       SELECT lens_id, CASE WHEN {_RAD.format('(pi()/2e0)')}<=1e0 THEN pi()/2e0 ELSE (lo+hi)*0.5e0 END half_angle FROM b WHERE i=80)""",
    "",
    "half_angle:9",
)
def ge18(spark, sf):
    """Lens polynomials taken from the part table: one bisection per row."""
    p = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("lens_id"), F.array(F.lit(0.5) + F.col("p_size") / 100.0, F.lit(0.01) * (F.col("p_size") % 7), F.lit(-0.005)).alias("k")
    )
    return p.select("lens_id", OG.valid_half_angle(F.col("k")).alias("half_angle"))


view(
    "eyes",
    """SELECT image_id, 'left' eye, y, x, r, g, b FROM px WHERE y<32 AND x<32
       UNION ALL SELECT image_id, 'right', y, x-32, r, g, b FROM px WHERE y<32 AND x>=32""",
    "px",
)
view("eyelens", _newton_view("eyes", 16), "eyes")


@query(
    "ge19_stereo_split",
    gather_sql("16e0+(x+0.5e0-16e0)*15e0*u/rr-0.5e0", "16e0+(y+0.5e0-16e0)*15e0*u/rr-0.5e0", "rr<=16e0", True, "eyelens", "image_id, eye", 32),
    "eyelens",
    "r g b",
)
def ge19(spark, sf):
    df = OG.stereo_split(X.px(spark, sf), (0, 0, 32, 32), (32, 0, 32, 32), coefficients=LENS, source_radius=15.0, target_radius=16.0)
    return _rgb(df, ("image_id", "eye"))


def _resample_sql(dst, kind, n=64):
    """Taps by position: weight from the distance to every candidate sample, normalised per target."""
    s = f"({n}e0/{dst}e0)" if dst < n else "1e0"
    rad = "1e0" if kind == "tent" else "3e0"
    w = (
        "greatest(0e0,1e0-p)"
        if kind == "tent"
        else "CASE WHEN p<1e-4 THEN 1e0 WHEN p>3e0 THEN 0e0 ELSE sin(pi()*p)*sin(pi()*p/3e0)/(pi()*p*pi()*p/3e0) END"
    )
    return f"""SELECT {n} n, t, s, sum(w)/any_value(tot) wt FROM (SELECT *, sum(w) OVER (PARTITION BY t) tot FROM (SELECT t, greatest(0,least({n - 1},st+j)) s, {w} w
      FROM (SELECT t, st, j, abs((st+j+0.5e0-c)/{s}) p FROM (SELECT *, floor(c-{rad}*{s}+0.5e0)::INT st FROM
        (SELECT range::INT t, (range+0.5e0)/{dst}e0*{n}e0 c FROM range({dst}))), (SELECT range::INT j FROM range(floor({rad}*{s}*2e0)::INT))))) GROUP BY t, s"""


view("tent40", _resample_sql(40, "tent") + " UNION ALL " + _resample_sql(40, "tent", 32))
view("lan96", _resample_sql(96, "lanczos"))
# every second picture is cut to its upper left quarter
view("px_sizes", "SELECT *, CASE WHEN image_id%2=1 THEN 32 ELSE 64 END n FROM px WHERE image_id%2=0 OR (y<32 AND x<32)", "px")


def mixed_sizes(px):
    small = F.col("image_id") % 2 == 1
    size = F.when(small, F.lit(32)).otherwise(F.lit(64))
    return px.filter(~small | ((F.col("y") < 32) & (F.col("x") < 32))).withColumns({"width": size, "height": size})


@query(
    "ge20_resample",
    """SELECT image_id, 'tent' kind, tb.t y, ta.t x, sum(g*ta.wt*tb.wt) g FROM px_sizes p JOIN tent40 ta ON ta.s=x AND ta.n=p.n JOIN tent40 tb ON tb.s=y AND tb.n=p.n GROUP BY ALL
       UNION ALL SELECT image_id, 'lanczos', tb.t y, ta.t x, sum(g*ta.wt*tb.wt) g FROM px JOIN lan96 ta ON ta.s=x JOIN lan96 tb ON tb.s=y GROUP BY ALL""",
    "px px_sizes tent40 lan96",
    "g",
)
def ge20(spark, sf):
    px = X.px(spark, sf)
    a = OG.resample(mixed_sizes(px), (40, 40), "tent", ("g",)).withColumn("kind", F.lit("tent"))
    b = OG.resample(px, (96, 96), "lanczos", ("g",)).withColumn("kind", F.lit("lanczos"))
    return a.unionByName(b).select("image_id", "kind", "y", "x", "g")


# ten breakpoints that leave both ends to extrapolation
_VIGN = [(5.0 + 9.0 * i, 1.0 + 0.01 * i * i, 1.0 + 0.008 * i * i, 1.0 + 0.012 * i * i) for i in range(10)]
view("vign", "SELECT * FROM (VALUES " + ", ".join(f"({a!r}e0,{r!r}e0,{g!r}e0,{b!r}e0)" for a, r, g, b in _VIGN) + ") v(angle, fr, fg, fb)")


def vign(spark):
    return spark.createDataFrame(_VIGN, "angle double, fr double, fg double, fb double")


@query(
    "ge21_vignetting_table",
    """SELECT image_id, y, x, r*(fr+(fr2-fr)*t) r, g*(fg+(fg2-fg)*t) g, b*(fb+(fb2-fb)*t) b FROM (
        SELECT p.*, v.*, (p.a-v.angle)/(v.angle2-v.angle) t FROM (SELECT *, degrees(acos(cos(theta))) a FROM g) p
        JOIN (SELECT *, row_number() OVER (ORDER BY angle) rn, count(*) OVER () n FROM (SELECT *, lead(angle) OVER w angle2, lead(fr) OVER w fr2, lead(fg) OVER w fg2, lead(fb) OVER w fb2 FROM vign WINDOW w AS (ORDER BY angle)) WHERE angle2 IS NOT NULL) v
          ON (p.a>=v.angle OR rn=1) AND (p.a<v.angle2 OR rn=n))""",
    "g vign",
    "r g b",
)
def ge21(spark, sf):
    return _rgb(OG.vignetting_table(X.px(spark, sf), vign(spark)))


@query(
    "ge21_vignetting_by_camera",
    """SELECT image_id, y, x, r*(fr+(fr2-fr)*t) r, g*(fg+(fg2-fg)*t) g, b*(fb+(fb2-fb)*t) b FROM (SELECT *, degrees(acos(cos(theta))) a FROM g) p LEFT JOIN
        (SELECT s_suppkey%5 camera, angle*(1+s_suppkey%5) angle, lead(angle*(1+s_suppkey%5)) OVER w angle2, fr, lead(fr) OVER w fr2, fg, lead(fg) OVER w fg2, fb, lead(fb) OVER w fb2, row_number() OVER w rn,
           count(*) OVER (PARTITION BY s_suppkey) n FROM supplier, vign WHERE s_suppkey BETWEEN 1 AND 3 WINDOW w AS (PARTITION BY s_suppkey ORDER BY angle)) v
          ON v.camera=image_id%5 AND angle2 IS NOT NULL AND (p.a>=v.angle OR rn=1) AND (p.a<v.angle2 OR rn=n-1), LATERAL (SELECT (p.a-v.angle)/(v.angle2-v.angle) t) q""",
    "g vign",
    "r g b",
)
def ge21b(spark, sf):
    """Profiles of three cameras; pictures of the other two have none."""
    k = F.col("s_suppkey")
    profiles = X.table(spark, sf, "supplier").where(k.between(1, 3)).select((k % 5).alias("camera"), F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(p, ("angle", "fr", "fg", "fb"))]) for p in _VIGN])).alias("p"))
    profiles = profiles.select("camera", (F.col("p.angle") * (1 + F.col("camera"))).alias("angle"), "p.fr", "p.fg", "p.fb")
    px = X.px(spark, sf).withColumn("camera", F.col("image_id") % 5)
    return _rgb(OG.vignetting_table(px, profiles, by=["camera"]))


@query(
    "ge22_vignetting_polynomial",
    """SELECT image_id, y, x, r*f r, g*f g, b*f b FROM (SELECT *, 1e0/(1e0-0.8e0*q+0.4e0*q*q-0.1e0*q*q*q) f FROM (SELECT *, nx*nx+ny*ny q FROM g))""",
    "g",
    "r g b",
)
def ge22(spark, sf):
    return _rgb(OG.vignetting_polynomial(X.px(spark, sf), -0.8, 0.4, -0.1))


@query(
    "ge23_fit_vignetting",
    """SELECT * FROM (WITH s AS (SELECT image_id, nx*nx+ny*ny q, 0.212671e0*r+0.715160e0*g+0.072169e0*b v FROM g WHERE x%10=0 AND y%10=0),
       c AS (SELECT *, q-avg(q) OVER w x1, q*q-avg(q*q) OVER w x2, q*q*q-avg(q*q*q) OVER w x3, avg(q) OVER w m1, avg(q*q) OVER w m2, avg(q*q*q) OVER w m3, avg(v) OVER w m, v-avg(v) OVER w y FROM s WINDOW w AS (PARTITION BY image_id)),
       d AS (SELECT *, sum(x1*x2) OVER w/sum(x1*x1) OVER w p12, sum(x1*x3) OVER w/sum(x1*x1) OVER w p13, sum(x1*y) OVER w/sum(x1*x1) OVER w p1 FROM c WINDOW w AS (PARTITION BY image_id)),
       e AS (SELECT *, x2-p12*x1 z2, x3-p13*x1 z3 FROM d),
       f AS (SELECT *, sum(z2*z3) OVER w/sum(z2*z2) OVER w p23, sum(z2*y) OVER w/sum(z2*z2) OVER w p2 FROM e WINDOW w AS (PARTITION BY image_id)),
       h AS (SELECT image_id, any_value(p1) p1, any_value(p12) p12, any_value(p13) p13, any_value(p2) p2, any_value(p23) p23, any_value(m) m, any_value(m1) m1, any_value(m2) m2, any_value(m3) m3,
             sum((z3-p23*z2)*y)/sum((z3-p23*z2)*(z3-p23*z2)) b3 FROM f GROUP BY image_id),
       i AS (SELECT *, p2-b3*p23 b2 FROM h), j AS (SELECT *, p1-b2*p12-b3*p13 b1 FROM i), k AS (SELECT *, m-b1*m1-b2*m2-b3*m3 b0 FROM j)
       SELECT image_id, b1/b0 a, b2/b0 b, b3/b0 c FROM k)""",
    "g",
    "a:3 b:3 c:3",
)
def ge23(spark, sf):
    return OG.fit_vignetting(X.px(spark, sf))


_POLY = {"hexagon": [(10, 5), (40, 8), (55, 30), (42, 55), (15, 50), (4, 28)], "star": [(30, 2), (36, 60), (2, 20), (60, 22), (22, 61)]}
_EDGES = [(n, float(p[i - 1][0]), float(p[i - 1][1]), float(p[i][0]), float(p[i][1])) for n, p in _POLY.items() for i in range(len(p))]
view("edges", "SELECT * FROM (VALUES " + ", ".join(f"('{n}',{a}e0,{b}e0,{q}e0,{d}e0)" for n, a, b, q, d in _EDGES) + ") e(polygon, x0, y0, x1, y1)")


@query(
    "ge24_polygon_mask",
    """SELECT image_id, polygon, y, x FROM px JOIN edges ON (edges.y0>px.y)<>(edges.y1>px.y) AND px.x<=(x1-x0)*(px.y-y0)/(y1-y0)+x0
       GROUP BY image_id, polygon, y, x HAVING count(*)%2=1""",
    "px edges",
)
def ge24(spark, sf):
    e = spark.createDataFrame(_EDGES, "polygon string, x0 double, y0 double, x1 double, y1 double")
    return OG.polygon_mask(X.px(spark, sf), e)


@query(
    "ge24_polygons_by_camera",
    """SELECT image_id, (image_id%3)::INT camera, polygon, y, x FROM px JOIN (SELECT *, s_suppkey%3 camera FROM edges, supplier WHERE s_suppkey IN (1, 2)) e
         ON camera=image_id%3 AND (e.y0+2*camera>px.y)<>(e.y1+2*camera>px.y) AND px.x<=(x1-x0)*(px.y-(y0+2*camera))/(y1-y0)+x0
       GROUP BY ALL HAVING count(*)%2=1""",
    "px edges",
)
def ge24b(spark, sf):
    """Polygons that lie lower from camera to camera; pictures of the third have none."""
    cameras = X.table(spark, sf, "supplier").where("s_suppkey IN (1, 2)").select((F.col("s_suppkey") % 3).cast("int").alias("camera"))
    e = spark.createDataFrame(_EDGES, "polygon string, x0 double, y0 double, x1 double, y1 double").crossJoin(F.broadcast(cameras))
    e = e.withColumns({k: F.col(k) + 2 * F.col("camera") for k in ("y0", "y1")})
    return OG.polygon_mask(X.px(spark, sf).withColumn("camera", (F.col("image_id") % 3).cast("int")), e, by=["camera"])
