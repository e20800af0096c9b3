"""Queries on headers, text sources and exports. Headers and texts are composed from the event and supplier tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions import headers as H
from lumenfield.functions import rgbe
from lumenfield.operators import regions as RG
from lumenfield.plans import fixtures as X
from lumenfield.plans.registry import query
from lumenfield.plans.views import view
from lumenfield.session import dealt, work_folder
from lumenfield.sources import files as FI
from lumenfield.sources import pictures as P
from lumenfield.sources import tables as TB

_T = "['v','h','c','a','s','l']"

# one header per event: exposures, a view, colour keys at the top or only in copied headers
_LINES = [
    ("'#?RADIANCE'", None),
    ("'EXPOSURE=' || (1+i%3)", None),
    ("chr(9) || 'EXPOSURE=4'", None),
    ("'EXPOSURE= 0.25'", "i%2=0"),
    ("'SOFTWARE= rig ' || (i%4)", None),
    ("'VIEW= -vtv -vh 20 -vv 20'", "i%7=0"),
    (f"'VIEW= -vt' || {_T}[1+i%6] || ' -vp 0 0 0 -vd 0 1 0.' || (i%5) || ' -vu 0 0 1 -vh ' || (40+i%100) || ' -vv ' || (30+i%90) || ' -vs 0.1 -vl -0.' || (i%4)", "i%4<>3"),
    ("'RIG_PROJECTION= ' || ['Equidistant','equisolid','vth','other'][1+i%4]", "i%4=3 OR i%2=0"),
    ("chr(9) || chr(9) || 'PRIMARIES= 0.64 0.33 0.30 0.60 0.15 0.06 0.3127 0.3290'", "i%6=1"),
    ("chr(9) || 'LuminanceRGB= 0 1 0'", "i%6=1"),
    ("'LuminanceRGB= 0.26507413 0.67011463 0.06481124'", "i%6=0"),
    ("'SENSOR2XYZ= 0.5 0.3 0.1 0.2 0.7 0.1 0.0 0.1 0.9'", "i%6=2"),
    ("'XYZCAM= 0.8 -0.1 0.05 -0.2 1.1 0.1 0.02 -0.15 0.9'", "i%6=3"),
    ("'TargetPrimaries= 0.64 0.33 0.29 0.60 0.15 0.06'", "i%6=4"),
    ("'TargetWhitePoint= 0.3333 0.3333'", "i%6=4"),
    ("'PRIMARIES= 0.64 0.33 0.30 0.60 0.15 0.06 0.3127 0.3290'", "i%12=5"),
    ("'CAMERA= LMK 98-4'", "i%12=11"),
    ("'RIG_COLOR= XYZ CD/m2'", "i%5=0 AND i%6=0"),
    ("'RIG_STEP_' || (2+i%3) || '= crop'", "i%3=0"),
    ("'RIG_STEP_1= merge'", None),
    # keys of other programs that only look alike
    ("'BACKGROUND_COLOR= grey, 100 cd/m2'", "i%7=0"),
    ("'MAP_PROJECTION= equisolid'", "i%5=1"),
    ("'OTHER_STEP_9= crop'", "i%4=1"),
    ("'SOFTWARE= rig ' || (i%4) || ' '", "i%3=1"),
    ("'FORMAT=32-bit_rle_rgbe'", None),
]
view(
    "hdrs",
    "SELECT event_id capture_id, [l FOR l IN [" + ", ".join(t if w is None else f"CASE WHEN {w} THEN {t} END" for t, w in _LINES)
    + "] IF l IS NOT NULL] AS lines FROM (SELECT event_id, event_id i FROM events)",
)


def headers(spark, sf):
    i = "event_id"
    sub = lambda t: t.replace("(i%", f"({i}%").replace("+i%", f"+{i}%").replace("chr(9)", "'\\t'")
    parts = []
    for t, w in _LINES:
        t = sub(t)
        t = t.replace(f"{_T}[1+{i}%6]", f"element_at(array('v','h','c','a','s','l'), cast(1+{i}%6 as int))")
        t = t.replace(f"['Equidistant','equisolid','vth','other'][1+{i}%4]", f"element_at(array('Equidistant','equisolid','vth','other'), cast(1+{i}%4 as int))")
        parts.append(t if w is None else f"CASE WHEN {w.replace('i%', i + '%')} THEN {t} END")
    return dealt(X.table(spark, sf, "events").select("event_id")).select(
        F.col("event_id").alias("capture_id"), F.expr(f"filter(array({', '.join(parts)}), l -> l is not null)").alias("header_lines")
    )


_CK = "(" + ",".join(f"'{k}'" for k in (*H.COLOUR_KEYS, "RIG_COLOR")) + ")"
view(
    "hlines",
    """SELECT capture_id, pos, length(line)-length(ltrim(line, chr(9)||' ')) depth, trim(split_part(line,'=',1), ' '||chr(9)) k, trim(substr(line, instr(line,'=')+1), ' '||chr(9)) v
       FROM (SELECT capture_id, generate_subscripts(lines,1) pos, unnest(lines) line FROM hdrs) WHERE instr(line,'=')>0 AND ltrim(line, chr(9)||' ') NOT LIKE '#%'""",
    "hdrs",
)
view(
    "hvals",
    f"""SELECT capture_id, k, arg_max(v, pos) v FROM (SELECT *, bool_or(depth=0 AND k IN {_CK}) OVER w top, min(depth) FILTER (depth>0 AND k IN {_CK}) OVER w near FROM hlines WINDOW w AS (PARTITION BY capture_id))
       WHERE depth=0 OR (NOT top AND depth=near AND k IN {_CK}) GROUP BY capture_id, k""",
    "hlines",
)


@query("hd1_describing_values", "SELECT capture_id, k AS key, v AS value FROM hvals", "hvals")
def hd1(spark, sf):
    return H.header_rows(H.describe(headers(spark, sf)), ["capture_id"])


@query(
    "hd2_exposure_product",
    "SELECT capture_id, product(v::DOUBLE) exposure FROM hlines WHERE depth=0 AND k='EXPOSURE' AND v::DOUBLE>0 GROUP BY capture_id",
    "hlines",
    "exposure",
)
def hd2(spark, sf):
    return headers(spark, sf).select("capture_id", H.exposure_product(F.col("header_lines")).alias("exposure"))


@query(
    "hd3_cdm2_mark",
    "SELECT capture_id, coalesce(bool_or(k='RIG_COLOR' AND lower(v) LIKE '%cd/m2%'), false) cdm2 FROM hvals GROUP BY capture_id",
    "hvals",
)
def hd3(spark, sf):
    return H.describe(headers(spark, sf)).select("capture_id", H.in_cdm2(F.col("header")).alias("cdm2"))


_OPT = "TRY_CAST(nullif(regexp_extract(v, '-{o} +([^ ]+)', 1),'') AS DOUBLE)"
_OPT3 = "TRY_CAST(nullif(regexp_extract(v, '-{o} +([^ ]+) +([^ ]+) +([^ ]+)', {i}),'') AS DOUBLE)"
view(
    "views",
    "SELECT capture_id, regexp_extract(v, '-vt(.)', 1) vtype, " + ", ".join(f"{_OPT.format(o=o)} {o}" for o in ("vh", "vv", "vs", "vl"))
    + ", " + ", ".join(f"{_OPT3.format(o=o, i=i)} {o}{a}" for o in ("vd", "vu") for i, a in enumerate("xyz", 1)) + " FROM hvals WHERE k='VIEW'",
    "hvals",
)


@query("hd4_parse_view", "SELECT * FROM views", "views")
def hd4(spark, sf):
    d = H.values_of(H.describe(headers(spark, sf)), "VIEW", ["capture_id"], "view")
    return d.select("capture_id", *[v.alias(k) for k, v in H.parse_view(F.col("view")).items()])


@query(
    "hd5_projection",
    """SELECT capture_id, coalesce(max(regexp_extract(v,'-vt(.)',1)) FILTER (k='VIEW'), max(CASE WHEN lower(v) LIKE '%equidistant%' THEN 'a' WHEN lower(v) LIKE '%equisolid%' THEN 'e' WHEN lower(v)='vth' THEN 'h' END) FILTER (k='RIG_PROJECTION'), 'v') projection
       FROM hvals GROUP BY capture_id""",
    "hvals",
)
def hd5(spark, sf):
    return H.describe(headers(spark, sf)).select("capture_id", H.projection(F.col("header")).alias("projection"))


_W6 = """CASE WHEN i%6=0 THEN {a} WHEN i%6=1 THEN {b} WHEN i%6=2 THEN {c} WHEN i%6=3 THEN {d} WHEN i%6=4 THEN {e} WHEN i%12=5 THEN {f} ELSE {g} END"""


def _xyzcam_row():
    """Second row of the inverse of the XYZCAM matrix of the fixture headers, by cofactors."""
    a, b, cc, d, e, f, g, h, i = (f"({v}e0)" for v in (0.8, -0.1, 0.05, -0.2, 1.1, 0.1, 0.02, -0.15, 0.9))
    det = f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{cc}*({d}*{h}-{e}*{g}))"
    return [f"({f}*{g}-{d}*{i})/{det}", f"({a}*{i}-{cc}*{g})/{det}", f"({cc}*{d}-{a}*{f})/{det}"]


_XC = _xyzcam_row()
_PW = [0.265074126, 0.670114631, 0.064811243]


@query(
    "hd6_luminance_weights",
    "SELECT capture_id, " + _W6.format(a="'LuminanceRGB'", b="'LuminanceRGB'", c="'SENSOR2XYZ'", d="'XYZCAM'", e="'TargetPrimaries'", f="'PRIMARIES'", g="'vendor'") + " weight_source, "
    + ", ".join(
        _W6.format(a=f"{a}e0", b=b, c=s, d=_XC[n], e=f"(SELECT p{3 + n} FROM prim_rad)", f=f"(SELECT p{3 + n} FROM prim_srgb)", g=f"{_PW[n]}e0") + f" {w}"
        for n, (w, a, b, s) in enumerate((("wr", 0.26507413, "0e0", "0.2e0"), ("wg", 0.67011463, "1e0", "0.7e0"), ("wb", 0.06481124, "0e0", "0.1e0")))
    )
    + ", CASE WHEN i%5=0 AND i%6=0 THEN 1e0 ELSE 179e0 END efficacy FROM (SELECT event_id capture_id, event_id i FROM events)",
    "prim_rad prim_srgb",
    "wr wg wb efficacy",
)
def hd6(spark, sf):
    d = H.with_weights(H.describe(headers(spark, sf)))
    return d.select("capture_id", "weight_source", "wr", "wg", "wb", "efficacy")


@query(
    "hd7_primaries_to_weights",
    """SELECT s_suppkey, (ry*sx) wr, (gy*sy) wg, (by_*sz) wb FROM (SELECT *,
         (X*(gy*(1e0-bx-by_)-by_*(1e0-gx-gy))-gx*(1e0*(1e0-bx-by_)-by_*Z)+bx*(1e0*(1e0-gx-gy)-gy*Z))/det sx,
         (rx*(1e0*(1e0-bx-by_)-by_*Z)-X*(ry*(1e0-bx-by_)-by_*(1e0-rx-ry))+bx*(ry*Z-1e0*(1e0-rx-ry)))/det sy,
         (rx*(gy*Z-1e0*(1e0-gx-gy))-gx*(ry*Z-1e0*(1e0-rx-ry))+X*(ry*(1e0-gx-gy)-gy*(1e0-rx-ry)))/det sz
       FROM (SELECT *, rx*(gy*(1e0-bx-by_)-by_*(1e0-gx-gy))-gx*(ry*(1e0-bx-by_)-by_*(1e0-rx-ry))+bx*(ry*(1e0-gx-gy)-gy*(1e0-rx-ry)) det FROM
        (SELECT s_suppkey, 0.64e0+0.001e0*(s_suppkey%7) rx, 0.33e0 ry, 0.29e0 gx, 0.60e0+0.001e0*(s_suppkey%5) gy, 0.15e0 bx, 0.06e0 by_, 0.3127e0/0.329e0 X, (1e0-0.3127e0-0.329e0)/0.329e0 Z FROM supplier)))""",
    dbl="wr wg wb",
)
def hd7(spark, sf):
    from lumenfield.functions.colour import primaries_to_weights

    k = F.col("s_suppkey")
    w = primaries_to_weights([F.lit(0.64) + F.lit(0.001) * (k % 7), 0.33, 0.29, F.lit(0.60) + F.lit(0.001) * (k % 5), 0.15, 0.06, 0.3127, 0.329])
    return X.table(spark, sf, "supplier").select("s_suppkey", *[v.alias(n) for v, n in zip(w, ("wr", "wg", "wb"))])


@query(
    "hd9_provenance",
    """SELECT capture_id, greatest(1, max(TRY_CAST(nullif(regexp_extract(line,'^\\s*RIG_STEP_([0-9]+)\\s*=',1),'') AS INT)))+1 AS next_step,
        count(DISTINCT trim(line, ' '||chr(9)))::INT n_unique, count(*) FILTER (lower(trim(split_part(line,'=',1),' '||chr(9))) NOT IN ('view','exposure','format'))::INT n_kept
       FROM (SELECT capture_id, unnest(lines) line FROM hdrs) GROUP BY capture_id""",
    "hdrs",
)
def hd9(spark, sf):
    ln = F.col("header_lines")
    return headers(spark, sf).select(
        "capture_id", H.next_step(ln).alias("next_step"), F.size(H.unique_lines(ln)).alias("n_unique"),
        F.size(H.without_keys(ln, ["VIEW", "EXPOSURE"])).alias("n_kept"),
    )


@query(
    "hd10_capture_span",
    """SELECT bracket_id, min(t) || '-' || split_part(max(t),' ',2) span FROM (SELECT event_id//5 bracket_id, CASE WHEN event_id%5<>4 THEN strftime(ts,'%Y:%m:%d %H:%M:%S') END t FROM events) GROUP BY bracket_id""",
)
def hd10(spark, sf):
    d = X.table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 5).alias("bracket_id"),
        F.when(F.col("event_id") % 5 != 4, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise("").alias("capture_time"),
    )
    return H.capture_span(d, ["bracket_id"])


_TAN = "({p}e0*degrees(atan(tan(radians({a}/{p}e0))*{r})))"
_ASIN = "(2e0*degrees(asin(least(1e0,sin(radians({a}/2e0))*{r}))))"


@query(
    "hd11_crop_view",
    f"""SELECT capture_id, CASE vtype WHEN 'v' THEN {_TAN.format(p=2, a='vh', r='0.5e0')} WHEN 'h' THEN {_ASIN.format(a='vh', r='0.5e0')} WHEN 's' THEN {_TAN.format(p=4, a='vh', r='0.5e0')} ELSE vh*0.5e0 END vh,
        CASE WHEN vtype IN ('v','c') THEN {_TAN.format(p=2, a='vv', r='(40e0/64e0)')} WHEN vtype='h' THEN {_ASIN.format(a='vv', r='(40e0/64e0)')} WHEN vtype='s' THEN {_TAN.format(p=4, a='vv', r='(40e0/64e0)')} ELSE vv*40e0/64e0 END vv,
        (10e0+vs*64e0-32e0+16e0)/32e0 hoff, (64e0-4e0-40e0+vl*64e0-32e0+20e0)/40e0 voff FROM views""",
    "views",
    "vh vv hoff voff",
)
def hd11(spark, sf):
    d = hd4(spark, sf)
    v = H.crop_view({"vtype": "vtype", "vh": "vh", "vv": "vv", "hoff": "vs", "voff": "vl"}, (64, 64), 10, 4, 32, 40)
    return d.select("capture_id", *[e.alias(k) for k, e in v.items()])


@query("hd12_pixels_per_degree", "SELECT event_id capture_id, coalesce(64e0/vh, 30e0) ppd FROM events LEFT JOIN views ON capture_id=event_id", "views", "ppd")
def hd12(spark, sf):
    d = H.describe(headers(spark, sf))
    return d.select("capture_id", H.pixels_per_degree(64, H.parse_view(F.col("header")["VIEW"])["vh"]).alias("ppd"))


@query(
    "hd13_window_distance",
    "SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN (s_suppkey%9)+0.5e0 WHEN s_suppkey%3=1 THEN (s_suppkey%9)*1e0 ELSE 0e0 END distance FROM supplier",
    dbl="distance",
)
def hd13(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("/a/office_view_"), k % 9, F.lit(".5m.hdr"))).when(k % 3 == 1, F.concat(F.lit("/b/view_"), k % 9, F.lit("m_east.hdr")))
    return X.table(spark, sf, "supplier").select("s_suppkey", H.window_distance(name.otherwise(F.concat(F.lit("/c/review_"), k % 9, F.lit("m.hdr")))).alias("distance"))


# --- text sources: one text per supplier ---


def _texts(spark, sf, expr):
    return X.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.expr(expr).alias("value"))


@query(
    "io4_vignetting_source",
    """SELECT s_suppkey::VARCHAR AS path, (10*i)::DOUBLE angle, 1e0+0.01e0*i*(s_suppkey%4) fr, CASE WHEN s_suppkey%2=0 THEN 1e0+0.02e0*i ELSE 1e0+0.01e0*i*(s_suppkey%4) END fg,
        CASE WHEN s_suppkey%2=0 THEN 1.5e0 ELSE 1e0+0.01e0*i*(s_suppkey%4) END fb, NULL::VARCHAR problem FROM supplier, (SELECT range i FROM range(9))""",
    dbl="angle fr fg fb",
)
def io4(spark, sf):
    row = "concat(10*i, ' ', 1+0.01*i*(s_suppkey%4), if(s_suppkey%2=0, concat('\t', 1+0.02*i, ' 1.5'), ''), if(i=3, ' # middle', ''))"
    return TB.vignetting_tables(_texts(spark, sf, f"concat('# lens ', s_suppkey, '\n\n', array_join(transform(sequence(0,8), i -> {row}), '\n'))"))


@query(
    "io5_chart_cells",
    """SELECT s_suppkey::VARCHAR AS path, (i+1)::INT cell_id, (8*i)::INT x, (i%3)::INT y, (6+s_suppkey%3)::INT w, (CASE WHEN i=5 AND s_suppkey%4=0 THEN 0 ELSE 10 END)::INT h,
        CASE WHEN i=5 AND s_suppkey%4=0 THEN 'size' END problem FROM supplier, (SELECT range i FROM range(6))""",
)
def io5(spark, sf):
    row = "concat(8*i, ' ', i%3, ' ', 6+s_suppkey%3, ' ', if(i=5 and s_suppkey%4=0, 0, 10))"
    return TB.chart_cells(_texts(spark, sf, f"concat('# x y w h\n', array_join(transform(sequence(0,5), i -> {row}), '\n'), '\n')"))


@query(
    "io5_patch_data",
    """SELECT s_suppkey::VARCHAR AS path, (i+1)::INT patch_id, 0.1e0*i v1, CASE WHEN s_suppkey%2=0 THEN 0.2e0*i END v2, CASE WHEN s_suppkey%2=0 THEN 0.3e0 END v3, NULL::VARCHAR problem
       FROM supplier, (SELECT range i FROM range(4))""",
    dbl="v1 v2 v3",
)
def io5b(spark, sf):
    row = "concat(0.1*i, if(s_suppkey%2=0, concat(' ', 0.2*i, ' 0.3'), ''))"
    return TB.patch_data(_texts(spark, sf, f"array_join(transform(sequence(0,3), i -> {row}), '\n')"))


@query(
    "io6_profile_source",
    """SELECT s_suppkey::VARCHAR AS path, (10+s_suppkey%5)::VARCHAR black, '12000' white, NULL::VARCHAR exptimes FROM supplier""",
)
def io6(spark, sf):
    t = _texts(spark, sf, "concat('# camera\n[globals]\nblack = 5\nBLACK=', 10+s_suppkey%5, '\nwhite = 12000\n[other]\nexptimes = 1\n')")
    return TB.pivot_profiles(TB.profiles(t), ["black", "white", "exptimes"])


@query(
    "io8_mask_manifest",
    """SELECT 'mask_' || p_partkey || '.png' filename, CASE WHEN p_partkey%3=0 THEN 'semantic' ELSE 'instance' END kind, CASE WHEN p_partkey%4=0 THEN 0e0 ELSE p_size/50e0 END score
       FROM part WHERE p_partkey%3<>1""",
    dbl="score",
)
def io8(spark, sf):
    k = F.col("p_partkey")
    raw = X.table(spark, sf, "part").select(
        F.concat(F.lit("mask_"), k, F.lit(".png")).alias("filename"), F.when(k % 3 == 0, "Semantic").when(k % 3 == 2, "INSTANCE").otherwise("preview").alias("kind"),
        F.when(k % 4 == 0, "n/a").otherwise((F.col("p_size") / 50.0).cast("string")).alias("score"),
    )
    return TB.manifest_rows(raw)


@query(
    "io11_region_image",
    "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN x BETWEEN 10 AND 29 AND y BETWEEN 5 AND 24 THEN {ch} ELSE 0e0 END {ch}" for ch in "rgb") + " FROM px",
    "px",
    "r g b",
)
def io11(spark, sf):
    px = X.px(spark, sf)
    return TB.region_image(px, RG.rect(px, 10, 5, 20, 20)).select("image_id", "y", "x", "r", "g", "b")


_EXP = "CASE WHEN m>=pow(2e0,e0) THEN e0+1 WHEN m<pow(2e0,e0-1) THEN e0-1 ELSE e0 END"
view("qexp", f"SELECT *, {_EXP} e FROM (SELECT *, floor(log2(m))+1 e0 FROM (SELECT *, greatest(r,g,b) m FROM px))", "px")


@query(
    "io12_rgbe_round_trip",
    "SELECT image_id, y, x, " + ", ".join(f"(least(255e0,floor({ch}*pow(2e0,8-e)+0.5e0))+0.5e0)*pow(2e0,e-8) {ch}" for ch in "rgb")
    + ", (least(255e0,floor(g*pow(2e0,8-eg)))+0.5e0)*pow(2e0,eg-8) grey FROM (SELECT *, floor(log2(g))+1 eg FROM qexp)",
    "qexp",
    "r g b grey",
)
def io12(spark, sf):
    px = X.px(spark, sf)
    grey = rgbe.round_trip(["g"], rounded=False)["g"]
    return px.select("image_id", "y", "x", *[v.alias(k) for k, v in rgbe.round_trip(["r", "g", "b"]).items()], grey.alias("grey"))


def encoded_rows(spark, sf):
    """Every picture row as a flat one-line picture, composed as bytes on the executors (64 pixels per group)."""
    px = X.px(spark, sf).withColumn("e", rgbe.exponent(F.greatest("r", "g", "b")))
    m = rgbe.quantise(["r", "g", "b"], False, "e")
    quad = F.concat(*[F.lpad(F.hex(v.cast("bigint")), 2, "0") for v in (*m, (F.col("e") + 128))])
    rows = px.groupBy("image_id", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", quad.alias("q")))), lambda s: s["q"]), "").alias("hx"), F.count("*").alias("n"))
    head = F.concat(F.lit("#?RADIANCE\nEXPOSURE=1\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X "), F.col("n"), F.lit("\n"))
    return rows.select(F.concat_ws("/", "image_id", "y").alias("path"), F.concat(F.encode(head, "ISO-8859-1"), F.unhex("hx")).alias("content"))


@query(
    "io2_decode_pictures",
    "SELECT image_id, y, x, 64::INT width, " + ", ".join(f"(least(255e0,floor({ch}*pow(2e0,8-e)))+0.5e0)*pow(2e0,e-8) {ch}" for ch in "rgb") + " FROM qexp",
    "qexp",
    "r g b",
)
def io2(spark, sf):
    d = P.decode(encoded_rows(spark, sf))
    part = F.split("path", "/")
    return d.select(F.get(part, F.lit(0)).cast("bigint").alias("image_id"), F.get(part, F.lit(1)).cast("int").alias("y"), "x", "width", "r", "g", "b")


def archive(spark, rows):
    """A new folder that holds the pictures (path, content) as single files."""
    FI.register(spark)
    folder = work_folder(spark)
    rows.select(F.col("path").alias("name"), "content").write.format("named_files").mode("append").save(folder)
    return folder


@query(
    "io1_expand_inputs",
    """SELECT 'numbers' item, 'a/frame_' || lpad(y::VARCHAR, 3, '0') || '.hdr' AS name FROM px WHERE image_id=0 AND y<20 AND x=0
       UNION ALL SELECT 'numbers from 1', 'b/f' || y || '.hdr' FROM px WHERE image_id=0 AND y BETWEEN 1 AND 30 AND x=0
       UNION ALL SELECT 'folder', 'b/f' || y || '.hdr' FROM px WHERE image_id=0 AND y>0 AND y<>31 AND x=0
       UNION ALL SELECT 'wildcard', 'a/frame_' || lpad(y::VARCHAR, 3, '0') || '.hdr' FROM px WHERE image_id=0 AND y%10=7 AND x=0
       UNION ALL SELECT 'literal', 'c/[x] 100%.hdr'""",
    "px",
)
def io1(spark, sf):
    """Numbered frames with a gap, numbers from 1, a folder, a wildcard and a name that only looks like a pattern; by Spark's listing, and the same by the data source."""
    rows = encoded_rows(spark, sf).where("path LIKE '0/%'").withColumn("y", F.split_part("path", F.lit("/"), F.lit(2)).cast("int"))
    named = [
        rows.select(F.format_string("a/frame_%03d.hdr", "y").alias("path"), "content", "y").where("y <> 20"),
        rows.select(F.format_string("b/f%d.hdr", "y").alias("path"), "content", "y").where("y <> 0 AND y <> 31"),
        rows.select(F.lit("c/[x] 100%.hdr").alias("path"), "content", "y").where("y = 0"),
    ]
    folder = archive(spark, named[0].unionByName(named[1]).unionByName(named[2]))
    items = {"numbers": "a/frame_%03d.hdr", "numbers from 1": "b/f%d.hdr", "folder": "b", "wildcard": "a/frame_*7.hdr", "literal": "c/[x] 100%.hdr"}
    name = lambda: F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name")
    out = None
    for item, pattern in items.items():
        listed = P.list_inputs(spark, [f"{folder}/{pattern}"]).select(F.lit(item).alias("item"), name())
        read = spark.read.format("picture_headers").load(f"{folder}/{pattern}").where("problem IS NULL AND width = 64").select(F.lit(item).alias("item"), name())
        both = listed.unionByName(read).groupBy("item", "name").agg(F.count("*").alias("n")).where("n = 2").drop("n")
        out = both if out is None else out.unionByName(both)
    return out


@query(
    "io3_header_scan",
    """SELECT DISTINCT image_id || '/' || y AS path, CASE WHEN y=0 THEN 3003 ELSE 3 END::INT n_lines, CASE WHEN y<>1 THEN 64 ELSE -1 END::INT width, CASE WHEN y<>1 THEN 1 ELSE -1 END::INT height,
              CASE WHEN y=1 THEN 'no blank line after the header' END problem FROM px""",
    "px",
)
def io3(spark, sf):
    """One picture of each archive part has a header of more than 100 kB, one has no end of its header."""
    rows = encoded_rows(spark, sf)
    y = F.split_part("path", F.lit("/"), F.lit(2))
    text = F.decode("content", "ISO-8859-1")
    long = F.encode(F.concat(F.lit("#?RADIANCE\n"), F.repeat(F.lit("COMMENT= " + "x" * 40 + "\n"), 3000), F.substr(text, F.lit(12))), "ISO-8859-1")
    broken = F.encode(F.lit("#?RADIANCE\nEXPOSURE=1\nFORMAT=32-bit_rle_rgbe"), "ISO-8859-1")
    rows = rows.withColumn("content", F.when(y == "0", long).when(y == "1", broken).otherwise(F.col("content")))
    size = [F.coalesce(k, F.lit(-1)).alias(k) for k in ("width", "height")]
    folder = archive(spark, rows.where("path LIKE '0/%'"))
    # one picture from files of which only the heads are read, the others from whole contents
    name = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    heads = P.header_scan(P.list_inputs(spark, [folder])).withColumn("path", name)
    found = P.header_scan(rows.where("path NOT LIKE '0/%'")).unionByName(heads)
    return found.select("path", F.size("header_lines").alias("n_lines"), *size, "problem")


@query(
    "io7_spectral_curves",
    """SELECT 1 AS n, (p_partkey%400+380)::DOUBLE nm, p_size/7e0 v1, NULL::DOUBLE v2, NULL::DOUBLE v3 FROM part WHERE p_partkey%5<>0
       UNION ALL SELECT 3, (p_partkey%400+380)::DOUBLE, p_size/7e0, p_size/11e0, -p_size/13e0 FROM part WHERE p_partkey%5<>0""",
    "",
    "v1 v2 v3",
)
def io7(spark, sf):
    """Curves of one and of three values with comments, a heading and lines without numbers between them."""
    k, v = F.col("p_partkey"), [F.col("p_size") / d for d in (7.0, 11.0, -13.0)]
    out = None
    for n in (1, 3):
        nm = (k % 400 + 380).cast("string")
        line = F.concat_ws(",", nm, *[x.cast("string") for x in v[:n]])
        line = F.when(k % 5 == 0, F.when(k % 2 == 0, F.lit("# remark, 1, 2, 3")).otherwise(F.concat_ws(",", F.lit("nm"), *[F.lit(f"v{i + 1}") for i in range(n)]))).otherwise(line)
        folder = work_folder(spark)
        X.table(spark, sf, "part").select(line.alias("value")).write.text(folder)
        c = TB.spectral_curves(spark, folder, n)
        c = c.select(F.lit(n).alias("n"), "nm", *[F.col(f"v{i + 1}") if i < n else F.lit(None).cast("double").alias(f"v{i + 1}") for i in range(3)])
        out = c if out is None else out.unionByName(c)
    return out


@query(
    "io9_statistics_csv",
    "SELECT s_suppkey, s_name || ', \"' || s_nationkey || '\"' AS name, s_acctbal::DOUBLE total, CASE WHEN s_suppkey%3>0 THEN s_acctbal/3e0 END mean FROM supplier",
    "",
    "total mean",
)
def io9(spark, sf):
    """Written with a heading, quotes and empty cells, and read again."""
    d = X.table(spark, sf, "supplier").select(
        "s_suppkey", F.concat("s_name", F.lit(', "'), "s_nationkey", F.lit('"')).alias("name"), F.col("s_acctbal").cast("double").alias("total"),
        F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal").cast("double") / 3.0).alias("mean"),
    )
    folder = work_folder(spark)
    TB.write_csv(d, folder)
    return spark.read.csv(folder, header=True, schema=d.schema, escape='"')
