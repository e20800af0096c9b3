"""Known answers, brute force on small fixtures and invariants."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import headers as H
from lumenfield.operators import bracket as B
from lumenfield.operators import calibrate as K
from lumenfield.operators import geometry as OG
from lumenfield.operators import glare as L
from lumenfield.operators import ranking as R
from lumenfield.operators import regions as RG
from lumenfield.operators import stats as S
from lumenfield.operators import stencil as N
from lumenfield.operators import sunmerge as M
from lumenfield.operators import volume as VV
from lumenfield.sources import pictures as P
from lumenfield.sources import tables as TB


def frame(spark, n, lum, image_id=0):
    d = spark.range(n * n).select(
        F.lit(image_id).cast("bigint").alias("image_id"), F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"),
        F.lit(n).alias("width"), F.lit(n).alias("height"),
    )
    return OG.with_geometry(d).withColumn("lum", lum)


def off_axis(deg):
    """Direction ``deg`` to the right of the axis."""
    return (math.sin(math.radians(deg)), math.cos(math.radians(deg)), 0.0)


def disc(direction, deg, inside, outside):
    c = F.col("dx") * direction[0] + F.col("dy") * direction[1] + F.col("dz") * direction[2]
    return F.when(c >= math.cos(math.radians(deg)), F.lit(float(inside))).otherwise(outside if not isinstance(outside, (int, float)) else F.lit(float(outside)))


# --- glare ---

# published per-source values of a reference picture: L, omega, position index, theta, Eglare, direction
GOLDEN = [
    (2261.049228, 0.0000563536, 7.624255, 73.430709, 0.036516, 0.938424, -0.285175, 0.195027),
    (2124.578301, 0.0007321000, 3.498778, 63.283690, 0.705748, 0.890728, -0.449573, -0.066991),
    (2592.060966, 0.0001356072, 16.000000, 77.866529, 0.074804, 0.805569, -0.210190, 0.553967),
    (2051.727855, 0.0000303098, 5.192492, 63.853370, 0.027331, 0.877270, -0.440670, 0.190281),
    (2033.074394, 0.0000647083, 2.629133, 54.010916, 0.077681, 0.797905, -0.587631, -0.134301),
    (2556.677070, 0.0001380848, 2.876411, 41.114028, 0.266569, 0.587576, -0.753402, 0.295194),
    (5032.106285, 1.6936276681, 7.133656, 45.299070, 4900.024718, 0.052406, -0.703406, 0.708854),
    (2274.629125, 0.0011626312, 1.078470, 8.143056, 2.613887, 0.076441, -0.989917, -0.119248),
    (3568.447217, 0.6636975843, 3.729738, 63.225072, 646.699028, -0.563450, -0.450487, -0.692522),
    (53045.456286, 0.0010230539, 14.093051, 60.426322, 26.594780, 0.311194, -0.493542, 0.812142),
]
EXPECTED = {
    "dgp": 0.558489, "lum_backg": 370.026350, "e_v_dir": 5577.121062, "dgi": 18.483456, "ugr": 23.977077, "vcp": 24.523094, "cgi": 29.796412,
    "lum_sources": 4638.677604, "omega_sources": 2.360668, "lveil": 749.992676, "lveil_cie": 25.967887, "dgr": 208.568893, "ugp": 0.779255,
    "ugr_exp": 26.362602, "dgi_mod": 16.822706, "ugp2": 0.588425, "dgm": 0.558452,
}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(0, i, om, lum, pos, math.radians(th), th, e, x, -y, z) for i, (lum, om, pos, th, e, x, y, z) in enumerate(GOLDEN)]
    src = spark.createDataFrame(rows, "image_id bigint, label int, omega double, lum double, pos double, sigma double, theta double, e_glare double, dx double, dy double, dz double")
    tot = spark.createDataFrame([(0, 6.283, 6739.593142, 2107.884410)], "image_id bigint, omega double, ev double, lum_mean double")
    return src, tot


def test_glare_indices_match_published_totals(golden):
    got = L.glare_indices(*golden).first()
    for name, want in EXPECTED.items():
        assert got[name] == pytest.approx(want, rel=2e-5), name


def test_source_shares(golden):
    rows = {r["label"]: r for r in L.contributions(*golden).collect()}
    assert rows[6]["r_contrast"] == pytest.approx(0.584949, abs=2e-6)
    assert rows[8]["r_dgp"] == pytest.approx(0.002949, abs=2e-6)


def test_disc_is_one_source_with_closed_form(spark):
    p = frame(spark, 400, disc((0.0, 1.0, 0.0), 5.0, 10000, 100))
    s = L.source_table(L.group_sources(L.source_pixels(p))).collect()
    assert len(s) == 1
    assert s[0]["omega"] == pytest.approx(2 * math.pi * (1 - math.cos(math.radians(5))), rel=0.03)
    assert p.filter("valid").agg(F.sum("omega")).first()[0] == pytest.approx(2 * math.pi, rel=0.005)


@pytest.mark.parametrize("gap, sources", [(40.0, 2), (14.0, 1)])
def test_two_discs(spark, gap, sources):
    # 5° discs: edges 30° or 4° apart; the search angle joins what is within 0.1 rad (5.7°)
    p = frame(spark, 256, disc(off_axis(-gap / 2), 5.0, 10000, disc(off_axis(gap / 2), 5.0, 10000, 100)))
    lab = L.group_sources(L.source_pixels(p))
    assert lab.select("label").distinct().count() == sources


def test_grouping_equals_brute_force_and_ignores_order(spark):
    # blocks of several pixels each: 160-pixel frame, clustered noise
    noise = F.when(F.pmod(F.xxhash64(F.floor(F.col("y") / 3), F.floor(F.col("x") / 3)), F.lit(11)) == 0, F.lit(5000.0)).otherwise(F.lit(10.0))
    p = frame(spark, 160, noise).filter("y < 60")
    src = L.source_pixels(p)
    pdf = src.select("y", "x", "dx", "dy", "dz").toPandas()
    v = pdf[["dx", "dy", "dz"]].to_numpy()
    for search in (0.2, 0.09):
        near = v @ v.T >= math.cos(search / 2)
        label = pdf["y"].to_numpy() * 160 + pdf["x"].to_numpy()
        while True:
            new = np.array([label[row].min() for row in near])
            if (new == label).all():
                break
            label = new
        want = {(y, x): lb for y, x, lb in zip(pdf["y"], pdf["x"], label)}
        for d in (src, src.repartition(7).orderBy(F.rand(3))):
            got = {(r["y"], r["x"]): r["label"] for r in L.group_sources(d, search).collect()}
            assert got == want


def test_sun_core_is_split_off(spark):
    axis = (0.0, 1.0, 0.0)
    p = frame(spark, 256, disc(axis, 1.0, 1e6, disc(axis, 5.0, 10000, 100)))
    s = L.source_table(L.split_peaks(L.group_sources(L.source_pixels(p)))).orderBy("lum").collect()
    assert [r["lum"] > 50000 for r in s] == [False, True]


def test_secondary_pixels_equal_brute_force(spark):
    p = frame(spark, 90, F.when((F.pmod(F.xxhash64("y", "x"), F.lit(7)) == 0) & (F.col("x") < 45), F.lit(5000.0)).otherwise(F.lit(1.0)))
    lab = L.group_sources(L.source_pixels(p))
    got = {(r["y"], r["x"], r["label"]) for r in L.secondary_pixels(p, lab, 3.4, 0.15).collect()}
    a = p.toPandas()
    om, ok, lb = np.zeros((90, 90)), np.zeros((90, 90), bool), np.full((90, 90), -1)
    om[a.y, a.x], ok[a.y, a.x] = a.omega, a.valid
    b = lab.toPandas()
    lb[b.y, b.x] = b.label
    want = set()
    for y in range(90):
        for x in range(90):
            if not ok[y, x] or lb[y, x] >= 0:
                continue
            total, part = 0.0, {}
            for dy in range(-3, 4):
                for dx in range(-3, 4):
                    q, r = y + dy, x + dx
                    if dy * dy + dx * dx <= 3.4**2 and 0 <= q < 90 and 0 <= r < 90:
                        total += om[q, r]
                        if lb[q, r] >= 0:
                            part[lb[q, r]] = part.get(lb[q, r], 0.0) + om[q, r]
            want |= {(y, x, k) for k, v in part.items() if v > 0.15 * total}
    assert got == want and want


# --- ranking at skew ---


def test_percentiles_of_a_hot_group(spark):
    d = spark.range(20000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"), F.when(F.col("id") % 5 == 0, 7.0).otherwise((F.xxhash64("id") % 1000) / 10.0).alias("v"))
    got = {r["k"]: r for r in R.percentiles(d, ["k"], "v", {"m": ("median", 0.5), "q": ("linear", 0.9), "p": ("paired", 0.75), "l": ("lower", 0.05)}).collect()}
    for k, g in d.toPandas().groupby("k"):
        v = np.sort(g["v"].to_numpy())
        n = len(v)
        assert got[k]["m"] == pytest.approx(np.median(v))
        assert got[k]["q"] == pytest.approx(np.quantile(v, 0.9))
        assert got[k]["p"] == pytest.approx((v[int(n * 0.75)] + v[int(n * 0.75 - 1)]) / 2)
        assert got[k]["l"] == v[math.floor(0.05 * (n - 1))]


def test_ranked_list_of_negative_and_tied_values(spark):
    d = spark.range(500).select(F.lit(1).alias("image_id"), (F.col("id") % 7 - 3).cast("double").alias("lum"), F.floor(F.col("id") / 20).alias("y"), (F.col("id") % 20).alias("x"), F.lit(0.5).alias("omega"))
    rows = S.ranked(d).orderBy("rank").toPandas()
    want = d.toPandas().sort_values(["lum", "y", "x"], ascending=[False, True, True])
    assert (rows[["y", "x"]].to_numpy() == want[["y", "x"]].to_numpy()).all()
    assert np.allclose(rows["running_mean"], np.cumsum(want["lum"]) / np.arange(1, 501))
    assert list(rows["rank"]) == list(range(1, 501))


# --- brackets ---


def test_normalisation_vectors(spark):
    cases = [(550, 100, 1000, 4095, 65535), (700, 400, 1000, 4095, 65535), (65535, 4096, 65535, 4095, 65535), (255, 255, 65535, 4095, 65535), (100, 255, 65535, 4095, 65535), (7967, 62, 15872, 4095, 65535), (32895, 255, 65535, 4095, 65535), (15303, 2048, 13048, 2048, 13048)]
    d = spark.createDataFrame(cases, "v int, b int, w int, cb int, cw int")
    got = [r[0] for r in d.select(B.normalise(F.col("v"), F.col("b"), F.col("w"), F.col("cb"), F.col("cw"))).collect()]
    assert got[0] == got[1]
    assert got[2:] == [65535, 4095, 4095, 34815, 34815, 13048]
    with pytest.raises(Exception, match="invalid black/white"):
        d.limit(1).select(B.normalise(F.col("v"), 5, 5, 0, 65535)).collect()


def test_merge_of_consistent_frames_is_the_single_frame(spark):
    d = spark.range(400).select(F.lit(0).alias("bracket_id"), F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.lit(20).alias("width"), F.lit(20).alias("height"))
    d = d.withColumn("rad", F.lit(0.3) + F.col("x") * 0.01).select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("frame_id"), F.lit(e).alias("e")) for i, e in enumerate((1.0, 0.5, 0.25))])))
    d = d.withColumn("dn", F.col("rad") * F.col("e") * 10000.0 + 500.0)
    for m in (B.merge(d, 500.0, 10500.0), B.merge_neighbourhood(d, 500.0, 10500.0, 1.0)):
        j = m.join(d.select("y", "x", "rad").distinct(), ["y", "x"])
        assert j.agg(F.max(F.abs(F.col("value") - F.col("rad")))).first()[0] < 1e-9
        assert j.count() == 400


def test_exposure_fit_recovers_exposures(spark):
    rows = [(1, f, e, p // 10, p % 10, True, (0.02 + 0.001 * p) * t) for f, (e, t) in enumerate(((1.0, 1.0), (0.5, 0.52), (0.25, 0.24), (0.125, 0.13))) for p in range(60)]
    d = spark.createDataFrame(rows, "bracket_id bigint, frame_id int, e double, py int, px int, good boolean, mean double").filter("py % 2 = 0 or frame_id < 3")
    got = {r["frame_id"]: r["fitted"] for r in B.fit_exposures(d).collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.52, 2: 0.24, 3: 0.13})


# --- geometry ---


def test_half_angle_and_resample(spark):
    d = spark.createDataFrame([([0.5],), ([0.9],)], "k array<double>")
    got = [r[0] for r in d.select(OG.valid_half_angle(F.col("k"))).collect()]
    assert got == pytest.approx([math.pi / 2, 1 / 0.9], rel=1e-9)
    p = frame(spark, 30, F.lit(1.0)).withColumn("g", F.col("x") * 1.0)
    r = OG.resample(p, (15, 10), "lanczos", ("g",)).toPandas()
    assert len(r) == 150 and r.groupby("x")["g"].std().max() < 1e-9
    for n, target in ((30, 15), (8, 15), (1, 4), (100, 7)):
        start, w = OG.axis_weights(n, target, 0, target - 1, "lanczos")
        assert start == 0 and w.sum(axis=1) == pytest.approx(np.ones(target)) and w.shape[1] <= n


def test_crop_outside_raises(spark):
    with pytest.raises(Exception, match="crop leaves"):
        OG.crop(frame(spark, 10, F.lit(1.0)), 5, 5, 6, 2).collect()


def test_vignetting_fit(spark):
    p = frame(spark, 200, F.lit(1.0))
    q = (F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    v = F.lit(5.0) * (F.lit(1.0) - q * 0.8 + q * q * 0.4 - q * q * q * 0.3)
    r = OG.fit_vignetting(p.withColumns({"r": v, "g": v, "b": v})).first()
    assert (r["a"], r["b"], r["c"]) == pytest.approx((-0.8, 0.4, -0.3), rel=1e-5)


# --- stencils ---


@pytest.mark.parametrize(("sweeps", "per_round"), [(23, 8), (160, 20)])
def test_relax_equals_plain_sweeps(spark, sweeps, per_round):
    p = frame(spark, 70, F.col("x") * 1.0 + F.pmod(F.xxhash64("y", "x"), F.lit(50)))
    hole = F.col("x").between(20, 45) & F.col("y").between(0, 25)
    a = np.zeros((70, 70))
    pdf = p.toPandas()
    a[pdf.y, pdf.x] = pdf.lum
    h = np.zeros((70, 70), bool)
    h[0:26, 20:46] = True
    got = N.relax(p, ["lum"], hole, sweeps=sweeps, per_round=per_round).toPandas()
    for _ in range(sweeps):
        s, w = np.zeros_like(a), np.zeros_like(a)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    k = 1.0 if dy == 0 or dx == 0 else math.sqrt(0.5)
                    b, m = np.zeros_like(a), np.zeros_like(a)
                    ys, xs = slice(max(0, -dy), 70 - max(0, dy)), slice(max(0, -dx), 70 - max(0, dx))
                    yd, xd = slice(max(0, dy), 70 - max(0, -dy)), slice(max(0, dx), 70 - max(0, -dx))
                    b[ys, xs], m[ys, xs] = a[yd, xd], 1.0
                    s, w = s + b * k, w + m * k
        a = np.where(h, s / w, a)
    out = np.zeros((70, 70))
    out[got.y, got.x] = got.lum
    assert np.allclose(out, a)


def test_box_on_tile_borders(spark):
    p = frame(spark, 150, F.pmod(F.xxhash64("y", "x"), F.lit(1000)) * 1.0)
    got = N.box_mean(p, "lum", 6).toPandas()
    a = np.zeros((150, 150))
    pdf = p.toPandas()
    a[pdf.y, pdf.x] = pdf.lum
    e = np.pad(a, 10, mode="symmetric")
    want = np.array([[e[y + 7 : y + 13, x + 7 : x + 13].mean() for x in range(150)] for y in range(150)])
    out = np.full((150, 150), -1.0)
    out[got.y, got.x] = got["mean"]
    assert np.allclose(out, want) and len(got) == 150 * 150


# --- headers, sources and sinks ---


def header(spark, lines):
    d = H.describe(spark.createDataFrame([(lines,)], "header_lines array<string>"))
    r = d.select("header", H.exposure_product(F.col("header_lines")).alias("e"), H.in_cdm2(F.col("header")).alias("cd")).first()
    return r["header"], r["e"], r["cd"]


def test_header_rules(spark):
    h, _, _ = header(spark, ["#?RADIANCE", "\tLuminanceRGB= 0.2 0.7 0.1", "\tXYZCAM= 1 0 0 0 1 0 0 0 1", "LuminanceRGB= 0.26 0.67 0.07", "FORMAT=32-bit_rle_rgbe"])
    assert h["LuminanceRGB"] == "0.26 0.67 0.07" and "XYZCAM" not in h
    h, e, _ = header(spark, ["#?RADIANCE", "pcomb -s 0.5 in.hdr", "\tLuminanceRGB= 0 1 0", "\tVIEW= -vta -vh 180 -vv 180", "\tEXPOSURE=2", "FORMAT=32-bit_rle_rgbe"])
    assert h["LuminanceRGB"] == "0 1 0" and "VIEW" not in h and e == 1.0
    h, _, _ = header(spark, ["#?RADIANCE", "\t\tLuminanceRGB= 0.2 0.7 0.1", "\t\tPRIMARIES= 0.64 0.33 0.30 0.60 0.15 0.06 0.3127 0.3290", "\tLuminanceRGB= 0 1 0"])
    assert h["LuminanceRGB"] == "0 1 0" and "PRIMARIES" not in h
    assert header(spark, ["#?RADIANCE", "EXPOSURE=2", "\tEXPOSURE=4", "EXPOSURE= 0.25"])[1] == 0.5
    h, _, cd = header(spark, ["#?RADIANCE", "VIEW= -vta -vh 180 -vv 180", "VIEW= -vtv -vh 60 -vv 45", "RIG_COLOR= XYZ cd/m2"])
    assert h["VIEW"] == "-vtv -vh 60 -vv 45" and cd
    assert not header(spark, ["#?RADIANCE", "RIG_COLOR= xyz"])[2]
    # keys of other programs neither mark the unit nor hide copied colour keys
    h, _, cd = header(spark, ["#?RADIANCE", "BACKGROUND_COLOR= grey, 100 cd/m2", "\tPRIMARIES= 0.64 0.33 0.30 0.60 0.15 0.06 0.3127 0.3290"])
    assert not cd and "PRIMARIES" in h


def encode(img, rle, res="-Y {h} +X {w}"):
    h, w, _ = img.shape
    out = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n" + res.format(h=h, w=w).encode() + b"\n"
    for row in img:
        if not rle:
            out += row.tobytes()
            continue
        out += bytes([2, 2, w >> 8, w & 255])
        for ch in range(4):
            v, i = row[:, ch], 0
            while i < w:
                n = 1
                while i + n < w and n < 127 and v[i + n] == v[i]:
                    n += 1
                out += bytes([128 + n, v[i]]) if n > 2 else bytes([1, v[i]])
                i += n if n > 2 else 1
    return out


def test_picture_archive(spark, tmp_path):
    rng = np.random.default_rng(5)
    img = rng.integers(3, 250, (6, 20, 4), dtype=np.uint8)
    img[2, 3:15] = img[2, 3]
    img[..., 3] = rng.integers(120, 140, (6, 20))
    (tmp_path / "a_001.hdr").write_bytes(encode(img, True))
    (tmp_path / "a_002.hdr").write_bytes(encode(img, False))
    (tmp_path / "a_003.hdr").write_bytes(encode(img, False, "+Y {h} +X {w}"))
    want = (img[..., :3] + 0.5) * np.ldexp(1.0, img[..., 3].astype(int) - 136)[..., None]
    images, pixels = P.read_pictures(spark, str(tmp_path / "a_%03d.hdr"))
    assert {(r["width"], r["height"]) for r in images.collect()} == {(20, 6)}
    for path, g in pixels.toPandas().groupby("path"):
        got = np.zeros((6, 20, 3))
        got[g.y, g.x] = g[["r", "g", "b"]]
        assert np.allclose(got, want[::-1] if "003" in path else want)
    assert P.list_inputs(spark, [str(tmp_path / "a_%03d.hdr"), str(tmp_path)]).count() == 3
    with pytest.raises(Exception):
        P.list_inputs(spark, [str(tmp_path / "none*.hdr")])
    bad = spark.createDataFrame([("p", bytearray(encode(img, True)[:-9]))], "path string, content binary")
    with pytest.raises(Exception):
        P.decode(bad).collect()


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# t\n0 1\n10 1.1\n5 1.2\n")
    got = TB.vignetting_tables(TB.read_texts(spark, str(tmp_path / "v.txt")))
    assert [r["problem"] for r in got.orderBy("fr").collect()] == [None, None, "angle not increasing"]
    with pytest.raises(Exception, match="not increasing"):
        TB.checked(got).collect()
    (tmp_path / "s.csv").write_text("# nm,v\n380,0.1\n390,0.3\nbad,row\n")
    assert TB.spectral_curves(spark, str(tmp_path / "s.csv")).count() == 2
    (tmp_path / "c.tsv").write_text("filename\tkind\tscore\na.png\tinstance\t0.7\nb.png\tSemantic\tx\nc.png\tother\t1\n")
    assert sorted(map(tuple, TB.mask_manifest(spark, str(tmp_path / "c.tsv")).collect())) == [("a.png", "instance", 0.7), ("b.png", "semantic", 0.0)]
    d = spark.createDataFrame([(1, 'a "q", b', 2.5)], "id int, name string, v double")
    TB.write_csv(d, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()["name"] == 'a "q", b'
    TB.write_text(spark.createDataFrame([(0.5, None)], "dgp double, ugr double"), TB.summary_line(("dgp", "ugr")), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == "dgp,ugr: 0.500000 -99.000000"


# --- masks, calibration, sun, volume ---


def test_unique_masks_prefers_instances_then_score(spark):
    px = [(1, m, k, s, y, x) for m, k, s in ((1, "semantic", 0.9), (2, "instance", 0.3), (3, "instance", 0.6)) for y in range(3) for x in range(3)]
    px += [(1, 4, "semantic", 0.1, 0, x) for x in range(9)]
    d = spark.createDataFrame(px, "image_id int, mask_id int, kind string, score double, y int, x int")
    assert {r["mask_id"] for r in RG.unique_masks(d).collect()} == {3, 4}


def test_shift_is_found(spark):
    p = frame(spark, 48, F.pmod(F.xxhash64("y", "x"), F.lit(1000)) + 1.0)
    q = p.withColumns({"x": F.col("x") + 3, "y": F.col("y") - 2}).filter("x < 48 and y >= 0")
    r = M.estimate_shift(p, q).first()
    assert (r["dx"], r["dy"]) == (3, -2) and r["corr"] == pytest.approx(1.0) and r["inside"]
    assert not M.estimate_shift(p, q, margin=3).first()["inside"]


def test_far_shift_is_found_from_coarse_to_fine(spark):
    spots = lambda x, y: sum((F.exp(-(F.pow(x - a, 2) + F.pow(y - b, 2)) / w) * h for a, b, w, h in ((60, 150, 300.0, 5.0), (130, 120, 900.0, 3.0), (100, 170, 120.0, 8.0), (30, 110, 500.0, 4.0))), F.lit(1.0))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    p = frame(spark, 200, F.lit(1.0)).withColumn("lum", spots(x, y))
    q = p.withColumn("lum", spots(x - 40.0, y + 23.0) * 1.3)
    r = M.estimate_far_shift(p, q).first()
    assert (r["dx"], r["dy"]) == (40, -23) and r["corr"] == pytest.approx(1.0, abs=1e-6) and r["inside"]
    assert not M.estimate_far_shift(p, q, reach=32, levels=2).first()["inside"]


def test_source_energy_is_kept(spark):
    p = frame(spark, 128, F.lit(0.0)).withColumns({ch: F.lit(0.0) for ch in "rgb"})
    n = math.sqrt(0.3**2 + 0.8**2 + 0.4**2)
    sun = spark.createDataFrame([(0, 0.3 / n, 0.8 / n, 0.4 / n)], "image_id bigint, sx double, sy double, sz double")
    rgb = spark.createDataFrame([(0, 1000.0, 900.0, 800.0)], "image_id bigint, r double, g double, b double")
    out = M.add_source(p, sun, rgb, 6.8e-5, (128, 128))
    e = out.agg(F.sum(F.col("g") * F.col("omega"))).first()[0]
    assert e == pytest.approx(900.0 * 6.8e-5, rel=1e-6)
    top = out.orderBy(F.desc("g")).first()
    assert top["dx"] * 0.3 / n + top["dy"] * 0.8 / n + top["dz"] * 0.4 / n > math.cos(math.radians(3))


def test_near_source_fill_equals_brute_force(spark):
    p = frame(spark, 40, F.lit(1.0)).withColumns({ch: F.pmod(F.xxhash64("y", "x", F.lit(ch)), F.lit(100)) * 1.0 for ch in "rgb"})
    rr = F.sqrt((F.col("x") - 20) * (F.col("x") - 20) + (F.col("y") - 18) * (F.col("y") - 18))
    p = p.withColumn("near", F.greatest(F.lit(0.0), F.lit(1.0) - rr / 8.0))
    got = M.fill_near_source(p, 6.0, tile=16).orderBy("y", "x").toPandas()
    a = p.orderBy("y", "x").toPandas()
    low = 2.0 / 12.0
    seeds = a[a.valid & (a.near > low) & (a.near < 0.5)]
    k = min(300, max(1, int(len(seeds) * 0.2)))
    sd = seeds[["dx", "dy", "dz"]].to_numpy()
    for i in a.index[a.valid & (a.near > 0.01)]:
        d = np.sqrt(((sd - a.loc[i, ["dx", "dy", "dz"]].to_numpy(float)) ** 2).sum(axis=1))
        o = np.argsort(d, kind="stable")[:k]
        if k < len(d) and abs(np.sort(d)[k - 1] - np.sort(d)[k]) < 1e-12:
            continue
        w = np.exp(-d[o] ** 2 / (2 * (d[o] ** 2).mean()))
        m = min(1.0, a.near[i])
        want = a.r[i] * (1 - m) + (seeds["r"].to_numpy()[o] * w).sum() / w.sum() * m
        assert got.r[i] == pytest.approx(want, rel=1e-9)


def test_dark_bands(spark):
    x = np.arange(200)
    v = np.where((x % 50) < 8, 10.0, 100.0)
    d = spark.createDataFrame([(1, int(i), float(q)) for i, q in zip(x, v)], "image_id int, pos int, mean double")
    got = K.dark_bands(d, 4).orderBy("begin").collect()
    assert [(r["begin"], r["end"]) for r in got if r["end"] - r["begin"] >= 4] and len(got) >= 4


def test_pchip_is_monotone_and_exact_at_knots(spark):
    c = spark.createDataFrame([("a", 400.0, 0.0), ("a", 500.0, 1.0), ("a", 520.0, 1.0), ("a", 700.0, 3.0)], "curve string, nm double, v1 double")
    g = spark.range(400, 701).select(F.col("id").cast("double").alias("nm"))
    r = K.resample_curve(c, g, ["curve"]).orderBy("nm").toPandas()
    assert len(r) == 301 and (np.diff(r.v1) >= -1e-12).all()
    assert r.set_index("nm").v1[500.0] == 1.0 and r.set_index("nm").v1[700.0] == pytest.approx(3.0)


def test_satisfaction_needs_all_coefficients():
    with pytest.raises(ValueError):
        VV.satisfaction("a", "b", 1.0, None, 0.0)


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    from lumenfield.streaming import captures as ST

    src = tmp_path / "in"
    src.mkdir()
    schema = "camera long, kind string, ts timestamp, value double"
    # a frame is late against the watermark the previous trigger worked with
    days = (("2024-01-05", 1.0), ("2024-01-06", 2.0)), (("2024-01-07", 4.0),), (("2024-01-01", 3.0), ("2024-01-09", 5.0))
    for n, rows in enumerate(days):
        pdf = pd.DataFrame([(1, "k", pd.Timestamp(d), v) for d, v in rows], columns=["camera", "kind", "ts", "value"])
        spark.createDataFrame(pdf, schema).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        for f in (tmp_path / f"p{n}").glob("part-*.parquet"):
            f.rename(src / f"{n}.parquet")
            os.utime(src / f"{n}.parquet", (1.7e9 + 60 * n, 1.7e9 + 60 * n))
    stream = ST.read_captures(spark, str(src), spark.read.schema(schema).parquet(str(src)).schema, files_per_batch=1)
    table, q = ST.run_available(ST.window_stats(ST.observed(stream, "1 day"), "1 day", late=None))
    got = sorted(r["v_max"] for r in table.collect())
    assert 3.0 not in got and 1.0 in got
    assert ST.late_rows(q.recentProgress) == 1


def test_sql_functions_agree_with_columns(spark):
    from lumenfield.functions import geometry as G
    from lumenfield.functions.numeric import erf
    from lumenfield.functions.sql import register

    register(spark)
    d = G.with_position_index(frame(spark, 24, F.lit(1.0)).filter("valid"), "p")
    d = d.withColumn("a", F.expr("lf_position_angles(dx, dy, dz)")).withColumn("q", F.expr("lf_guth(a.sigma, a.tau, a.phi)"))
    assert d.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-5
    e = spark.range(-30, 31).select((F.col("id") / 10.0).alias("v")).select("v", erf("v").alias("a"), F.expr("lf_erf(v)").alias("b")).collect()
    assert all(abs(r["a"] - math.erf(r["v"])) < 2e-7 and abs(r["a"] - r["b"]) < 1e-12 for r in e)
