"""URL cascade, filter audit and hard negatives against brute force, and edge cases."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from lumenfield.llm import filter_audit, hard_negatives, url_cascade
from lumenfield.llm.tables import Workspace

PAGES = "page_id long, url string, key string, h1 long, listed string, host string"


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "k", 1, "l", "h") for i, u in urls], PAGES)


def plain_verdict(url, listed, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    rule = max(fits, key=len) if fits else None
    names = host.split(".")
    keys = {".".join(names[i:]) for i in range(len(names))} | {host + (path or "/")} if host else set()
    return host, path, rule, rules[rule] if rule else "block" if keys & listed else "allow", bool(keys & listed)


@pytest.mark.parametrize("keys_a_part", [url_cascade.KEYS, 150])
def test_cascade_is_exact(spark, keys_a_part):
    rng = np.random.default_rng(5)
    hosts = [f"{a}.s{i}.{t}" for i in range(400) for a, t in [(rng.choice(["www", "Blog", "m.x"]), rng.choice(["net", "com", "org"]))]]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['', 'en/', 'de/a', 'fr/'])}{rng.integers(40)}{rng.choice(['', '?q=1', '#x'])}" for _ in range(4000)]
    urls += [None, "", "no scheme", "a://", "a:///p", "x://net", "x://NET/", "x://" + "a." * 3000 + "net/en/", "x://s1.com:80/", urls[0], "x://a/b://c.net/"]
    listed = {f"s{i}.com" for i in range(0, 400, 3)} | {f"s{i}.net" for i in range(200)} | {u.split("://")[1].split("?")[0].split("#")[0].lower() for u in urls[:150]} | {"absent.example"}
    got = url_cascade.judge(pages_of(spark, list(enumerate(urls))), spark.createDataFrame([(k,) for k in [*listed, "", "s0.com"]] + [(None,)], "key string"), url_cascade.RULES, keys_a_part=keys_a_part)
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict, r.listed) == plain_verdict(urls[r.page_id], listed, url_cascade.RULES), urls[r.page_id]
    assert got.count() == len(urls)


def test_levels_shrink_and_every_key_is_decided(spark):
    keys = spark.range(60_000).selectExpr("concat('k', id) AS key")
    [(parts, part, levels)] = url_cascade.build(keys, keys.where("substr(key, -1) = '7'"), Workspace(spark))
    sizes = [x.size for x in levels]
    assert (parts, part) == (1, 0) and len(levels) > 4 and sizes[4] < sizes[1]
    # below what the listed keys alone would take as 64-bit hashes
    assert sum(sizes) < 6_000 * 20


def test_cascade_empty(spark):
    none = spark.createDataFrame([], "key string")
    assert url_cascade.judge(pages_of(spark, []), none, url_cascade.RULES).count() == 0
    r = url_cascade.judge(pages_of(spark, [(None, "http://a.casino.com/x")]), none, {}).first()
    assert (r.page_id, r.host, r.path, r.rule, r.verdict) == (None, "a.casino.com", "/x", None, "allow")


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang)."""
    fails, parts = [], []
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        f = set()
        f |= {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs) else set()
        good = any(i == doc_id and i is not None and q == 1 for i, q, _ in labels)
        toxic = any(i == doc_id and i is not None and t == 1 for i, _, t in labels)
        fails.append((lang or "", f, good, toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for s, x in enumerate(order):
            for p, f, good, toxic in fails:
                c = out.setdefault((p, "".join(order), s + 1), [0] * 6)
                gone = bool(f & set(order[:s]))
                removed = x in f and not gone
                for i, v in enumerate((x not in f and not gone, removed, x in f and gone, f == {x}, removed and good, removed and toxic)):
                    c[i] += v
                shapley[p, x] += removed
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_as_brute_force(spark, make):
    rng = np.random.default_rng(8)
    texts = [None, "", " \n", "Same TEXT", "a#b", "w " * 250, "W " * 250, " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i}|" for i in range(220)), "x" * 200_000, "é\u00a0ß " * 210]
    docs = [(int(i), texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)]) for i in rng.permutation(300)]
    docs += [(None, "Same TEXT", "en"), (None, "Same TEXT", None), (None, None, "en"), (7, "Same TEXT", "en"), (7, "Same TEXT", "en"), (-5, "a#b", "de"), (-5, "a#b", "de")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 300, 2)] + [(None, 1, 1), (3, None, None), (4, 1, None), (4, 0, 1), (-5, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.document_masks(make(docs), table), "ABCDE")
    rows = {(r.part, r.filter_order, r.step): tuple(r[f] for f in (*filter_audit.FIELDS, "shapley")) for r in got.collect()}
    assert rows == plain_audit(docs, labels)
    assert len(rows) == got.count() == 600 * 3


def test_audit_fields_do_not_overflow():
    masks, counts = [0, 1, 3, 31, 127], [255, 2**40, 1, 2**33 - 1, 10**12]
    got = filter_audit.totals(masks, counts, 5)
    want = sum(n * filter_audit.outcomes(m, 5).astype(np.int64) for m, n in zip(masks, counts, strict=True))
    assert (got == want).all()
    assert (filter_audit.totals([0], [256], 5)[:, :, 0] == 256).all()


def test_audit_empty(spark, nothing):
    assert filter_audit.audit(filter_audit.document_masks(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "ABCDE").count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, d int, block long, key binary, v string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, 1, 2, b"k", "v") for i, v, c in rows], VECTORS)


def plain_negatives(rows, every=100, scale=256):
    ok = [(i, np.floor(scale * np.float32(v).astype(float)).astype(int), c) for i, v, c in rows if i is not None and c is not None and v and not any(x is None or not np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, c in ok:
        if i % every == 0:
            one = (len(v), c, v.tolist())
            anchors[i] = min(anchors.get(i, one), one)
    out = []
    for a, (d, c, v) in anchors.items():
        s = [(-int(np.dot(v, w)), i, k) for i, w, k in ok if i != a and len(w) == d]
        for p, i, _ in sorted(x for x in s if x[2] == c)[:5]:
            hard = sorted((n, j) for n, j, k in s if k != c and 80 * -p <= 100 * -n <= 100 * -p)[:5]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(hard)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)
    monkeypatch.setattr(hard_negatives, "ZONES", 8)


def test_negatives_as_brute_force(spark, small_blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i) * 10, (centres[rng.integers(12)] + rng.normal(size=8) * 0.3).tolist(), int(rng.integers(3))) for i in rng.permutation(900)]
    rows += [(5000 + i, [1.0] * 8, i % 2) for i in range(200)]  # a large group of equal vectors and ties
    got = mined(hard_negatives.mine(vectors_of(spark, rows)))
    assert got == plain_negatives(rows) and len(got) > 500


def test_negatives_edges(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (100, [], 1), (200, [nan, 1], 1), (300, [inf, 1], 1), (400, [None, 1], 1), (500, [1, 1], None), (None, [1, 1], 1)]
    rows += [(600, [1, 1], 1), (600, [1, 1], 1), (600, [1, 2], 1), (1, [1, 1], 1), (1, [1, 1], 1), (2, [1, 0.9], 2), (2, [1, 0.9], 2), (3, [1, 1, 1], 2), (700, [1, 1, 1], 2), (4, [1, 1, 1], 2), (5, [1, 1, 0.9], 1)]
    rows += [(800, [-1, -1], 3), (6, [1, 1], 3), (7, [0, 0], 3), (900, [0, 0], 4), (8, [0, 0], 4)]
    got = mined(hard_negatives.mine(vectors_of(spark, rows)))
    assert got == plain_negatives(rows) and got
    assert hard_negatives.mine(vectors_of(spark, [])).count() == 0
    assert hard_negatives.mine(vectors_of(spark, [(1, [1.0], 1)])).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i * 50, [float(1 << 20) + i, float(1 << 21) - i, 3.0], i % 2) for i in range(40)]
    assert mined(hard_negatives.mine(vectors_of(spark, rows), scale=1)) == plain_negatives(rows, scale=1)


def test_zone_maps_leave_blocks_unread(spark, small_blocks):
    rng = np.random.default_rng(4)
    centres = np.eye(16)[:8] * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * 0.05).tolist(), i % 3) for i in range(4000)]
    m = hard_negatives.Miner(vectors_of(spark, rows), 100, 256, "vec_id", "embedding", "label")
    found = m.search(m.windows(None, 1, (80, 100)), 5, "positives", same=True)
    asked = sum(len(r.who) for r in spark.read.parquet(f"{m.work.folder}/positives-pairs").collect())
    assert found.count() == 40 * 5
    assert asked < 0.3 * 40 * m.blocks.count()


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_steps_to_a_neighbour(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), axis=-1).reshape(-1, d)
    keys = [k.tobytes() for k in hard_negatives.hilbert_key(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_interval_bounds_hold(spark):
    rng = np.random.default_rng(6)
    v, q = rng.integers(-50, 50, (300, 7)), rng.integers(-50, 50, (20, 7))
    under, over = hard_negatives.bounds(q, v.min(0)[None], v.max(0)[None])
    s = q @ v.T
    assert (under <= s.min(1, keepdims=True)).all() and (over >= s.max(1, keepdims=True)).all()
