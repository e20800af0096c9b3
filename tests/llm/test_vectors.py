"""Operators on vectors against brute force, and edge cases."""

import numpy as np
import pytest

from lumenfield.llm import neighbours, top_k

SCHEMA = "vec_id long, embedding array<float>, u string, sim string, d int"


@pytest.fixture(scope="module")
def vectors(spark):
    def build(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "u", "s", 1) for i, v in rows], SCHEMA)

    return build


def cloud(seed, singles, groups, size, dim=16):
    """Single vectors, and groups of copies with noise around the threshold."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(singles)]
    for _ in range(groups):
        c = rng.normal(size=dim)
        out += [c + rng.normal(size=dim) * 0.22 for _ in range(size)] + [c, c]
    rng.shuffle(out)
    return [(i * 3 + 1, np.float32(v).tolist()) for i, v in enumerate(out)]


def brute_links(rows, threshold=0.9):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return {rows[i][0]: (int(near[i].sum()) - 1, rows[find(i)][0]) for i in range(len(rows))}


def test_links_as_brute_force(vectors):
    rows = cloud(1, 300, 12, 30)
    found, figures = neighbours.near_duplicates(vectors(rows))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    want = brute_links(rows)
    assert figures["audit_found"] >= 0.9 * figures["audit_links"]
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_links_between_dense_groups(vectors):
    """Groups so dense that every list is full of own members, with links across: only a search beyond the lists sees them."""
    rng = np.random.default_rng(7)
    out = []
    for _ in range(6):
        a, b, c = np.linalg.qr(rng.normal(size=(24, 3)))[0].T
        other = 0.92 * a + np.sqrt(1 - 0.92**2) * b
        for centre, size in ((a, 40), (other, 300), (c, 20)):
            out += list(centre + rng.normal(size=(size, 24)) * 0.01)
    rows = [(i * 2 + 1, np.float32(out[k]).tolist()) for i, k in enumerate(rng.permutation(len(out)))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(vectors(rows))[0].collect()}
    assert got == brute_links(rows)


def test_isolated_pairs_are_found(vectors):
    """300 pairs just above the threshold among single vectors: nothing near them leads a descent to them."""
    rng = np.random.default_rng(11)
    out = list(rng.normal(size=(20000, 32)))
    for _ in range(300):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        out += [a, 0.901 * a + np.sqrt(1 - 0.901**2) * b]
    found, figures = neighbours.near_duplicates(vectors([(i, np.float32(v).tolist()) for i, v in enumerate(out)]))
    got = {r.vec_id: r.n_links for r in found.where("vec_id >= 20000").collect()}
    assert sum(n > 0 for n in got.values()) >= 0.995 * 600
    assert figures["audit_found"] >= 0.99 * figures["audit_links"] > 0


def test_a_failed_audit_raises(vectors, monkeypatch):
    """Lists too short for what is asked of them: the search must say so."""
    monkeypatch.setattr(neighbours, "_best", lambda pairs: pairs.where("u % 2 = 1 and v % 2 = 1 and u % 3 = 0").dropDuplicates(["u"]))
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.near_duplicates(vectors([(i, v) for i, (_, v) in enumerate(cloud(4, 20, 6, 5))]))


def test_tables_follow_bits():
    for n in (10, 10**4, 10**5, 10**6, 10**7, 10**8):
        bits, tables = neighbours.plan(n, 0.9)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= 0.002


def test_links_edges(vectors):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(vectors(rows))[0].collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)]
    assert got == sorted([*alone, (None, 0, None, True), (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False)], key=str)
    assert neighbours.near_duplicates(vectors([]))[0].count() == 0


def brute_top(rows, k, every):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_as_brute_force(vectors):
    rows = [(i, v) for i, (_, v) in enumerate(cloud(3, 500, 3, 40))]
    rows += [(5000, [0.0] * 16), (5001, [1.0] * 16), (5100, [1.0] * 16), (5200, [1.0] * 15), (5201, None), (5300, [1.0, None] * 8), (5400, [float("nan")] * 16)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(vectors(rows)).collect())
    assert got == brute_top(rows, 10, 100)


def test_top_k_edges(vectors):
    assert top_k.top_k(vectors([])).count() == 0
    assert top_k.top_k(vectors([(100, [1.0])])).count() == 0
    few = [(100, [1.0, -1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(vectors(few)).collect()) == [(100, 1, 1, 0), (100, 2, 2, 0)]


def test_blocks_stop_before_the_end():
    """Reading stops early where a few candidates stand out, and scores are exact."""
    rng = np.random.default_rng(2)
    values = rng.integers(-50, 50, size=(3000, 8))
    values[:5] += 4000
    order = np.argsort(-values, axis=0, kind="stable").T.astype(np.int32)
    query = np.array([3, 1, 2, 5, 1, 1, 2, 9])
    mixed = rng.integers(-9, 9, size=(20, 8))
    huge = np.array([[1 << 48, -(1 << 48), 1, 0, 0, 0, 0, 3]])
    for queries in (query[None], mixed, huge):
        found = top_k.search_block(values, order, np.arange(3000), queries, np.arange(len(queries)) + 7, 3)
        for (ids, scores), q, own in zip(found, queries, range(7, 7 + len(queries)), strict=True):
            want = [i for i in np.lexsort((np.arange(3000), -(values @ q))) if i != own][:3]
            assert ids.tolist() == want and scores.tolist() == (values @ q)[want].tolist()
