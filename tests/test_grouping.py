"""Connected components and glare sources against plain union of near pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import geometry as G
from lumenfield.operators import glare as L
from lumenfield.operators import stencil as N
from lumenfield.operators.graph import components


def united(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(500).tolist()
    graphs = {
        "chain": list(zip(order, order[1:])), "path": [(i, i + 1) for i in range(499)], "star": [(499, i) for i in range(499)],
        "random": rng.integers(0, 500, (300, 2)).tolist(), "lone": [(i, i) for i in range(0, 500, 7)],
    }
    edges = spark.createDataFrame([(k, 1, int(a), int(b)) for k, e in graphs.items() for a, b in e], "g string, parent int, a long, b long")
    got = {(r.g, r.node): r.comp for r in components(edges, ["g", "parent"]).collect()}
    want = {}
    for k, e in graphs.items():
        label = united(500, e)
        want |= {(k, i): label[i] for i in {int(x) for pair in e for x in pair}}
    assert got == want
    assert components(edges.limit(0), ["g", "parent"]).count() == 0


def bright(spark, n, share, seed):
    px = spark.range(n * n).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), F.lit(n).alias("width"), F.lit(n).alias("height"))
    blob = F.pmod(F.xxhash64(F.floor(F.col("y") / 9), F.floor(F.col("x") / 7), F.lit(seed)), F.lit(100)) < share
    dot = F.pmod(F.xxhash64("y", "x", F.lit(seed)), F.lit(1000)) < 20
    px = px.withColumn("lum", F.when(blob | dot, 5000.0).otherwise(10.0))
    return G.with_geometry(px)


@pytest.mark.parametrize(("n", "search", "share"), [(200, 0.02, 12), (200, 0.06, 10), (120, 0.4, 3), (64, 0.2, 20)])
def test_sources_equal_plain_grouping(spark, n, search, share):
    src = L.source_pixels(bright(spark, n, share, 3)).cache()
    got = L.group_sources(src, search).select("y", "x", "dx", "dy", "dz", "label").toPandas()
    d = got[["dx", "dy", "dz"]].to_numpy()
    pairs = []
    for i in range(0, len(d), 500):
        a, b = np.nonzero(d[i : i + 500] @ d.T >= np.cos(search / 2))
        pairs += list(zip((a + i).tolist(), b.tolist()))
    comp = np.array(united(len(d), pairs))
    number = (got.y * n + got.x).to_numpy()
    first = {c: int(number[comp == c].min()) for c in set(comp.tolist())}
    assert got.label.tolist() == [first[c] for c in comp.tolist()]
    assert len(first) > 3


def test_plan_of_evaluate_holds_few_exchanges(spark):
    plan = L.evaluate(bright(spark, 64, 20, 3), split=8000.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 18


def test_relax_ends_when_nothing_moves(spark):
    px = spark.range(130 * 130).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / 130).cast("int").alias("y"), (F.col("id") % 130).cast("int").alias("x"), F.lit(130).alias("width"), F.lit(130).alias("height"))
    p = px.withColumn("lum", F.lit(7.0))
    hole = F.col("y").between(60, 66) & F.col("x").between(60, 66)
    got = N.relax(p, ["lum"], hole, sweeps=10**6)
    assert got.count() == 130 * 130 and got.where("abs(lum - 7) > 1e-12").isEmpty()
