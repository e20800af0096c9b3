"""Exact ranks of split groups against sorted lists, and how evenly the ranges fall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import ranking as R

ROWS = 1000
WANTED = {"a": ("median", 0.5), "b": ("paired", 0.75), "c": ("lower", 0.35), "d": ("linear", 0.9), "e": ("nth", 0.999)}


def groups():
    rng = np.random.default_rng(2)
    narrow = 1000 + rng.random(20_000)
    return {
        "narrow": narrow, "constant": np.full(6000, 5.0), "few": rng.integers(0, 3, 9000).astype(float), "heavy": np.where(rng.random(12_000) < 0.6, 7.25, rng.normal(size=12_000)),
        "small": rng.normal(size=50), "signs": rng.normal(size=5000) * 10.0 ** rng.integers(-300, 300, 5000), None: rng.random(3000), "one": np.array([2.0]),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, int(i), float(v), "n", 1) for k, vs in groups().items() for i, v in enumerate(vs)]
    rows += [("heavy", -1 - i, None, "n", 1) for i in range(2500)]
    return spark.createDataFrame(rows, "k string, y int, v double, n string, cnt int").repartition(8).cache()


def plain(v, kind, p):
    s, n = np.sort(v), len(v)
    at = lambda i: s[int(i)] if 0 <= i < n else 0.0
    if kind == "median":
        return (s[(n - 1) // 2] + s[n // 2]) / 2
    if kind == "paired":
        return (at(int(n * p)) + at(int(n * p - 1))) / 2
    if kind == "lower":
        return s[math.floor((n - 1) * p)]
    if kind == "nth":
        return s[int(n * p)]
    f = (n - 1) * p - math.floor((n - 1) * p)
    return s[math.floor((n - 1) * p)] * (1 - f) + s[min(math.floor((n - 1) * p) + 1, n - 1)] * f


def test_percentiles_of_split_groups(table, monkeypatch):
    monkeypatch.setattr(R, "ROWS", ROWS)
    got = {r.k: r for r in R.percentiles(table.withColumnRenamed("n", "m"), ["k"], "v", WANTED).collect()}
    assert set(got) == set(groups())
    for k, v in groups().items():
        assert got[k].n == len(v)
        assert {x: got[k][x] for x in WANTED} == pytest.approx({x: plain(v, *d) for x, d in WANTED.items()}, rel=1e-12), k


def test_value_ranks_of_split_groups(table):
    got = {}
    for r in R.value_ranks(table.select("k", "v"), ["k"], "v", rows=ROWS).collect():
        got.setdefault(r.k, []).append((r.v, r.cnt, r.lo, r.n))
    for k, v in groups().items():
        values, first, counts = np.unique(v, return_index=True, return_counts=True)
        lo = np.concatenate([[0], np.cumsum(counts)[:-1]])
        assert sorted(got[k]) == [(a, c, b, len(v)) for a, b, c in zip(values, lo, counts, strict=True)], k


def test_ranked_list_of_split_groups(table):
    got = {}
    for r in R.ranked(table, ["k"], "v", {"total": F.col("v")}, ("y",), rows=ROWS).collect():
        got.setdefault(r.k, []).append((r.rank, r.y, r.v, r.total))
    for k, v in groups().items():
        order = np.lexsort((np.arange(len(v)), -v))
        rows = sorted(got[k])
        assert [r[:3] for r in rows[: len(v)]] == [(i + 1, o, v[o]) for i, o in enumerate(order.tolist())], k
        assert np.allclose([r[3] for r in rows[: len(v)]], np.cumsum(v[order]), rtol=1e-9, atol=1e-9 * np.abs(v).max())
        # rows without a value stand last, by their ties
        assert [r[1] for r in rows[len(v) :]] == ([-2500 + i for i in range(2500)] if k == "heavy" else [])


@pytest.mark.parametrize("constant", [False, True])
def test_no_task_above_the_row_count(spark, constant):
    n, rows = 1_000_000, 50_000
    v = F.lit(3.5) if constant else 1000 + (F.col("id") * 7919 % n) / n
    df = spark.range(n, numPartitions=8).select(F.lit(1).alias("k"), F.floor(F.col("id") / 1000).cast("int").alias("y"), (F.col("id") % 1000).cast("int").alias("x"), v.alias("v"))
    ranges = R.ranges(df, ["k"], "v", "y", rows)
    sizes = [r[0] for r in ranges.groupBy("k", "_b", "_c").agg(F.count("*")).select("count(1)").collect()]
    assert sum(sizes) == n and max(sizes) <= rows and len(sizes) >= n / rows
    last = R.ranked(df, ["k"], "v", {}, ("y", "x"), rows=rows).where("rank in (1, 1000000)").orderBy("rank").collect()
    assert [(r.y, r.x) for r in last] == [(0, 0), (999, 999)] if constant else [r.v for r in last] == [1000 + (n - 1) / n, 1000.0]


def test_nothing_and_no_keys(spark):
    none = spark.createDataFrame([], "k int, y int, v double")
    assert R.percentiles(none, ["k"], "v", WANTED).count() == R.ranked(none, ["k"], "v", {}, ("y",)).count() == 0
    df = spark.range(5000).selectExpr("id AS y", "cast(id % 700 AS double) AS v")
    assert R.percentiles(df, [], "v", {"a": ("median", 0.5)}).first().a == 342.0
    assert R.value_ranks(df, [], "v", rows=1000).agg(F.max("lo"), F.max("n")).first() == (4993, 5000)


@pytest.mark.parametrize("rows", [None, 1000])
def test_rows_of_a_task_do_not_grow_with_the_table(spark, monkeypatch, rows):
    monkeypatch.setattr("lumenfield.session.PART_ROWS", 5000)
    df = spark.range(100_000, numPartitions=8).select((F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    for out in (R.value_ranks(df, ["k"], "v", rows=rows), R.ranked(df, ["k"], "v", {}, ("v",), rows=rows)):
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
        assert sum(sizes) == 100_000 and max(sizes) <= 20_000
