"""Exact order statistics and running sums for groups of any size.

Groups of at most ``ROWS`` rows are sorted whole, by one exchange. Larger ones, which one count finds beforehand, are cut into ranges of their own values: one
pass of mergeable quantile sketches gives each group its split points, totals by range give every range its offset, and the sorting runs by (group,
range). A value that fills several ranges has a range for itself; its rows are all equal, so they are counted where only counts matter, and cut further by their
tie columns where every row has a rank. Sketches differ from run to run and results do not, as long as all uses see the same points: these are saved once.
The same count says into how many partitions rows are dealt, so that a task's memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import NumericType

from lumenfield.session import cut_lineage, parts_for

#: Rows of one group that a task may sort; ranges of larger groups aim at half of it.
ROWS = 1 << 18
#: Most ranges of a group, and the size of its sketch (a rank error of about 0.1 %).
RANGES, SKETCH = 1024, 4096
#: Most rows of a table of ranges that is sent to every executor; longer ones Spark joins like any other table.
SENT = 100_000


def split_points(df: DataFrame, keys: Sequence[str], value: str, rows: int, tie: str | None = None) -> tuple[DataFrame | None, int]:
    """(keys, _points, _tie0, _tie1, _cuts) of the groups with more than ``rows`` rows, None when there are none; and the partitions all rows need.

    ``_points`` are sorted; ``_cuts`` is the number of parts that rows of one value are cut into, evenly over the range of the column ``tie``.
    """
    keys = list(keys)
    sizes = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")))
    every, many = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(F.col("_n") > rows)).first()
    parts = parts_for(df.sparkSession, every)
    if not many:
        return None, parts
    # saved tables have no size that Spark knows: without the hint it would deal all rows by group
    sent = lambda t, most: F.broadcast(t) if many <= most else t
    large = sent(sizes.where(F.col("_n") > rows), SENT)
    # null keys are groups too
    same = [df[k].eqNullSafe(large[k]) for k in keys]
    members = df.join(large, same, "left_semi") if keys else df
    ties = [F.min(tie).cast("double").alias("_tie0"), F.max(tie).cast("double").alias("_tie1")] if tie else [F.lit(None).cast("double").alias("_tie0"), F.lit(None).cast("double").alias("_tie1")]
    s = members.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(value).alias("_v"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH)).alias("_s"), *ties)
    # every step-th of the finest points gives ranges of a quarter to a half of ``rows``
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.lit(RANGES * rows / 2.0) / F.col("_n"))))).cast("int")
    finest = F.kll_sketch_get_quantile_double("_s", F.lit([i / RANGES for i in range(1, RANGES)]))
    points = F.array_sort(F.array_distinct(F.filter(finest, lambda p, i: (i + 1) % step == 0)))
    points = F.when(F.col("_v") > 0, points).otherwise(F.array().cast("array<double>"))
    points = cut_lineage(s.select(*keys, points.alias("_points"), "_tie0", "_tie1", (F.lit(RANGES) / step).cast("int").alias("_cuts")))
    return sent(points, SENT // RANGES * 10), parts


def _range(value: Column) -> Column:
    """Number of the range a value lies in: 2i + 1 for the i-th split point itself, 2i between the points, the last for NaN. A row without points is in range 0.

    The points are searched in two steps, so a row compares with about twice the root of their number.
    """
    n = F.size("_points")
    step = F.ceil(F.sqrt(n)).cast("int")
    heads = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda i: F.element_at("_points", i * step + 1))
    block = F.greatest(F.lit(0), F.size(F.filter(heads, lambda p: p < value)) - 1)
    inside = F.slice(F.col("_points"), block * step + 1, step)
    below = block * step + F.size(F.filter(inside, lambda p: p < value))
    hit = F.coalesce(F.try_element_at("_points", below + 1) == value, F.lit(False))
    return F.when(F.col("_points").isNull(), F.lit(0)).when(F.isnan(value), 2 * n + 1).otherwise(2 * below + hit.cast("int"))


def _ranged(df: DataFrame, keys: Sequence[str], value: str, points: DataFrame) -> DataFrame:
    """Adds ``_b``, the range of each row, and the columns of the split points, which stay null in groups that are not split."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    p = points.withColumnsRenamed(names)
    # by size Spark sends the points to the rows, or splits a group that is too large for one task
    joined = df.join(p, [df[k].eqNullSafe(p[v]) for k, v in names.items()], "left") if keys else df.crossJoin(F.broadcast(p))
    return joined.drop(*names.values()).withColumn("_b", _range(F.col(value).cast("double")))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[Column] | None = None, rows: int | None = None) -> DataFrame:
    """Distinct values with their rank range: (keys, value, cnt, lo, n); the value occupies 0-based ranks lo … lo+cnt-1 of n.

    wanted: ranks, as expressions of ``n``, of which only the values are needed; ranges of split groups without any of them are left out.
    """
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull()).select(*keys, value)
    points, parts = split_points(df, keys, value, rows or ROWS)
    if points is None:
        by = [F.col(k) for k in keys]
        counts = df.repartition(parts if by else 1, *by).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
        w = W.partitionBy(*keys)
        lo = F.sum("cnt").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, -1))
        return counts.select(*keys, value, "cnt", F.coalesce(lo, F.lit(0)).alias("lo"), F.sum("cnt").over(w).alias("n"))
    # rows of one value meet in one task, but those of a split point, of which there may be any number, in one task for each that reads them
    by = [F.col(k) for k in keys]
    heavy = points.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode("_points").alias("_h"))
    heavy = F.broadcast(heavy) if heavy.count() <= SENT else heavy
    at = F.col(value).cast("double")
    met = df.join(heavy, [at == heavy["_h"], *[df[k].eqNullSafe(heavy[f"_k{i}"]) for i, k in enumerate(keys)]], "left")
    met = met.select(*keys, value, F.when(F.col("_h").isNotNull() | F.isnan(at), F.spark_partition_id()).otherwise(F.lit(0)).alias("_s"))
    counts = met.repartition(parts, *by, F.col(value), F.col("_s")).groupBy(*keys, value, "_s").agg(F.count("*").alias("cnt"))
    rows_in = _ranged(counts, keys, value, points).select(*keys, value, "cnt", "_b")
    # ranges of one value are odd; longs that are one double have a row each
    one = F.col("_b") % 2 == 1
    w = W.partitionBy(*keys).orderBy("_b", "_h")
    totals = rows_in.groupBy(*keys, "_b", F.when(one, F.col(value)).alias("_h")).agg(F.sum("cnt").alias("_c")).withColumns({
        "_off": F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_c").over(W.partitionBy(*keys)),
    })
    if wanted is not None:
        inside = F.lit(False)
        for k in wanted:
            inside = inside | ((k >= F.col("_off")) & (k < F.col("_off") + F.col("_c")))
        # the group's first range stays, so that the group does even if it has none of the ranks
        totals = totals.where(inside | (F.col("_off") == 0))
    totals = cut_lineage(totals)
    single = totals.where(one).select(*keys, F.col("_h").alias(value), F.col("_c").alias("cnt"), F.col("_off").alias("lo"), "n")
    offsets = totals.where(~one).select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.col("_b").alias("_tb"), "_off", "n")
    joined = _with_offsets(rows_in.where(~one), offsets, {**{k: f"_t{i}" for i, k in enumerate(keys)}, "_b": "_tb"})
    counts = joined.repartition(parts, *by, F.col("_b"))
    inner = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("lo", F.col("_off") + F.coalesce(F.sum("cnt").over(inner), F.lit(0)))
    return counts.select(*keys, value, "cnt", "lo", "n").unionByName(single)


def _with_offsets(rows: DataFrame, offsets: DataFrame, same: dict[str, str]) -> DataFrame:
    """Rows with the saved values of their range; nulls match, and rows of a range that is not listed are left out before any exchange."""
    small = offsets.count() <= SENT
    return rows.join(F.broadcast(offsets) if small else offsets, [rows[k].eqNullSafe(offsets[t]) for k, t in same.items()]).drop(*same.values())


def at_rank(value: str, k: Column, lo: str = "lo", cnt: str = "cnt") -> Column:
    """Aggregate: the value whose rank range holds 0-based rank ``k``; NULL when k is out of range."""
    return F.max(F.when((F.col(lo) <= k) & (k < F.col(lo) + F.col(cnt)), F.col(value)))


def _index(kind: str, p: float) -> list[Column]:
    """0-based ranks a percentile definition reads."""
    n = F.col("n")
    if kind == "median":
        return [(n - 1 - (n - 1) % 2) / 2, (n - n % 2) / 2]
    if kind == "paired":
        # sorted[⌊n·p⌋] and sorted[⌊n·p − 1⌋], indices truncated toward zero
        at = n.cast("double") * p
        return [at.cast("bigint").cast("double"), (at - 1.0).cast("bigint").cast("double")]
    if kind == "lower":
        return [F.floor((n - 1).cast("double") * p).cast("double")]
    if kind == "linear":
        pos = (n - 1).cast("double") * p
        return [F.floor(pos).cast("double"), F.least(F.floor(pos) + 1, n - 1).cast("double")]
    if kind == "nth":
        return [(n.cast("double") * p).cast("bigint").cast("double")]
    raise ValueError(f"unknown percentile definition {kind}")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles per group, one row per group.

    ``wanted`` maps an output column to (definition, p). Definitions: ``median`` mean of the two middle values; ``paired`` mean of
    sorted[⌊np⌋] and sorted[⌊np−1⌋], a missing element counting 0; ``lower`` sorted[⌊p(n−1)⌋]; ``linear`` interpolated between
    the neighbours of p(n−1); ``nth`` sorted[⌊np⌋]. They differ, so each is named.
    """
    keys = list(keys)
    ranks = value_ranks(df, keys, value, [k for kind, p in wanted.values() for k in _index(kind, p)])
    aggs, outs = [F.max("n").alias("n")], {}
    for name, (kind, p) in wanted.items():
        cols = []
        for i, k in enumerate(_index(kind, p)):
            aggs.append(at_rank(value, k).alias(f"_{name}_{i}"))
            cols.append(F.col(f"_{name}_{i}"))
        if kind == "median":
            outs[name] = (cols[0] + cols[1]) / 2.0
        elif kind == "paired":
            outs[name] = (F.coalesce(cols[0], F.lit(0.0)) + F.coalesce(cols[1], F.lit(0.0))) / 2.0
        elif kind == "linear":
            pos = (F.col("n") - 1).cast("double") * p
            f = pos - F.floor(pos)
            outs[name] = cols[0] * (F.lit(1.0) - f) + cols[1] * f
        else:
            outs[name] = cols[0]
    return ranks.groupBy(*keys).agg(*aggs).withColumns(outs).select(*keys, "n", *wanted)


def ranges(df: DataFrame, keys: Sequence[str], value: str, tie: str | None, rows: int) -> DataFrame | None:
    """Adds ``_b`` and ``_c``, which number the ranges of each group by falling value and, in ranges of one value, rising tie; None when no group has more than ``rows`` rows."""
    return _ranges(df, keys, value, tie, rows)[0]


def _ranges(df: DataFrame, keys: Sequence[str], value: str, tie: str | None, rows: int) -> tuple[DataFrame | None, int]:
    """``ranges``, and the partitions that all rows need."""
    tie = tie if tie and isinstance(df.schema[tie].dataType, NumericType) else None
    points, parts = split_points(df, keys, value, rows, tie)
    if points is None:
        return None, parts
    span = F.col("_tie1") - F.col("_tie0") + 1.0
    cut = F.floor((F.col(tie).cast("double") - F.col("_tie0")) / span * F.col("_cuts")).cast("int") if tie else F.lit(0)
    # ranges of one value are odd; nulls, which stand last, are alike too. Rows without a tie value come first, as in the order
    one, none = F.col("_b") % 2 == 1, F.col(value).isNull()
    out = _ranged(df, keys, value, points).withColumn("_c", F.when(F.col("_points").isNotNull() & (one | none), F.coalesce(cut, F.lit(-1))).otherwise(F.lit(0)))
    return out.withColumn("_b", F.when(none, F.lit(1)).otherwise(-F.col("_b"))).drop("_points", "_tie0", "_tie1", "_cuts"), parts


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    running: dict[str, Column],
    ties: Sequence[str] = ("y", "x"),
    rows: int | None = None,
) -> DataFrame:
    """Rows in descending order of ``value`` (ties by ``ties``) with ``rank`` and running sums.

    ``running`` maps an output column to the expression summed from the first row to the current one. Rows of equal value that fill more than a range are cut
    by the first tie column if that is numeric; rows that share it too stay together.
    """
    keys = list(keys)
    at = df.withColumns({f"_r_{k}": e for k, e in running.items()}).withColumn("_one", F.lit(1).cast("bigint"))
    sums = ["_one", *[f"_r_{k}" for k in running]]
    order = [F.desc(value), *[F.asc(t) for t in ties]]
    split, parts = _ranges(at, keys, value, ties[0] if ties else None, rows or ROWS)
    if split is None:
        at = at.repartition(parts, *[F.col(k) for k in keys]) if keys else at
        inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        cols = {s: F.sum(s).over(inner) for s in sums}
        return at.select(*df.columns, cols["_one"].alias("rank"), *[cols[f"_r_{k}"].alias(k) for k in running])
    w = W.partitionBy(*keys).orderBy("_b", "_c").rowsBetween(W.unboundedPreceding, -1)
    totals = split.groupBy(*keys, "_b", "_c").agg(*[F.sum(s).alias(s) for s in sums])
    same = {k: f"_t{i}" for i, k in enumerate([*keys, "_b", "_c"])}
    totals = cut_lineage(totals.select(*[F.col(k).alias(t) for k, t in same.items()], *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_o{s}") for s in sums]))
    inner = W.partitionBy(*keys, "_b", "_c").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = _with_offsets(split, totals, same).repartition(parts, *[F.col(k) for k in [*keys, "_b", "_c"]])
    cols = {s: F.col(f"_o{s}") + F.sum(s).over(inner) for s in sums}
    return out.select(*df.columns, cols["_one"].alias("rank"), *[cols[f"_r_{k}"].alias(k) for k in running])
