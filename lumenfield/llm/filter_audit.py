"""Interaction of filters: what each removes in every order of application, by wide packed counters.

A document matters only by its mask: which filters it fails, whether it is good, whether it is toxic. Equal masks are counted first. Each mask is then mapped
to one big integer whose fields hold the outcome of every step of every order (600 steps of five filters, six fields a step); a part's integers, times their
counts, are summed and unpacked. A field is as wide as the part's number of documents needs, so none can overflow into the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_GAP = r"[\x20\x09-\x0D]+"


@lru_cache(maxsize=1024)
def outcomes(mask: int, filters: int) -> np.ndarray:
    """0/1 by order, step and field. Bits of the mask: one for each filter failed, then good, then toxic."""
    fails = np.array([mask >> i & 1 for i in range(filters)], bool)
    f = fails[np.array(list(permutations(range(filters))), int).reshape(-1, filters)]
    gone = np.logical_or.accumulate(f, axis=1)
    earlier = np.concatenate([np.zeros((len(f), 1), bool), gone[:, :-1]], axis=1)
    removed = f & ~earlier
    good, toxic = bool(mask >> filters & 1), bool(mask >> filters + 1 & 1)
    return np.stack([~gone, removed, f & earlier, f & (fails.sum() == 1), removed & good, removed & toxic], axis=2)


def packed(mask: int, filters: int, width: int) -> int:
    """The outcomes of a mask as one integer with fields of ``width`` bytes."""
    cells = np.zeros((outcomes(mask, filters).size, width), np.uint8)
    cells[:, 0] = outcomes(mask, filters).ravel()
    return int.from_bytes(cells.tobytes(), "little")


def totals(masks: Sequence[int], counts: Sequence[int], filters: int) -> np.ndarray:
    """Sums of the outcomes of all documents, by order, step and field."""
    width = max(1, -(-sum(counts).bit_length() // 8))
    shape = outcomes(0, filters).shape
    total = sum((n * packed(m, filters, width) for m, n in zip(masks, counts, strict=True)), 0)
    cells = np.frombuffer(total.to_bytes(int(np.prod(shape)) * width, "little"), np.uint8).reshape(-1, width)
    wide = np.zeros((len(cells), 8), np.uint8)
    wide[:, :width] = cells
    return wide.view("<i8").reshape(shape)


def audit(masks: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from (part, mask, n).

    names: one letter a filter, in the order of the mask's bits. shapley: what the step's filter removes, summed over all orders. The rows of one
    part are as many as there are masks: 128 for five filters. No masks: no rows. Meant for up to six filters (4 320 steps).
    """
    n_filters = len(names)
    orders = ["".join(o) for o in permutations(names)]
    letter = np.array([list(o) for o in orders])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = totals(table["mask"].to_pylist(), table["n"].to_pylist(), n_filters)
        removed = t[:, :, FIELDS.index("removed")]
        shapley = np.zeros(letter.shape, np.int64)
        for name in names:
            shapley[letter == name] = removed[letter == name].sum()
        n = letter.size
        columns = {
            "part": pa.array([key[0].as_py()] * n, pa.string()),
            "filter_order": pa.array([o for o in orders for _ in range(n_filters)]),
            "step": pa.array(np.tile(np.arange(1, n_filters + 1, dtype=np.int32), len(orders))),
            **{f: pa.array(t[:, :, i].ravel().astype(np.int64)) for i, f in enumerate(FIELDS)},
            "shapley": pa.array(shapley.ravel()),
        }
        return pa.table(columns)

    counts = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"))
    return counts.groupBy("part").applyInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{f} long' for f in FIELDS)}, shapley long")


def repeats(rows: DataFrame, keys: Sequence[str], id_col: str, digest: str, dealt: Sequence[str] = ()) -> DataFrame:
    """(keys, repeated, n): numbers of rows whose digest also stands on a row of a smaller id, and of the others, by ``keys``.

    Rows are combined by (digest, keys) before they are shuffled, so copies of one text, however many, are a row a task. Rows without an id are never
    repeated and repeat nothing; rows that share the smallest id are none of them repeated. dealt: columns that follow from id and digest and that the
    rows are already partitioned by.
    """
    keys = list(keys)
    # one row for each id, digest and keys: then the least id's rows can be told from the rest by one aggregate
    by_id = rows.groupBy(id_col, digest, *keys, *dealt).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(digest, *keys, F.col(id_col).isNull().alias("no_id")).agg(F.min(id_col).alias("least"), F.sum("n").alias("n"), F.min_by("n", id_col).alias("n_least"))
    w = Window.partitionBy(digest)
    first = F.when(F.col("no_id"), F.col("n")).when(F.col("least") == F.min("least").over(w), F.col("n_least")).otherwise(F.lit(0))
    split = groups.withColumn("first", first)
    sides = F.array(F.struct(F.lit(False).alias("repeated"), F.col("first").alias("n")), F.struct(F.lit(True).alias("repeated"), (F.col("n") - F.col("first")).alias("n")))
    return split.select(*keys, F.inline(sides)).groupBy(*keys, "repeated").agg(F.sum("n").alias("n"))


# ---- the registered query: five filters over documents


def conditions(text: Column, words: Column, distinct: Column) -> list[Column]:
    """Failure of A: under 200 words; B: under half of them distinct; C: over 3 % upper-case letters; D: any of ``#$%&*|``."""
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    return [words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n) of the five filters A to E over whole texts; part: lang, null as empty.

    Words: maximal runs of anything but space and 0x09-0x0D, case-sensitive. E: the text stands under a smaller doc_id too, anywhere in the table. Null texts
    are empty: they fail A, and E where an earlier text is empty. Rows without doc_id never fail E, repeat nothing and have no labels. A document is good (toxic)
    if any row of its doc_id in ``labels`` has quality (toxic) 1. Repeated rows of one doc_id count each. An empty table gives no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", _GAP), lambda w: w != ""))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), "text", F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("distinct"))
    fails = conditions(F.col("text"), F.col("words"), F.col("distinct"))
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    # rows without an id are dealt by their text, not all to one task
    rows = rows.select("doc_id", "part", F.unhex("digest").alias("digest"), bits.alias("bits")).withColumn("at", F.coalesce("doc_id", F.xxhash64("digest")))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("at")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    joined = rows.join(known, "at", "left")
    has = lambda c: F.coalesce(F.col(c) & F.col("doc_id").isNotNull(), F.lit(False)).cast("int")
    joined = joined.select("at", "doc_id", "part", "digest", (F.col("bits") + has("good") * 32 + has("toxic") * 64).alias("bits"))
    counted = repeats(joined, ["part", "bits"], "doc_id", "digest", ["at"])
    return counted.select("part", (F.col("bits") + F.col("repeated").cast("int") * 16).alias("mask"), "n").where("n > 0")


def oracle() -> str:
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {0})"
    tables = ", ".join(letters.format(x) + f" {x}" for x in "pqrst")
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT *, [x FOR x IN string_split_regex(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
    fails AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM cut),
    known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    masks AS (SELECT part, a, b, c, d, e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL),
    sets AS (SELECT part, good, toxic, n, [x FOR x IN [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END] IF x IS NOT NULL] AS failed FROM masks),
    orders AS (SELECT p || q || r || s || t AS filter_order FROM {tables} WHERE len(list_distinct([p, q, r, s, t])) = 5),
    steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, string_split(substr(filter_order, 1, step - 1), '') AS before FROM orders, range(1, 6) g(step)),
    seen AS (SELECT part, filter_order, step, letter, n, good, toxic, failed, list_contains(failed, letter) AS fails_here, list_has_any(failed, before) AS gone FROM sets, steps),
    counted AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fails_here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails_here AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fails_here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_here AND len(failed) = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (fails_here AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails_here AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
        FROM seen GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM counted"""
