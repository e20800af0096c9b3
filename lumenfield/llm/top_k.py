"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

The candidates lie in blocks of about ``BLOCK`` vectors. A block has one list per dimension, its candidates by falling component, written once. For a query the
lists are read from the top (from the bottom where its component is negative), a run of positions in all lists at a time. What has been read of a candidate
and the last value read in each list bound its score from both sides. Reading ends when no candidate outside the best k can still reach the k-th lower bound;
only those whose upper bound reaches it are then resolved to final scores. The k best of each block meet per query: k rows for each block, whatever its size.

Queries come in chunks of ``CHUNK``; a task holds one block and one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.tables import Workspace

BLOCK, CHUNK = 4096, 128
#: Shares of the lists read before the bounds are looked at again.
DEPTHS = (1 / 8, 1 / 4, 1 / 2)
#: Reading also ends when no more than this share of the candidates is open: resolving them costs less than reading on.
FEW = 1 / 20


def search_block(values: np.ndarray, order: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k best candidates of one block for each query. values: (n, d) whole numbers; order: (d, n), places by falling component.

    All queries of a chunk read their lists to the same depth. What a query has seen of a list depends only on the end it reads from, so the bounds of all
    queries are products of the seen components, and of the marks of unseen ones, with the queries' positive and negative parts.
    """
    n, d = values.shape
    # whole numbers below 2^53 are exact in double precision, which is faster
    largest = float(np.abs(values).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d
    kind = np.float64 if largest < 2**53 else np.int64
    v, q = values.astype(kind), queries.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    dims = np.arange(d)
    top, bottom = v[order[:, 0], dims], v[order[:, -1], dims]
    alive = ids[None] != own[:, None]
    reading = np.arange(len(q))
    for depth in (max(1, int(n * share)) for share in DEPTHS):
        if n <= k or not len(reading):
            break
        high, low = np.zeros((n, d), bool), np.zeros((n, d), bool)
        high[order[:, :depth], dims[:, None]] = True
        low[order[:, n - depth :], dims[:, None]] = True
        last_high, last_low = v[order[:, depth - 1], dims], v[order[:, n - depth], dims]
        u, w = up[reading], down[reading]
        # an unseen component lies between the last one read and the other end of its list
        upper = u @ np.where(high, v, last_high).T + w @ np.where(low, v, last_low).T
        lower = u @ np.where(high, v, bottom).T + w @ np.where(low, v, top).T
        open_ = alive[reading]
        lower[~open_] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        open_ &= upper >= kth[:, None]
        alive[reading] = open_
        left = open_.sum(1)
        reading = reading[(left > k) & (left > n * FEW)]
    # lists with many open candidates are read to the end together
    whole = dict(zip(reading.tolist(), q[reading] @ v.T, strict=True))
    out = []
    for i in range(len(q)):
        keep = np.flatnonzero(alive[i])
        scores = whole[i][keep] if i in whole else v[keep] @ q[i]
        if len(keep) > k:
            good = scores >= np.partition(scores, len(keep) - k)[len(keep) - k]
            keep, scores = keep[good], scores[good]
        best = np.lexsort((ids[keep], -scores))[:k]
        out.append((ids[keep[best]], scores[best].astype(np.int64)))
    return out


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * component); rows that are null or hold null or non-finite components, or have no id, are left out."""
    x = F.col(vector_col)
    ok = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row whose id is divisible by ``every`` the k greatest inner products with all other rows.

    Ties go to the smaller vec_id. Fewer than k other rows: all of them. Vectors of another length than the query's are no candidates of it. A repeated
    row is a candidate as often as it stands there, but rows with the query's own id are not; a repeated query is answered once. Vectors that are null, empty or hold null or
    non-finite components take no part. An empty table gives an empty result; other columns are not looked at.
    """
    work = Workspace(vectors.sparkSession)
    rows = work.save(whole_vectors(vectors, id_col, vector_col, scale).withColumn("d", F.size("v")).where("d > 0"), "whole")
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    n_blocks, n_chunks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // CHUNK))
    spread = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")

    def matrix(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([x["vec_id"] for x in rows], np.int64), np.array([x["v"] for x in rows], np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, values = matrix(row["rows"])
                order = np.ascontiguousarray(np.argsort(-values, axis=0, kind="stable").T.astype(np.int32))
                cells = [pa.array([x.tobytes()], pa.binary()) for x in (ids, values, order)]
                yield pa.RecordBatch.from_arrays([pa.array([row["d"]], pa.int32()), pa.array([row["block"]], pa.int32()), *cells], names=["d", "block", "ids", "v", "lists"])

    blocks = rows.groupBy("d", spread(n_blocks).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    blocks = work.save(blocks.mapInArrow(pack, "d int, block int, ids binary, v binary, lists binary"), "lists")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    chunks = asked.groupBy("d", spread(n_chunks).alias("chunk")).agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
    # the queries, a hundredth of the rows, go to the blocks; a block itself moves once
    chunks = chunks.select("d", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column(0)[r].as_py(), np.int64)
                values = np.frombuffer(b.column(1)[r].as_py(), np.int64).reshape(len(ids), -1)
                order = np.frombuffer(b.column(2)[r].as_py(), np.int32).reshape(-1, len(ids))
                own, queries = matrix(b.column(3)[r].as_py())
                got = search_block(values, order, ids, queries, own, k)
                columns = np.repeat(own, [len(x) for x, _ in got]), np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])

    tasks = 4 * n_blocks
    met = blocks.repartition(tasks, "d", "block").join(chunks.repartition(tasks, "d", "block"), ["d", "block"])
    found = met.select("ids", "v", "lists", "asked").mapInArrow(run, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
