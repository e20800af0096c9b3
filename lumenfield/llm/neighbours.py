"""Embedding near-duplicates by NN-descent.

1. Equal vectors are one node with a multiplicity. Nodes of equal length and finite, non-zero direction take part.
2. Every node starts with neighbours from random hyperplane buckets of ``BUCKET`` nodes on average. The number of tables follows the bits, so that a pair at the threshold
   shares no bucket with probability ``MISS`` at most, whatever the number of nodes; only buckets of more than ``LARGE`` nodes are dealt into parts.
3. Descent: each node's neighbours and reverse neighbours are compared with one another, and every better neighbour found enters the lists of both. Rounds go on until
   hardly any list changes.
4. A list all of whose ``K`` neighbours reach the threshold is saturated: it may hide more. A link that no list holds has saturated lists at both ends, so all members of
   components with a saturated list are compared with one another, within components and across, block by block without a row for each pair. Parts whose centres and radii
   keep them farther apart than the threshold are passed over. So links of dense groups are counted exactly, and groups that hidden links join become one.
5. Links are confirmed in double precision; components come from the confirmed links and the joined groups.
6. Audit: for nodes drawn at random, and for nodes drawn from those with links, the final counts are held against a comparison with all vectors. While less than ``RECALL`` of
   the links is found, or less than that on average over the nodes with links, the search goes on with fresh tables; after ``ATTEMPTS`` it raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.components import components
from lumenfield.llm.tables import Workspace

K, REVERSE, PART = 12, 12, 256
BUCKET, LARGE, MISS, AT_ONCE = 512, 2048, 0.002, 8
BLOCK = 1024  # members of dense components that are read together
ROUNDS, CHANGE, RECALL, ATTEMPTS = 6, 0.02, 0.99, 4
AUDIT, AUDIT_MORE, AUDIT_LINKED = 1024, 8192, 64  # nodes asked at random; so many where fewer than AUDIT_LINKED of them have links
SLACK = 1e-4  # search runs in single precision


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): v is the unit vector in double precision as bytes, null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            out: list[bytes | None] = [None] * b.num_rows
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            starts = column.offsets.to_numpy()
            valid = np.asarray(column.is_valid())
            for i in range(b.num_rows):
                if valid[i] and sizes[i]:
                    x = flat[starts[i] : starts[i] + sizes[i]]
                    if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                        x = x / top
                        out[i] = (x / np.sqrt(x @ x)).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "vec_id long, v binary")


def _floats(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _lists(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sim.astype(np.float32))], names=["u", "v", "sim"])


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a table's buckets, and the number of tables with which a pair at the threshold shares none of its buckets with probability MISS at most."""
    bits = max(0, min(40, int(np.log2(max(n, 1) / BUCKET))))
    alike = max(0.5, 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return bits, 1 if alike >= 1 else max(1, int(np.ceil(np.log(MISS) / np.log1p(-alike))))


def _buckets(nodes: DataFrame, bits: int, first: int, tables: int) -> DataFrame:
    """(rep, d, f, table, bucket): each node once per table; first: number of the first table, which decides the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = _floats(part.column(2))
                for t in range(first, first + tables):
                    planes = np.random.Generator(np.random.PCG64([5, d, t])).standard_normal((d, bits)).astype(np.float32)
                    code = ((x @ planes > 0) * (1 << np.arange(bits))).sum(1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64))], names=["rep", "d", "f", "table", "bucket"])

    return nodes.select("rep", "d", "f").mapInArrow(run, "rep long, d int, f binary, table int, bucket long")


def _top(u: np.ndarray, v: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each u."""
    order = np.lexsort((v, -sim, u))
    first = np.concatenate(([True], u[order][1:] != u[order][:-1])) if len(u) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(u)]))))
    return order[rank < k]


def _within(table: pa.Table) -> pa.Table:
    """Best K neighbours of each member of a bucket part inside that part."""
    rep, x = table["rep"].to_numpy(), _floats(table["f"].combine_chunks())
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(K, len(rep) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((len(rep), 0), np.int64)
    return pa.Table.from_batches([_lists(np.repeat(rep, k), rep[best].reshape(-1), np.take_along_axis(sim, best, 1).reshape(-1))])


def _best(pairs: DataFrame) -> DataFrame:
    """(u, v, sim) of the K best distinct neighbours of each u. Aggregates before the shuffle keep K entries a task and node."""
    # the last aggregation sees at most K entries from each task
    packed = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    top = packed.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False), 1, K).alias("best"))
    return top.select("u", F.explode("best").alias("b")).select("u", "b.v", "b.sim")


def _descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Better neighbours found by comparing the neighbours and reverse neighbours of each node with one another."""
    kth = graph.groupBy("u").agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(-2.0).cast("float").alias("kth")).withColumnRenamed("u", "rep")
    # of many reverse neighbours a node keeps some, drawn by hash; the others meet elsewhere
    back = graph.select(F.col("v").alias("w"), F.col("u").alias("rep"), F.xxhash64("u", "v").alias("h"))
    back = back.groupBy("w").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "rep"))), 1, REVERSE).alias("best")).select("w", F.explode("best.rep").alias("rep"))
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("rep")).union(back).distinct()
    carried = around.join(nodes.select("rep", "d", "f").join(kth, "rep"), "rep")

    def local(table: pa.Table) -> pa.Table:
        rep, kth_, x = table["rep"].to_numpy(), table["kth"].to_numpy(), _floats(table["f"].combine_chunks())
        sim = x @ x.T
        np.fill_diagonal(sim, -3)
        i, j = np.nonzero(sim > kth_[:, None])
        return pa.Table.from_batches([_lists(rep[i], rep[j], sim[i, j])])

    return carried.groupBy("w", "d").applyInArrow(local, "u long, v long, sim float")


def _audit(n_links: DataFrame, nodes: DataFrame, threshold: float) -> tuple[int, int, int, float]:
    """n_links: rep, n. For the nodes asked: true links by multiplicity, how many of them were counted, nodes that have links, and the mean share counted of these nodes."""
    drawn = nodes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep")
    linked = nodes.select("rep", "v").join(n_links, "rep", "left_semi").orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(AUDIT).collect()
    counted = n_links.select("rep", F.col("n").alias("found"))
    for size in (AUDIT, AUDIT_MORE):
        some = drawn.limit(size).collect()
        random = {r.rep for r in some}
        asked = {r.rep: r.v for r in [*linked, *some]}
        ids = np.array(list(asked), np.int64)
        vectors = list(asked.values())
        lengths = np.array([len(v) // 8 for v in vectors])

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: list = vectors, lengths: np.ndarray = lengths) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), np.int64)
            for b in batches:
                v, rep, m = b.column(1), b.column(0).to_numpy(), b.column(2).to_numpy()
                dims = b.column(3).to_numpy()
                for d in np.unique(dims).tolist():
                    mine = np.flatnonzero(lengths == d)
                    if not len(mine):
                        continue
                    q = np.frombuffer(b"".join(vectors[i] for i in mine), np.float64).reshape(-1, d)
                    at = np.flatnonzero(dims == d)
                    x = np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), np.float64).reshape(-1, d)
                    for k in range(0, len(mine), 1024):
                        hit = (q[k : k + 1024] @ x.T >= threshold) & (ids[mine[k : k + 1024], None] != rep[None, at])
                        total[mine[k : k + 1024]] += hit @ m[at]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(total[at])], names=["rep", "n"])

        true = nodes.select("rep", "v", "m", "d").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
        rows = true.join(counted, "rep", "left").select("rep", "n", F.coalesce("found", F.lit(0)).alias("found")).collect()
        if sum(r.rep in random for r in rows) >= AUDIT_LINKED or len(random) < size:
            break
    at_random = [r for r in rows if r.rep in random]
    shares = [np.mean([min(r.found, r.n) / r.n for r in part]) for part in (rows, at_random) if part]
    return sum(r.n for r in rows), sum(min(r.found, r.n) for r in rows), len(rows), float(min(shares, default=1.0))


def _confirm(links: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = np.array([np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])
            keep = pa.array(np.flatnonzero(cos >= threshold) if len(cos) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["u", "v"])

    one, two = (nodes.select(F.col("rep").alias(c), F.col("v").alias(f"v_{c}")) for c in "uv")
    return links.join(one, "u").join(two, "v").select("u", "v", "v_u", "v_v").mapInArrow(run, "u long, v long")


def _blocks(members: DataFrame, size: int) -> DataFrame:
    """members: rep, component, v, m. (d, block, rows): cells are parts of a component with at most about PART members; a block holds whole cells, about BLOCK members."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    dealt = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / PART)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("component", "part"), F.lit(-(-size // BLOCK)))).withColumn("d", F.length("v"))
    return dealt.groupBy("d", "block").agg(F.sort_array(F.collect_list(F.struct("component", "part", "rep", "v", "m"))).alias("rows"))


def _cells(rows: pa.ListScalar) -> tuple[np.ndarray, ...]:
    """Component of each member, its name, vector and multiplicity, first members of the cells, and the cells' centres and radii (greatest angle to a member)."""
    s = rows.values
    component, part, rep, m = (s.field(c).to_numpy() for c in ("component", "part", "rep", "m"))
    x = np.frombuffer(b"".join(s.field("v").to_pylist()), np.float64).reshape(len(s), -1)
    first = np.flatnonzero(np.concatenate(([True], (component[1:] != component[:-1]) | (part[1:] != part[:-1]))))
    centre = np.add.reduceat(x, first)
    norm = np.sqrt((centre * centre).sum(1))
    centre = np.where(norm[:, None] > 1e-6, centre / np.maximum(norm, 1e-6)[:, None], x[first])
    angle = np.arccos(np.clip((x * np.repeat(centre, np.diff(np.append(first, len(x))), axis=0)).sum(1), -1, 1))
    return component, rep, x, m, np.append(first, len(x)), centre, np.maximum.reduceat(angle, first)


def _dense_counts(members: DataFrame, size: int, threshold: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(rep, n): links of each member to all members, of its own component or another, counted by multiplicity; (u, v): components that a link joins.

    Cells of different blocks meet where their centres are within their radii and the threshold's angle of one another: by the triangle inequality no link is passed over.
    """
    blocks = work.save(_blocks(members, size), "blocks")
    tasks = max(2, round((size / BLOCK) ** 0.5))
    one = blocks.select("d", "block", F.col("rows").alias("one")).repartition(tasks)
    two = blocks.select(F.col("d").alias("d2"), F.col("block").alias("block2"), F.col("rows").alias("two")).repartition(tasks)
    pairs = one.hint("shuffle_replicate_nl").join(two, F.expr("d = d2 and block <= block2")).select("one", "two", (F.col("block") == F.col("block2")).alias("same"))
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, others, same in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                ci, ri, xi, mi, fi, centre_i, radius_i = _cells(rows)
                cj, rj, xj, mj, fj, centre_j, radius_j = _cells(others)
                ni, nj = np.zeros(len(ri), np.int64), np.zeros(len(rj), np.int64)
                bridges = set()
                angle = np.arccos(np.clip(centre_i @ centre_j.T, -1, 1))
                for i, j in zip(*np.nonzero(angle <= radius_i[:, None] + radius_j[None] + reach), strict=True):
                    at, to = slice(fi[i], fi[i + 1]), slice(fj[j], fj[j + 1])
                    hit = (xi[at] @ xj[to].T >= threshold) & (ri[at, None] != rj[None, to])
                    ni[at] += hit @ mj[to]
                    if not same:
                        nj[to] += mi[at] @ hit
                    if ci[fi[i]] != cj[fj[j]] and hit.any():
                        bridges.add((ci[fi[i]], cj[fj[j]]))
                for rep, n in ((ri, ni), (rj, nj)):
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some]), pa.nulls(len(some), pa.int64())], names=["rep", "n", "other"])
                joined = np.array(sorted(bridges), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(joined[:, 0]), pa.array(np.zeros(len(joined), np.int64)), pa.array(joined[:, 1])], names=["rep", "n", "other"])

    found = work.save(pairs.mapInArrow(run, "rep long, n long, other long"), "dense")
    counts = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    return counts, found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))


def _search(graph: DataFrame | None, nodes: DataFrame, n: int, bits: int, tables: int, attempt: int, figures: dict, work: Workspace) -> DataFrame:
    """The lists (u, v, sim) after fresh bucket tables and descent, starting from those of the attempt before."""
    for first in range((attempt - 1) * tables, attempt * tables, AT_ONCE):
        codes = _buckets(nodes, bits, first, min(AT_ONCE, attempt * tables - first))
        large = codes.groupBy("table", "d", "bucket").agg(F.ceil(F.count("*") / LARGE).alias("parts")).where("parts > 1")
        dealt = codes.join(large, ["table", "d", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("rep", "table"), F.coalesce("parts", F.lit(1))))
        near = dealt.groupBy("table", "d", "bucket", "part").applyInArrow(_within, "u long, v long, sim float")
        graph = work.save(_best(near if graph is None else graph.union(near)), f"graph{attempt}_{first}")
    figures["tables"] += tables
    for step in range(1, ROUNDS + 1):
        after = work.save(_best(graph.union(_descend(graph, nodes))), f"graph{attempt}_round{step}")
        changed = after.join(graph, ["u", "v"], "left_anti").count()
        graph = after
        figures |= {"rounds": figures["rounds"] + 1, "changed": changed}
        if changed <= CHANGE * n * K:
            break
    return graph


def _links(graph: DataFrame, nodes: DataFrame, threshold: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(rep, n): links of each node that has any, by multiplicity; (id, component)."""
    close = graph.where(F.col("sim") >= threshold - SLACK)
    pairs = close.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = work.save(_confirm(pairs, nodes, threshold), "links")
    parts = work.save(components(links), "components")
    saturated = close.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= K).select(F.col("u").alias("id"))
    dense = parts.join(saturated, "id", "left_semi").select("component").distinct()
    inside = parts.join(dense, "component", "left_semi")
    members = work.save(nodes.select("rep", "v", "m").join(inside.select(F.col("id").alias("rep"), "component"), "rep"), "members")
    counted, bridges = _dense_counts(members, members.count(), threshold, work)
    joined = components(bridges).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    parts = parts.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    both = links.select("u", "v").union(links.select("v", "u"))
    sparse = both.join(nodes.select(F.col("rep").alias("v"), "m"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("m").alias("n"))
    return sparse.join(counted.select("rep", F.col("n").alias("all")), "rep", "left").select("rep", F.coalesce("all", "n").alias("n")), parts


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """One row per row of ``vectors``: vec_id, n_links (other vectors with cosine >= threshold), component_id (smallest id reachable), kept (is that id); and figures of the run.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, link with nothing; a null id has a null component and is kept.
    Only vectors of equal length are compared. Repeated rows are equal vectors: they link with one another and with everything their vector links with.
    An empty table gives an empty result; other columns are not looked at. Raises where the audit finds too few links after ``ATTEMPTS`` searches.
    """
    work = Workspace(vectors.sparkSession)
    rows = work.save(_nodes(vectors, id_col, vector_col), "rows")
    narrow = rows.where("v is not null and vec_id is not null")
    nodes = narrow.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("d", (F.length("v") / 8).cast("int"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("f", pa.array([np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in b.column(0).to_pylist()], pa.binary()))

    nodes = work.save(nodes.mapInArrow(single, "v binary, rep long, m long, d int, f binary"), "nodes")
    n = nodes.count()
    bits, tables = plan(n, threshold)
    graph, figures = None, {"nodes": n, "tables": 0, "rounds": 0}
    for attempt in range(1, ATTEMPTS + 1):
        graph = _search(graph, nodes, n, bits, tables, attempt, figures, work)
        n_links, parts = _links(graph, nodes, threshold, work)
        n_links = work.save(n_links, f"counts{attempt}")
        true, have, linked, share = _audit(n_links, nodes, threshold)
        figures |= {"attempts": attempt, "audit_links": true, "audit_found": have, "audit_nodes": linked, "audit_share": share}
        if have >= RECALL * true and share >= RECALL:
            break
    else:
        raise RuntimeError(f"near-duplicate vectors: recall below {RECALL} after {ATTEMPTS} searches: {figures}")
    named = nodes.select("v", "rep", "m").join(n_links, "rep", "left").join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = narrow.join(named, "v").select("vec_id", "n_links", "component_id")
    rest = rows.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out, figures
