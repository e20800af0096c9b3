"""Hard negatives from Parquet blocks in the order of a Hilbert curve, with a zone map for each block.

All vectors are sorted along a Hilbert curve through their space and cut into blocks of ``BLOCK``; a block's row holds its vectors and, in columns of their own,
the least and greatest value of every dimension and the labels in it. Anchors are chunked in the same order. By interval arithmetic a zone map bounds the
scores of a block from both sides. Each search reads twice: first the one block whose middle promises most, whose k-th score becomes the least that matters;
then all blocks whose bounds meet a window [least, greatest] of an anchor. Positives have one window without limits, negatives one for each positive.

Zone maps meet chunks, and chunks meet the blocks chosen for them, by equi-joins; only bounds, never vectors, are compared for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.llm.tables import Workspace

BLOCK, CHUNK, ZONES = 4096, 256, 1024
#: Bits of each dimension in the place on the curve.
BITS = 4
FAR = 1 << 62


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n, d; whole numbers below 2^bits), as rows of bytes that sort in its order."""
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    # undo the rotations and reflections of the sub-cubes, from the largest to the smallest
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(d):
            upper = (x[i] >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(upper, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    # from the Gray code of the sub-cubes to their order
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def bounds(q: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each row of ``q`` can have with a vector of each box; (queries, boxes)."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ least.T + down @ greatest.T, up @ greatest.T + down @ least.T


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """As doubles where all products stay below 2^53 and are therefore exact, else as 64-bit integers."""
    d = arrays[0].shape[-1]
    sizes = [float(np.abs(a).max(initial=0)) for a in arrays]
    kind = np.float64 if sizes[0] * max(sizes[1:]) * d < 2**53 else np.int64
    return [a.astype(kind) for a in arrays]


def _ints(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_py(), np.int64)


def _ordered(rows: DataFrame, least: int, greatest: int) -> DataFrame:
    """Adds ``key``, the place on the curve through the cube [least, greatest]^d."""
    span = max(1, greatest - least + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, d = b.column(b.schema.get_field_index("v")), np.asarray(b.column(b.schema.get_field_index("d")))
            values, at = np.asarray(v.flatten(), np.int64), np.concatenate([[0], np.cumsum(d)])
            keys = [b""] * b.num_rows
            for size in np.unique(d):
                mine = np.flatnonzero(d == size)
                cells = (values[at[mine][:, None] + np.arange(size)] - least) * (1 << BITS) // span
                for i, key in zip(mine.tolist(), hilbert_key(cells, BITS), strict=True):
                    keys[i] = key.tobytes()
            yield b.append_column("key", pa.array(keys, pa.binary()))

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, key binary")


def _packed(rows: DataFrame, size: int, parts: int, id_col: str) -> DataFrame:
    """Rows of ``size`` neighbours on the curve: (block, d, ids, labels, v, low, high, kinds); low and high are the zone map, kinds the labels."""

    def cell(ids: list[np.ndarray], labels: list[np.ndarray], values: list[np.ndarray], d: int, number: int) -> pa.RecordBatch:
        i, kind, v = np.concatenate(ids), np.concatenate(labels), np.concatenate(values).reshape(-1, d)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (i, kind, v)]
        zone = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (v.min(axis=0), v.max(axis=0), np.unique(kind))]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([d], pa.int32()), *blobs, *zone], names=["block", "d", "ids", "labels", "v", "low", "high", "kinds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, of = TaskContext.get().partitionId() << 32, 0, None
        ids, labels, values = [], [], []
        for b in batches:
            d = np.asarray(b.column(0))
            i, kind = np.asarray(b.column(1), np.int64), np.asarray(b.column(2), np.int64)
            v, at = np.asarray(b.column(3).flatten(), np.int64), np.concatenate([[0], np.cumsum(d)])
            start = 0
            while start < len(d):
                if held and (held == size or d[start] != of):
                    yield cell(ids, labels, values, of, number)
                    number, held, ids, labels, values = number + 1, 0, [], [], []
                of = int(d[start])
                other = np.flatnonzero(d[start:] != of)
                end = min(start + size - held, start + (int(other[0]) if len(other) else len(d)), len(d))
                ids.append(i[start:end]), labels.append(kind[start:end]), values.append(v[at[start] : at[end]])
                held, start = held + end - start, end
        if held:
            yield cell(ids, labels, values, of, number)

    ordered = rows.repartitionByRange(parts, "d", "key", id_col).sortWithinPartitions("d", "key", id_col)
    out = "block long, d int, ids binary, labels binary, v binary, low array<long>, high array<long>, kinds array<long>"
    return ordered.select("d", id_col, "label", "v").mapInArrow(run, out)


def best_of_block(s: np.ndarray, ids: np.ndarray, allowed: np.ndarray, least: np.ndarray, greatest: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(query, window, places) of the k first candidates of each window, by falling score, then rising id."""
    for a in range(len(s)):
        place = np.flatnonzero(allowed[a] & (s[a] >= least[a].min()) & (s[a] <= greatest[a].max()))
        place = place[np.lexsort((ids[place], -s[a][place]))]
        falling = -s[a][place]
        for w in range(least.shape[1]):
            start = int(np.searchsorted(falling, -greatest[a, w], "left"))
            end = min(start + k, int(np.searchsorted(falling, -least[a, w], "right")))
            if end > start:
                yield a, w, place[start:end]


class Miner:
    """Blocks, zone maps and anchors of one table, and the search over them."""

    def __init__(self, vectors: DataFrame, every: int, scale: int, id_col: str, vector_col: str, label_col: str):
        self.work = Workspace(vectors.sparkSession)
        x, parts = F.col(vector_col), vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector_col) > 0))
        parts = parts.where(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))))
        whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
        rows = parts.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"), F.size(x).alias("d"))
        n, n_anchors, low, high = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
        keyed = _ordered(rows, low or 0, high or 0)
        self.blocks = self.work.save(_packed(keyed, BLOCK, max(1, -(-n // (4 * BLOCK))), "vec_id"), "blocks")
        # a repeated anchor asks once, with its least label and vector
        anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "d").agg(F.min(F.struct("label", "v")).alias("one")).groupBy("vec_id").agg(F.min(F.struct("d", "one")).alias("one"))
        anchors = _ordered(anchors.select("vec_id", "one.one.label", "one.one.v", "one.d"), low or 0, high or 0)
        chunks = _packed(anchors, CHUNK, max(1, -(-n_anchors // (4 * CHUNK))), "vec_id")
        self.chunks = self.work.save(chunks.select(F.col("block").alias("chunk"), "d", "ids", "labels", "v"), "chunks")
        self.n_groups = max(1, -(-n // (BLOCK * ZONES)))
        zones = self.blocks.select("block", "d", "low", "high", "kinds").groupBy("d", F.pmod(F.xxhash64("block"), F.lit(self.n_groups)).alias("zone"))
        self.zones = self.work.save(zones.agg(F.collect_list(F.struct("block", "low", "high", "kinds")).alias("boxes")), "zones")

    def windows(self, found: DataFrame | None, k: int, share: tuple[int, int]) -> DataFrame:
        """(chunk, d, ids, labels, v, least, greatest): without ``found`` one window without limits; else one for each row of found, from ``share`` of its score up to its score."""
        if found is None:
            return self.chunks.withColumns({"least": F.lit(None).cast("binary"), "greatest": F.lit(None).cast("binary"), "wide": F.lit(1)})
        rows = found.groupBy("chunk").agg(F.collect_list(F.struct("a", F.col("rank").alias("w"), "score")).alias("cells"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    n = len(_ints(b.column(1)[i]))
                    least, greatest = np.full((n, k), FAR), np.full((n, k), -FAR)
                    for c in b.column(2)[i].as_py():
                        greatest[c["a"], c["w"] - 1] = c["score"]
                        least[c["a"], c["w"] - 1] = -(-share[0] * c["score"] // share[1])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *[pa.array([x.tobytes()], pa.binary()) for x in (least, greatest)]], names=["chunk", "least", "greatest"])

        limits = self.chunks.select("chunk", "ids").join(rows, "chunk").mapInArrow(run, "chunk long, least binary, greatest binary")
        return self.chunks.join(limits, "chunk").withColumn("wide", F.lit(k))

    def raised(self, asked: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
        """The windows with each least score raised to the k-th score already found in it."""
        rows = seeds.where(F.col("rank") == k).groupBy("chunk").agg(F.collect_list(F.struct("a", "w", "score")).alias("cells"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    n, wide = len(_ints(b.column(1)[i])), b.column(4)[i].as_py()
                    least, greatest = _limits(b.column(2)[i], b.column(3)[i], n, wide)
                    least = least.copy()
                    for c in b.column(5)[i].as_py() or []:
                        least[c["a"], c["w"]] = max(least[c["a"], c["w"]], c["score"])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *[pa.array([x.tobytes()], pa.binary()) for x in (least, greatest)]], names=["chunk", "least", "greatest"])

        limits = asked.select("chunk", "ids", "least", "greatest", "wide").join(rows, "chunk", "left").mapInArrow(run, "chunk long, least binary, greatest binary")
        return asked.drop("least", "greatest").join(limits, "chunk")

    def chosen(self, asked: DataFrame, *, same: bool, first: bool) -> DataFrame:
        """(block, chunk, who): the anchors of each chunk whose windows need a block; first: for each anchor only the block whose middle scores highest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    n, d = len(_ints(b.column(1)[i])), b.column(6)[i].as_py()
                    boxes = b.column(7)[i].as_py()
                    q, low, high = _exact(_ints(b.column(3)[i]).reshape(n, d), np.array([x["low"] for x in boxes]), np.array([x["high"] for x in boxes]))
                    least, greatest = _limits(b.column(4)[i], b.column(5)[i], n, b.column(8)[i].as_py())
                    under, over = bounds(q, low, high)
                    labels = _ints(b.column(2)[i])
                    kinds = [set(x["kinds"]) for x in boxes]
                    of = {int(c): np.array([(c in s) if same else bool(s - {c}) for s in kinds], bool) for c in np.unique(labels)}
                    fits = np.array([of[int(c)] for c in labels])
                    meets = np.zeros_like(fits)
                    for w in range(least.shape[1]):
                        meets |= (over >= least[:, w : w + 1]) & (under <= greatest[:, w : w + 1]) & (least[:, w : w + 1] <= greatest[:, w : w + 1])
                    fits &= meets
                    who, box = np.nonzero(fits)
                    middle = (under + over)[who, box].astype(np.float64)
                    number = np.array([x["block"] for x in boxes])[box]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, np.full(len(who), b.column(0)[i].as_py()), who.astype(np.int32), middle)], names=["block", "chunk", "a", "middle"])

        spread = asked.withColumn("zone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_groups - 1).cast("long"))))
        met = spread.join(self.zones, ["d", "zone"]).select("chunk", "ids", "labels", "v", "least", "greatest", "d", "boxes", "wide")
        pairs = met.mapInArrow(run, "block long, chunk long, a int, middle double")
        if first:
            w = Window.partitionBy("chunk", "a").orderBy(F.desc("middle"), "block")
            pairs = pairs.withColumn("rank", F.row_number().over(w)).where("rank = 1")
        return pairs.groupBy("block", "chunk").agg(F.collect_list("a").alias("who"))

    def read(self, asked: DataFrame, pairs: DataFrame, k: int, *, same: bool) -> DataFrame:
        """(chunk, a, w, rank, anchor_id, vec_id, score): the first k of every window from the chosen blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    who = np.sort(np.array(b.column(1)[i].as_py()))
                    own = _ints(b.column(2)[i])
                    least, greatest = _limits(b.column(5)[i], b.column(6)[i], len(own), b.column(10)[i].as_py())
                    ids, labels = _ints(b.column(7)[i]), _ints(b.column(8)[i])
                    q, v = _exact(_ints(b.column(4)[i]).reshape(len(own), -1)[who], _ints(b.column(9)[i]).reshape(len(ids), -1))
                    kind = labels[None] == _ints(b.column(3)[i])[who][:, None]
                    allowed = (ids[None] != own[who][:, None]) & (kind if same else ~kind)
                    s = (q @ v.T).astype(np.int64)
                    rows = [(int(who[a]), w, int(own[who[a]]), ids[p], s[a, p]) for a, w, p in best_of_block(s, ids, allowed, least[who], greatest[who], k)]
                    if rows:
                        sizes = [len(r[3]) for r in rows]
                        columns = [np.repeat(np.array([r[c] for r in rows]), sizes) for c in (0, 1, 2)]
                        cells = [pa.array(np.full(sum(sizes), b.column(0)[i].as_py())), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2])]
                        cells += [pa.array(np.concatenate([r[c] for r in rows])) for c in (3, 4)]
                        yield pa.RecordBatch.from_arrays(cells, names=["chunk", "a", "w", "anchor_id", "vec_id", "score"])

        sent = pairs.join(asked.withColumnsRenamed({"ids": "own", "labels": "own_labels", "v": "q"}).drop("d"), "chunk")
        met = self.blocks.select("block", "ids", "labels", "v").join(sent, "block")
        rows = met.select("chunk", "who", "own", "own_labels", "q", "least", "greatest", "ids", "labels", "v", "wide").mapInArrow(run, "chunk long, a int, w int, anchor_id long, vec_id long, score long")
        # the rank's limit is applied before the shuffle as well
        w = Window.partitionBy("chunk", "a", "w").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def search(self, asked: DataFrame, k: int, name: str, *, same: bool) -> DataFrame:
        asked = self.work.save(asked, f"{name}-asked")
        seeds = self.read(asked, self.chosen(asked, same=same, first=True), k, same=same)
        asked = self.work.save(self.raised(asked, self.work.save(seeds, f"{name}-seeds"), k), f"{name}-raised")
        pairs = self.work.save(self.chosen(asked, same=same, first=False), f"{name}-pairs")
        return self.work.save(self.read(asked, pairs, k, same=same), f"{name}-found")


def _limits(least: pa.Scalar, greatest: pa.Scalar, n: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    if least.as_py() is None:
        return np.full((n, wide), -FAR), np.full((n, wide), FAR)
    return _ints(least).reshape(n, wide), _ints(greatest).reshape(n, wide)


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), every: int = 100, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    Anchors: rows whose id is divisible by ``every``. Score: inner product of floor(scale * component). An anchor's positives are its ``positives`` first other
    rows of its label, the highest score first, ties by smaller id (all, if fewer); for each of them the first ``negatives`` rows of other labels whose score lies
    between ``share`` of the positive's score and the score itself. A negative positive score has an empty window.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Vectors of another length than the anchor's are no
    candidates of it. A repeated row is a candidate as often as it stands there, but rows with the anchor's own id are not; a repeated anchor asks once, with the
    shortest of its vectors and the least label and components. Scores must fit 62 bits. An empty table gives an empty result; other columns are not looked at.
    """
    m = Miner(vectors, every, scale, id_col, vector_col, label_col)
    found = m.search(m.windows(None, 1, share), positives, "positives", same=True)
    hard = m.search(m.windows(found, positives, share), negatives, "negatives", same=False)
    near = found.select("chunk", "a", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(near, ["chunk", "a", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The registered query's rows: where vec_id is divisible by 7, label becomes (label + 1) % 10."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


def oracle() -> str:
    return """
    WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    negatives AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT * FROM negatives WHERE rank <= 5"""
