"""Near-duplicate texts: many universal hash minima with banding, signature check, exact check, connected components.

1. Every text becomes the set of its word shingles (hashed to 64 bits). Equal sets form one class; only classes go on.
2. A class has ``HASHES`` minima of universal hash functions, cut into bands. A class that shares no band with another one is finished.
3. Inside a bucket of equal band every class is paired with one pivot drawn for that bucket, not with all others. The pivot with which a class shares
   most bands is held against it on the full sets; confirmed links give components.
4. What the pivots did not join is not given up: in every bucket that still holds several components, the members outside its largest
   component are compared by signature, then on the full sets, with all members of other components, in blocks of ``BLOCK`` x ``BLOCK`` spread over
   tasks. So each pair of classes that shares a band is joined or was compared.

Probabilities at a similarity of exactly 0.75: a pair shares no band with 5e-6, fails the signature cut with 6e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm import words
from lumenfield.llm.components import components
from lumenfield.llm.tables import TEXT_BYTES, Workspace, giving_back

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
SIGNATURE_CUT = 0.58
BLOCK = 256
_rng = np.random.Generator(np.random.PCG64(11))
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all hash functions, one row per (non-empty) set."""
    out = np.empty((len(sets), HASHES), np.uint64)
    lengths = np.array([len(s) for s in sets], np.int64)
    for a, b in words.slices(np.concatenate(([0], np.cumsum(lengths))), 1 << 14):
        x = np.concatenate(sets[a:b])
        starts = np.concatenate(([0], np.cumsum(lengths[a:b])[:-1]))
        h = np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, _A[i], out=h)
            np.add(h, _B[i], out=h)
            out[a:b, i] = np.minimum.reduceat(h, starts)
    return out


def _set_key(s: np.ndarray) -> bytes:
    """128-bit key of a set; sets are equal where keys are."""
    n = np.uint64(len(s))
    one = words.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + n
    two = words.mix(s * np.uint64(0xE7037ED1A0B428DB) + n).sum(dtype=np.uint64)
    return np.array([one, two], np.uint64).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n_shingles, set_key, sig (low byte of every minimum), bands; null key, sig and bands for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.text_bytes(batch.column(1))
            for a, b in words.slices(offsets):
                sets = words.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                full = np.array([len(s) > 0 for s in sets])
                sig: list[bytes | None] = [None] * len(sets)
                lens = np.where(full, BANDS, 0)
                flat = np.zeros(0, np.int64)
                if full.any():
                    m = minima([s for s in sets if len(s)])
                    low = (m & np.uint64(255)).astype(np.uint8)
                    for i, row in zip(np.flatnonzero(full).tolist(), low, strict=True):
                        sig[i] = row.tobytes()
                    band = words.mix(m[:, ::ROWS] + _BAND)
                    for r in range(1, ROWS):
                        band = words.mix(band + m[:, r::ROWS])
                    flat = band.reshape(-1).view(np.int64)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32), mask=np.concatenate((~full, [False]))), pa.array(flat)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(sig, pa.binary()),
                        bands,
                    ],
                    names=["id", "n_shingles", "set_key", "sig", "bands"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(giving_back(run), "id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity from the share of equal low bytes, freed from chance agreement."""
    return ((x == y).mean(axis=-1) * 256 - 1) / 255


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    both = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are similar on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(i).to_pylist()] for i in (2, 3))
            at = pa.array([i for i in range(b.num_rows) if _similar(x[i], y[i], percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["u", "v"])

    one, two = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "set_u", "set_v").mapInArrow(giving_back(run), "u long, v long")


def _set_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(rep, set_key, shingles): full sets of the wanted classes, from one row of each.

    The join brings the rows of an id together, in order, so its first row that has the class's set is taken and the sets are not shuffled to find it.
    Should adaptive execution split a very common id, its set comes once from each split; equal rows only repeat links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            data, offsets = words.text_bytes(batch.column(2))
            for a, b in words.slices(offsets):
                sets = words.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                reps, keys = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                at = []
                for i, (rep, key) in enumerate(zip(reps, keys, strict=True)):
                    if rep != last and _set_key(sets[i]) == key:
                        at.append(i)
                        last = rep
                cells = [pa.array([reps[i] for i in at], pa.int64()), pa.array([keys[i] for i in at], pa.binary()), pa.array([sets[i].tobytes() for i in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["rep", "set_key", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    # wanted grows with the documents: never broadcast
    met = texts.join(wanted.select("rep", "set_key").hint("merge"), "rep").select("rep", "set_key", "text")
    return met.mapInArrow(giving_back(run), "rep long, set_key binary, shingles binary")


def _label(ids: DataFrame, labels: DataFrame | None, *cols: str) -> DataFrame:
    """Adds l_<col>, the component so far of each id column."""
    for c in cols:
        if labels is None:
            ids = ids.withColumn(f"l_{c}", F.col(c))
        else:
            ids = ids.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"l_{c}")), c, "left").withColumn(f"l_{c}", F.coalesce(f"l_{c}", c))
    return ids


def _join_labels(work: Workspace, labels: DataFrame | None, found: DataFrame, name: str) -> DataFrame | None:
    """Components after the confirmed links (u, v): components of components, so that only links between different ones go on."""
    if found.isEmpty():
        return labels
    joined = components(_label(found, labels, "u", "v"), "l_u", "l_v")
    if labels is not None:
        old = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
        fresh = joined.join(labels.select("id"), "id", "left_anti")
        joined = old.select("id", F.coalesce("now", "component").alias("component")).union(fresh)
    return work.save(joined, name)


def _rest(buckets: DataFrame, sigs: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(u, v): links between different components that share a bucket; of each pair of blocks only links that join what its earlier ones left apart.

    Members of mixed buckets meet in blocks; signatures say which pairs to try, most alike first, and the full sets decide, until one holds or all have failed.
    A pair of blocks has fewer links than components, so links grow with the blocks' members, not with their pairs; which texts are connected stays the same.
    """
    open_ = _label(buckets, labels, "rep")
    per = open_.groupBy("band", "l_rep").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band").agg(F.count("*").alias("labels"), F.max_by("l_rep", "n").alias("main"), F.sum("n").alias("size")).where("labels > 1").drop("labels")
    open_ = open_.join(mixed, "band").join(sigs.select("rep", "sig", "bands"), "rep").join(sets.select("rep", "shingles"), "rep")

    part = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)))
    member = F.struct("rep", "l_rep", "sig", "bands", "shingles", (F.col("l_rep") != F.col("main")).alias("odd"))
    blocks = open_.groupBy("band", part.alias("part")).agg(F.collect_list(member).alias("rows"))
    odd = blocks.where(F.exists("rows", lambda r: r["odd"])).select("band", F.col("rows").alias("one"))
    crossed = odd.join(blocks.select("band", F.col("rows").alias("two")), "band").select("one", "two", "band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(rows: pa.ListScalar) -> tuple:
            s = rows.values
            sig = np.frombuffer(b"".join(s.field("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            return s.field("rep").to_numpy(), s.field("l_rep").to_numpy(), sig, s.field("bands").flatten().to_numpy().reshape(-1, BANDS), s.field("shingles")

        for batch in batches:
            us, vs = [], []
            for one, two, band in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                (ri, li, si, bi, xi), (rj, lj, sj, bj, xj) = parts(one), parts(two)
                full = [np.frombuffer(x, np.uint64) for x in xj.to_pylist()]
                # components of the two blocks and those they are joined to so far
                kinds, where = np.unique(np.concatenate((li, lj)), return_inverse=True)
                joined = np.arange(len(kinds))
                wi, wj = where[: len(li)], where[len(li) :]
                for i in np.flatnonzero(one.values.field("odd").to_numpy(zero_copy_only=False)).tolist():
                    est = _agreement(si[i], sj)
                    hit = np.flatnonzero((est >= SIGNATURE_CUT) & (joined[wj] != joined[wi[i]]))
                    # a pair that shares several buckets is tried in the one of its first common band
                    hit = hit[bi[i][(bi[i] == bj[hit]).argmax(1)] == band]
                    mine = np.frombuffer(xi[i].as_py(), np.uint64)
                    for j in hit[np.argsort(-est[hit], kind="stable")].tolist():
                        if joined[wj[j]] != joined[wi[i]] and _similar(mine, full[j], percent):
                            joined[joined == joined[wj[j]]] = joined[wi[i]]
                            us.append(ri[i])
                            vs.append(rj[j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return crossed.mapInArrow(giving_back(run), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept (is that id).

    Texts are linked where 100 * intersection >= percent * union of their k-word shingle sets. Null and empty texts and texts without words have
    no shingles and link with nothing; a text of fewer than k words is one shingle. Repeated rows are equal texts and come back as often
    as they are given; rows that share an id share a component, which the text of one of them decides. A null id has a null component and is kept. An empty table gives an empty
    result. Other columns of ``docs`` are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    work = Workspace(spark, TEXT_BYTES)
    base = work.save(signatures(docs, id_col, text_col, k), "signatures")
    classes = work.save(
        base.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min_by(F.struct("sig", "bands"), "id").alias("s"), F.min("id").alias("rep")).select("set_key", "rep", "s.sig", "s.bands"),
        "classes",
    )
    # only the classes need signatures from here on
    base = work.save(base.select("id", "n_shingles", "set_key"), "members")
    work.drop("signatures")
    members = classes.select("rep", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep", "band")).alias("pivot")).where("n > 1")
    buckets = work.save(members.join(shared.select("band", "pivot"), "band"), "buckets")
    pairs = buckets.where("rep <> pivot").groupBy(F.col("rep").alias("u"), F.col("pivot").alias("v")).agg(F.count("*").alias("n"))
    sigs = classes.select("rep", "set_key", "sig", "bands").join(buckets.select("rep").distinct(), "rep", "left_semi")
    sigs = work.save(sigs.dropDuplicates(["rep"]), "candidates")
    sets = work.save(_set_table(docs, sigs, id_col, text_col, k), "sets")
    best = pairs.groupBy("u").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v"))
    labels = _join_labels(work, None, work.save(_confirm(best, sets, percent), "pivot_links"), "pivot_labels")
    rest = _rest(buckets.select("band", "rep"), sigs, sets, labels, percent)
    labels = _join_labels(work, labels, work.save(rest, "rest_links"), "labels")
    named = classes.select("set_key", "rep")
    named = _label(named, labels, "rep").select("set_key", F.col("l_rep").alias("component"))
    out = base.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
