"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) its letters' vectors, each permuted (rotated) by its
place. A document's vector bundles (adds) the vectors of its n-grams; the prototype of a language bundles the documents that are known to be in it.
A document gets the language whose prototype has the greatest cosine with its own vector.

Letters are what Unicode calls letters, in lower case; any run of other characters is one boundary sign. A bundle is a sum of integers, so prototypes
depend neither on partitioning nor on order. Only the prototypes, one row per language, ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm import words
from lumenfield.llm.tables import TEXT_BYTES, end_batches, giving_back, picked, with_schema, with_texts

DIM, N = 1024, 3
GROUP = 128  # documents bundled together
MOST_LETTERS = 4096  # whose vectors are kept, in 1 KB each
_TOP = 0x110000
_classes: dict[str, np.ndarray] = {}
_vectors: dict[int, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 for what is no letter."""
    if "letters" not in _classes:
        t = np.zeros(_TOP, np.int32)
        for c in range(_TOP):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
        _classes["letters"] = t
    return _classes["letters"]


def _letter_vectors(codes: np.ndarray) -> np.ndarray:
    """Vectors of letters; the code point decides them."""
    if len(_vectors) > MOST_LETTERS:
        _vectors.clear()
    for c in codes.tolist():
        if c not in _vectors:
            _vectors[c] = np.random.Generator(np.random.PCG64([DIM, c])).integers(0, 2, DIM).astype(np.int8) * 2 - 1
    return np.stack([_vectors[c] for c in codes.tolist()])


class Profiler:
    """Vectors of documents; keeps the vectors of the n-grams met so far, up to a fixed number."""

    CACHE = 24_000
    PART = 4096  # n-grams whose vectors are widened at a time

    def __init__(self):
        self.grams: dict[int, int] = {}
        self.table = np.empty((self.CACHE, DIM), np.int8)  # filled as n-grams are met

    def _gram_vectors(self, keys: np.ndarray) -> np.ndarray:
        new = [k for k in keys.tolist() if k not in self.grams]
        if new:
            if len(self.grams) + len(new) > self.CACHE:
                self.grams, new = {}, keys.tolist()
            k = np.array(new, np.int64)
            out = np.ones((len(k), DIM), np.int8)
            for place in range(N):
                letters, which = np.unique((k >> (21 * (N - 1 - place))) & 0x1FFFFF, return_inverse=True)
                out *= np.roll(_letter_vectors(letters), N - 1 - place, axis=1)[which]
            start = len(self.grams)
            self.grams.update((key, start + i) for i, key in enumerate(new))
            self.table[start : start + len(new)] = out
        return self.table[[self.grams[x] for x in keys.tolist()]]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One row per text: its vector (whole numbers), and how many letters it has."""
        table = _letter_table()
        joined = "\0".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = table[code]
        letter = low > 0
        # texts are at least one boundary apart: their separator is no letter
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(code)]
        count = np.bincount(owner[letter], minlength=len(texts))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one boundary sign after each run of letters
        seq, who = low[keep], owner[keep]
        # each word stands between two boundaries: a sign is put before the first word of each text
        heads = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, np.int64)
        seq, who = np.insert(seq, heads, 0), np.insert(who, heads, who[heads] if len(who) else 0)
        if len(seq) < N:
            return np.zeros((len(texts), DIM)), count
        letters, small = np.unique(seq, return_inverse=True)
        n_letters = len(letters)
        span = len(seq) - N + 1
        packed = np.zeros(span, np.int64)
        for place in range(N):
            packed = packed * n_letters + small[place : place + span]
        ok = who[:span] == who[N - 1 :]
        packed, who = packed[ok], who[:span][ok]
        if n_letters**N <= 1 << 22:
            there = np.zeros(n_letters**N, bool)
            there[packed] = True
            kinds = np.flatnonzero(there)
            rank = np.zeros(n_letters**N, np.int32)
            rank[kinds] = np.arange(len(kinds))
            which = rank[packed]
        else:
            kinds, which = np.unique(packed, return_inverse=True)
        keys = np.zeros(len(kinds), np.int64)
        for place in range(N):
            keys = (keys << 21) | letters[(kinds // n_letters ** (N - 1 - place)) % n_letters].astype(np.int64)
        out = np.zeros((len(texts), DIM))
        # sums stay whole numbers: below 2**24 in single precision
        kind = np.float32 if len(packed) < 1 << 24 else np.float64
        for a in range(0, len(keys), self.PART):
            part = keys[a : a + self.PART]
            inside = (which >= a) & (which < a + len(part)) if len(keys) > self.PART else slice(None)
            cells = who[inside].astype(np.int64) * len(part) + (which[inside] - a)
            counts = np.bincount(cells, minlength=len(texts) * len(part)).reshape(len(texts), len(part)).astype(kind)
            out += counts @ self._gram_vectors(part).astype(kind, copy=False)
        return out, count


def _groups(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        _, offsets = words.text_bytes(batch.column(text_at))
        for a, b in words.slices(offsets, 1 << 19):
            for c in range(a, b, GROUP):
                part = batch.slice(c, min(GROUP, b - c))
                yield part, [t or "" for t in part.column(text_at).to_pylist()]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language from all rows of ``labelled`` that have one. Sums are made in the tasks, then added per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(), {}
        for part, texts in _groups(batches, 0):
            vectors, _ = profiler.bundle(texts)
            langs = np.array(part.column(1).to_pylist())
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0)
        if sums:
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sums) + 1, dtype=np.int32) * DIM), pa.array(np.concatenate(list(sums.values())).astype(np.int64))
            )
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), flat], names=["lang", "v"])

    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    end_batches(labelled.sparkSession, TEXT_BYTES)
    totals = rows.mapInArrow(giving_back(run), "lang string, v array<long>").select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    return {r.lang: np.array([x.x for x in r.v], np.float64) for r in sorted(found, key=lambda r: r.lang)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", *, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (cosine with that language's prototype, 0 at least), n_letters: one row per row of ``docs``. carry: and that row as ``row``.

    Null texts and texts without letters are ``und`` with score 0, as is everything when there are no prototypes. Equal cosines go to the language that
    sorts first. Repeated rows and null ids come back as given; other columns are not looked at. Texts are read whole.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names]) if names else np.zeros((0, DIM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler()
        for part, texts in _groups(with_texts(batches, text_col) if carry else batches, 1):
            vectors, letters = profiler.bundle(texts)
            norm = np.sqrt((vectors * vectors).sum(1))
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if names:
                cosine = np.round(vectors @ matrix.T / np.maximum(norm, 1e-300)[:, None], 12)
                best = cosine.argmax(1)
                score = np.where(letters > 0, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0)
                lang = [names[i] if n else "und" for i, n in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(letters.astype(np.int64)), *part.columns[2:]], names=["doc_id", "lang_pred", "score", "n_letters", *(["row"] if carry else [])])

    end_batches(docs.sparkSession, TEXT_BYTES)
    return picked(docs, id_col, text_col, carry=carry, once=True).mapInArrow(giving_back(run), with_schema(docs, "doc_id long, lang_pred string, score double, n_letters long", carry=carry))


def held_out(id_col: str = "doc_id"):
    """The rows that no prototype learns from: one in five, by the id's CRC-32. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
