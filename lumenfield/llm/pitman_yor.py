"""Language-model scores by a hierarchical Pitman-Yor model.

A word is drawn from the restaurant of the word before it (at the start of a text: of the end sign); what those restaurants' tables serve comes from one restaurant without context, whose customers they are; what its tables
serve is spelled, byte by byte, by a tree of restaurants: a byte's context is the two bytes before it, that
restaurant's parent has one byte of context, then none, then all bytes alike. So unknown words have a probability that follows from their spelling, and contexts that
were rarely seen share the statistics of their parents. Tokens are the words of a text and one end sign, which is a word of its own spelling.

Seating is sampled by Gibbs: given all other tables, the number of tables of each dish is drawn from its exact conditional distribution (generalised Stirling numbers) up
to ``EXACT`` customers, and by seating further customers in batches of at most a fiftieth of those already seated beyond. A sweep goes over all pairs of words in parallel, then over all words, then over
the letter restaurants from the longest context to the shortest. Predictive probabilities are averaged over the samples after the burn-in.

Layout: documents are cut into blocks, words into buckets by their hash. A block asks each bucket for its distinct words and for the distinct pairs that end in them; equal requests of a bucket meet in one group, which is the
state that the sweeps go over. A pair lives with its second word, so the word's customers are sums inside a bucket; the tables of a context are in many buckets, and their sums are exchanged after each sweep, for pairs with more than
one customer only: one customer has one table. Pairs of the most frequent words live with their context instead, as one bucket should not have them all; their sums go by the driver. Rows that are exchanged hold packed numbers of a whole bucket. The letter restaurants have at most 256 ** 3 cells, whatever the corpus; besides them the driver holds two numbers of each frequent word, of which there are at most two for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm import words
from lumenfield.llm.tables import Workspace, giving_back

DISCOUNT, STRENGTH = 0.75, 10.0  # of words; the discount where the counts do not tell
CONTEXT_STRENGTH = 1.0  # of words after a word
LETTER_DISCOUNT, LETTER_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES = 2, 3
EXACT = 48
BLOCK = 24 << 20
BUCKET = 16 << 20  # bytes of text for which there is one bucket of words
SAMPLE_OF = 64  # one text of so many is looked at for frequent words
END = b" "  # no word holds a space


def _stirling(n: int, discount: float) -> np.ndarray:
    """log of generalised Stirling numbers S(c, t), c and t up to n."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(n):
            t = np.arange(n + 1)
            stay = s[c] + np.log(np.maximum(c - discount * t, 0))
            new = np.concatenate(([-np.inf], s[c, :-1]))
            s[c + 1] = np.logaddexp(stay, new)
    return s


_tables: dict[float, np.ndarray] = {}


def draw_tables(count: np.ndarray, parent: np.ndarray, other: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each dish, given its customers, the parent's probability of the dish, and the restaurant's other tables."""
    if discount not in _tables:
        _tables[discount] = _stirling(EXACT, discount)
    s = _tables[discount]
    out = np.minimum(count, 1)
    small = np.minimum(count, EXACT)
    for c in range(2, EXACT + 1):
        at = np.flatnonzero(small == c)
        if not len(at):
            continue
        t = np.arange(1, c + 1)
        steps = np.log(strength + discount * (other[at, None] + t - 1)) + np.log(np.maximum(parent[at, None], 1e-300))
        w = s[c, 1 : c + 1] + np.cumsum(steps, axis=1)
        w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
        out[at] = 1 + (rng.random(len(at))[:, None] * w[:, -1:] > w).sum(1)
    at = np.flatnonzero(count > EXACT)
    seated = np.full(len(at), EXACT)
    while len(at):
        more = np.minimum(count[at] - seated, np.maximum(1, seated // 50))
        new = (strength + discount * (other[at] + out[at])) * parent[at]
        out[at] += rng.binomial(more, new / (new + np.maximum(seated - discount * out[at], 1e-9)))
        seated = seated + more
        left = count[at] > seated
        at, seated = at[left], seated[left]
    return out


class Letters:
    """Restaurants of bytes with contexts of two bytes, one byte and none; tables drawn from the longest context down."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rng: np.random.Generator, before: Letters | None):
        """codes: context byte, context byte, byte as one number; counts: customers, the tables of words that use them."""
        self.levels = []  # (codes, count, tables, width)
        for width in (3, 2, 1):
            size = 256**width
            count = np.bincount(codes % size, counts, minlength=size).astype(np.int64) if width < 3 else np.bincount(codes, counts, minlength=size).astype(np.int64)
            codes = np.flatnonzero(count)
            count = count[codes]
            other_all = np.zeros(size // 256, np.int64)
            tables = np.minimum(count, 1)
            np.add.at(other_all, codes // 256, tables)
            # the parents' probabilities of the sweep before; alike for all bytes at first
            parent = before.prob(codes % (size // 256), width - 1) if before is not None and width > 1 else np.full(len(codes), 1 / 256)
            tables = draw_tables(count, parent, other_all[codes // 256] - tables, LETTER_DISCOUNT, LETTER_STRENGTH, rng)
            per_c, per_t = np.zeros(size // 256, np.int64), np.zeros(size // 256, np.int64)
            np.add.at(per_c, codes // 256, count)
            np.add.at(per_t, codes // 256, tables)
            self.levels.append((codes, count, tables, per_c, per_t))
            counts = tables
        self._memo: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def prob(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Predictive probability of the last byte of each code after its first width - 1 bytes."""
        if width == 0:
            return np.full(len(codes), 1 / 256)
        known, count, tables, per_c, per_t = self.levels[3 - width]
        size = 256**width
        back = self.prob(codes % (size // 256), width - 1)
        at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        c, t = np.zeros(len(codes)), np.zeros(len(codes))
        if len(known):
            hit = known[at] == codes
            c[hit], t[hit] = count[at[hit]], tables[at[hit]]
        ctx = codes // 256
        own = np.maximum(c - LETTER_DISCOUNT * t, 0)
        return (own + (LETTER_STRENGTH + LETTER_DISCOUNT * per_t[ctx]) * back) / (LETTER_STRENGTH + per_c[ctx])


def spelled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (two bytes before, byte) of all bytes and the closing space of every word, and the start of each word."""
    data, offsets = words.text_bytes_of_binary(column)
    n = np.diff(offsets)
    starts = offsets[:-1] + 3 * np.arange(len(n))
    line = np.full(int(offsets[-1]) + 3 * len(n), 32, np.int64)  # each word as space, space, bytes, space
    inner = np.arange(int(offsets[-1])) + 3 * np.repeat(np.arange(len(n)), n) + 2
    line[inner] = data
    code = (line[:-2] << 16) | (line[1:-1] << 8) | line[2:]
    keep = np.ones(len(code), bool)
    ends = (starts + n + 3)[:-1]
    keep[np.concatenate((ends - 2, ends - 1))[np.concatenate((ends - 2, ends - 1)) < len(code)]] = False
    return code[keep], np.concatenate(([0], np.cumsum(n + 1)[:-1])) if len(n) else np.zeros(0, np.int64)


def spell_log(letters: Letters, column: pa.Array) -> np.ndarray:
    """Natural log of the probability that the letter restaurants spell each word."""
    codes, starts = spelled(column)
    if not len(starts):
        return np.zeros(0)
    kinds, which = np.unique(codes, return_inverse=True)
    return np.add.reduceat(np.log(letters.prob(kinds, 3))[which], starts)


def _hashes(column: pa.Array) -> np.ndarray:
    """64-bit hashes of words; a word's bucket is its hash's place among equal ranges, so words in the order of their hashes are in the order of their buckets."""
    return pd.util.hash_array(np.array(column.to_pylist(), dtype=object), categorize=False)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one value: of each only the bytes that its numbers need, first bytes together, then second bytes, compressed."""
    head, parts = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a).astype(np.int64, copy=False).view(np.uint64)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head += [len(a), width]
        parts.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, as 64-bit numbers."""
    raw = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (2 * n + 1), []
    for length, width in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        wide = np.zeros((length, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length).T
        out.append(wide.view(np.int64).reshape(-1))
        at += length * width
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, which take fewer bytes; the sums of them are the array."""
    return np.diff(a, prepend=a.dtype.type(0))


def _column(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Words as a binary column."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes())])


def _letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each word, and the bytes of all."""
    data, offsets = words.text_bytes_of_binary(column)
    return np.diff(offsets), data


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pydict({n: [r[i] if i < len(r) else None for r in rows] for i, n in enumerate(_ROW.names)}, schema=_ROW)


_ZSTD = pa.Codec("zstd")
# what steps send one another: kind of the row, bucket that gets it, block or bucket that sent it, packed numbers, counts to be summed over all rows
ROW = "kind int, bucket int, src long, data binary, stats array<long>"
_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("src", pa.int64()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _pairs(flat: np.ndarray, bucket: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, context and word of the distinct pairs of a sequence, in this order, and the place of each token's pair among them. The bucket is the word's; that of the context where ``often`` holds of the word.

    Every document ends with the end sign, which thus also is the context of the next document's first word.
    """
    m = len(bucket)
    code = np.empty(len(flat), np.int64)
    code[1:] = flat[:-1]
    code[:1] = flat[-1:]
    code += np.where(often[flat], bucket[code], bucket[flat]) * m
    code = code * m + flat
    kinds, which = np.unique(code, return_inverse=True)
    return kinds // (m * m), kinds // m % m, kinds % m, which


def _blocks(docs: DataFrame, id_col: str, text_col: str, train, buckets: int, frequent: list[bytes] = (), *, contexts: bool) -> DataFrame:
    """Rows of kind 0: what a block asks of a bucket, its distinct words there and their pairs with the words before them, with counts in training documents; of kind 4: the block's documents as sequences of numbers.

    A block numbers its words in the order of their hashes, so a bucket's words are neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            lower = pa.compute.ascii_lower(batch.column(1).fill_null("")).cast(pa.large_binary())
            _, offsets = words.text_bytes(batch.column(1))
            for a, b in words.slices(offsets, BLOCK):
                number: dict[bytes, int] = {}
                put = number.setdefault
                parts, lengths = [], np.zeros(b - a, np.int64)
                for i, text in enumerate(lower.slice(a, b - a)):
                    tokens = text.as_py().split()
                    tokens.append(END)
                    parts.append(np.array([put(w, len(number)) for w in tokens], np.int32))
                    lengths[i] = len(tokens)
                column = pa.array(list(number), pa.large_binary())
                found = [(number[w], i) for i, w in enumerate(frequent) if w in number]
                del number, put
                hashes = _hashes(column)
                order = np.argsort(hashes, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                flat = place[np.concatenate(parts)]
                del parts
                hashes, bucket = hashes[order], _bucket(hashes[order], buckets)
                size, data = _letters_of(column.take(pa.array(order)))
                ends = np.concatenate(([0], np.cumsum(size)))
                learn = np.repeat(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False), lengths)
                counts = np.bincount(flat[learn], minlength=len(order))
                often = np.full(len(order), -1)
                often[place[[n for n, _ in found]]] = [i for _, i in found]
                if contexts:
                    home, before, word, which = _pairs(flat, bucket, often >= 0)
                    seen = np.bincount(which[learn], minlength=len(word))
                    del which
                    edges = np.searchsorted(home, np.arange(buckets + 1))
                block = (task << 24) + seq
                seq += 1
                rows, at = [], np.searchsorted(bucket, np.arange(buckets + 1))
                for k in np.unique(bucket).tolist():
                    lo, hi = at[k], at[k + 1]
                    asked = [size[lo:hi], data[ends[lo] : ends[hi]], counts[lo:hi]]
                    if contexts:
                        pairs = slice(edges[k], edges[k + 1])
                        kinds, many = np.unique(before[pairs], return_counts=True)
                        w = word[pairs]
                        # frequent words are numbered after the bucket's own
                        asked += [_steps(hashes[kinds]).view(np.int64), many, np.where(often[w] < 0, w - lo, hi - lo + often[w]), seen[pairs]]
                    rows.append((0, k, block, pack(*asked)))
                held = ~batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                ids = batch.column(0).slice(a, b - a)
                rows.append((4, (task + seq) % buckets, block, pack(held, lengths, flat, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), np.flatnonzero(often >= 0))))
                for i in range(0, len(rows), 256):
                    yield from _rows(rows[i : i + 256]).to_batches()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), train.alias("train"))
    return rows.mapInArrow(giving_back(run), ROW)


def _grouped(rows: DataFrame, run: Callable[[int, dict[int, list[tuple[int, list[np.ndarray]]]]], list[tuple]]) -> DataFrame:
    """``run`` on every bucket: its number, and per kind the rows sent to it as (sender, arrays), senders in order. The answer is rows again; rows of kind 4 go on as they are."""

    def task(key: tuple, got: pa.Table) -> pa.Table:
        text = pa.compute.equal(got["kind"], 4)
        texts, got = got.filter(text).select(_ROW.names).cast(_ROW), got.filter(pa.compute.invert(text))
        kinds: dict[int, list[tuple[int, list[np.ndarray]]]] = {}
        order = np.lexsort((got["src"].to_numpy(), got["kind"].to_numpy()))
        for kind, src, data in zip(*(got[k].take(pa.array(order)).to_pylist() for k in ("kind", "src", "data")), strict=True):
            kinds.setdefault(kind, []).append((src, unpack(data)))
        return pa.concat_tables([_rows(run(key[0].as_py(), kinds)), texts])

    return rows.groupBy("bucket").applyInArrow(task, ROW)


# arrays of a bucket's state, in this order; those of pairs are for pairs with more than one customer, whose number of tables is not certain
_STATE = ("size", "data", "c", "alone", "customers", "t", "pair_word", "pair_many", "pair_c", "pair_t", "pair_sum", "to", "to_many", "place", "past_customers", "past_t", "often_at", "often", "often_alone")


def _gather(buckets: int, frequent: list[bytes] = (), *, contexts: bool):
    """Requests of a bucket → kind 0: its state with one table a dish; kind 1, per block: which of its words and pairs the block asked for; kind 2, to the bucket of each context: its pairs here; kind 3: hashes of its words; kind 5: tables here of frequent words' pairs."""

    def run(own: int, kinds: dict) -> list[tuple]:
        asked = kinds.get(0, [])
        if not asked:
            return []
        column = _column(_joined([a[0] for _, a in asked]), _joined([a[1] for _, a in asked]))
        coded = column.dictionary_encode()
        names, hashes = coded.dictionary, _hashes(coded.dictionary)
        order = np.argsort(hashes, kind="stable")
        if (hashes[order][1:] == hashes[order][:-1]).any():
            order = np.array(sorted(range(len(hashes)), key=lambda i: (hashes[i], names[i].as_py())))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        mine = place[coded.indices.to_numpy()]
        w, hashes = len(order), hashes[order]
        size, data = _letters_of(names.take(pa.array(order)))
        c = np.bincount(mine, _joined([a[2] for _, a in asked]), minlength=w).astype(np.int64)
        starts = np.cumsum([0, *(len(a[0]) for _, a in asked)])
        none = np.zeros(0, np.int64)
        if not contexts:
            t = np.minimum(c, 1)
            state = [size, data, c, c, c, t, *[none] * 13]
            stats = [c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum(), 0, 0, c.sum(), t.sum()]
            index = [(1, own, src, pack(_steps(mine[a:b]))) for (src, _), a, b in zip(asked, starts[:-1], starts[1:], strict=True)]
            return [(0, own, 0, pack(*state), [int(x) for x in stats]), *index]
        before = _joined([np.cumsum(a[3].view(np.uint64), dtype=np.uint64) for _, a in asked])
        contexts_, which = np.unique(before, return_inverse=True)
        wide = w + len(frequent)
        word = _joined([np.concatenate((mine[i:j], np.arange(w, wide)))[a[5]] for (_, a), i, j in zip(asked, starts[:-1], starts[1:], strict=True)])
        code = np.repeat(which, _joined([a[4] for _, a in asked])) * wide + word
        pairs, which = np.unique(code, return_inverse=True)
        n = np.bincount(which, _joined([a[6] for _, a in asked]), minlength=len(pairs)).astype(np.int64)
        several, single = n > 1, n == 1
        ask = np.where(several, np.cumsum(several) + 1, n)[which]  # 0 and 1 are counts, more the number of the pair among those with several customers, from 2 on
        ends = np.cumsum([0, *(len(a[5]) for _, a in asked)])
        index = [
            (1, own, src, pack(_steps(mine[a:b]), ask[i:j]))
            for (src, _), a, b, i, j in zip(asked, starts[:-1], starts[1:], ends[:-1], ends[1:], strict=True)
        ]
        word, context = pairs % wide, pairs // wide
        alone = np.bincount(word[single], minlength=wide)
        singles, many = (np.bincount(context[x], minlength=len(contexts_)) for x in (single, several))
        customers = alone + np.bincount(word[several], minlength=wide)
        alone, often_alone, customers, often_tables = alone[:w], alone[w:], customers[:w], customers[w:]
        t = np.minimum(customers, 1)
        which = pa.compute.index_in(names, pa.array(list(frequent), pa.large_binary())).to_pylist() if frequent else []
        here = sorted((int(place[i]), k) for i, k in enumerate(which) if k is not None)
        one = np.ones(int(several.sum()), np.int64)
        state = [size, data, c, alone, customers, t, word[several], many[many > 0], n[several], one, 0 * one, none, none, none, none, none, np.array([i for i, _ in here], np.int64), np.array([k for _, k in here], np.int64), often_alone]
        stats = [c.sum(), (c > 0).sum(), (customers == 1).sum(), (customers == 2).sum(), single.sum(), (n == 2).sum(), customers.sum(), t.sum()]
        used = np.flatnonzero(singles + many)
        edges = np.searchsorted(_bucket(contexts_[used], buckets), np.arange(buckets + 1))
        sent = [
            (2, k, own, pack(_steps(contexts_[used[i:j]]).view(np.int64), singles[used[i:j]], many[used[i:j]]))
            for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if j > i
        ]
        return [(0, own, 0, pack(*state), [int(x) for x in stats]), *index, *sent, (3, own, own, pack(_steps(hashes).view(np.int64))), (5, own, own, pack(often_tables, 0 * often_tables))]

    return run


def _link(own: int, kinds: dict) -> list[tuple]:
    """Kinds 2 and 3 of ``_gather`` → kind 0: tables of pairs seen once, per context; kind 1, back to each bucket: places of its contexts with pairs seen more often, and their tables in all buckets."""
    hashes = np.cumsum(kinds[3][0][1][0].view(np.uint64), dtype=np.uint64)
    single, all_ = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    at = []
    for _, (steps, singles, many) in kinds.get(2, ()):
        at.append(np.searchsorted(hashes, np.cumsum(steps.view(np.uint64), dtype=np.uint64)))
        np.add.at(single, at[-1], singles)
        np.add.at(all_, at[-1], singles + many)
    back = [(1, src, own, pack(_steps(x[a[2] > 0]), all_[x[a[2] > 0]])) for (src, a), x in zip(kinds.get(2, ()), at, strict=True) if (a[2] > 0).any()]
    return [(0, own, own, pack(single)), *back]


def _totals(sample: int | None):
    """Tables of contexts sent by ``Model.sweep`` and kind 0 of ``_link`` → kind 1, back to each bucket: tables in all buckets; kind 2, of a sample that is kept: those of every context."""

    def run(own: int, kinds: dict) -> list[tuple]:
        all_ = kinds[0][0][1][0].copy()
        at = [np.cumsum(a[0]) for _, a in kinds.get(1, ())]
        for (_, a), x in zip(kinds.get(1, ()), at, strict=True):
            np.add.at(all_, x, a[1])
        back = [(1, src, own, pack(all_[x])) for (src, _), x in zip(kinds.get(1, ()), at, strict=True)]
        return back if sample is None else [*back, (2, own, sample, pack(all_))]

    return run


class Model:
    """Gibbs sampler over the buckets' states."""

    def __init__(self, work: Workspace, gathered: DataFrame, frequent: list[bytes] = (), *, contexts: bool):
        self.work, self.contexts, self.frequent = work, contexts, list(frequent)
        self.state = gathered.where("kind = 0")
        n = self._stats(8)
        self.train_tokens, self.types, self.customers, self.total_tables = n[0], n[1], n[6], n[7]
        # the share of what was seen once among what was seen once or twice
        share = lambda once, twice: float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else DISCOUNT
        self.discount, self.context_discount = share(n[2], n[3]), share(n[4], n[5])
        # of frequent words: customers, tables, and customers after the last draw of pairs, which their next draw takes
        self.often, _ = self._frequent_tables(gathered)
        self.often_t, self.often_next = np.minimum(self.often, 1), self.often
        self.customers, self.total_tables = self.customers + int(self.often.sum()), self.total_tables + int(self.often_t.sum())
        self.letters: Letters | None = None
        self.samples: list[tuple[int, int, Letters]] = []
        if contexts:
            self.links = work.save(_grouped(gathered.where("kind in (2, 3)"), _link), "links", by="kind", free=True)
            work.drop("gathered/kind=2")
            work.drop("gathered/kind=3")
            self.replies = self.links.where("kind = 1")
            self.kept = []

    def _stats(self, n: int) -> list[int]:
        row = self.state.agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
        return [int(x or 0) for x in row]

    def _frequent_tables(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Of each frequent word, the tables of its pairs in all buckets, and its own."""
        out = np.zeros((2, len(self.frequent)), np.int64)
        if not self.frequent:
            return out[0], out[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(out.shape, np.int64)
            for b in batches:
                for row in b.column(0):
                    sums += np.array(unpack(row.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.shape[1])), pa.array(sums[0]), pa.array(sums[1])], names=["i", "n", "t"])

        for r in rows.where("kind = 5").select("data").mapInArrow(run, "i long, n long, t long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():
            out[:, r.i] = r.n, r.t
        return out[0], out[1]

    def _letter_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers of the letter restaurants: the letters of every table of words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in batches:
                for row in b.column(0):
                    state = dict(zip(_STATE, unpack(row.as_py()), strict=True))
                    c, starts = spelled(_column(state["size"], state["data"]))
                    times = np.repeat(state["t"], np.diff(np.concatenate((starts, [len(c)]))))
                    codes, which = np.unique(np.concatenate((codes, c[times > 0])), return_inverse=True)
                    sums = np.bincount(which, np.concatenate((sums, times[times > 0])), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["code", "n"])

        rows = self.state.select("data").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
        return rows["code"].to_numpy(), rows["n"].to_numpy()

    def sweep(self, number: int, *, keep: bool) -> None:
        codes, counts = self._letter_counts()
        self.letters = letters = Letters(codes, counts, np.random.Generator(np.random.PCG64([3, number])), self.letters)
        customers, tables, discount, context_discount, contexts, first = self.customers, self.total_tables, self.discount, self.context_discount, self.contexts, number == 1
        frequent, often, often_t, often_next = self.frequent, self.often, self.often_t, self.often_next

        def run(own: int, kinds: dict) -> list[tuple]:
            s = dict(zip(_STATE, kinds[0][0][1], strict=True))
            # a bucket's draws follow from its words, in the order of their hashes, and not from Spark's partitions
            rng = np.random.Generator(np.random.PCG64([number, own]))
            base = np.exp(spell_log(letters, _column(s["size"], s["data"])))
            sent = []
            if contexts:
                replies = kinds.get(1, [])
                if first:
                    s["customers"][s["often_at"]], s["t"][s["often_at"]] = often[s["often"]], often_t[s["often"]]
                    s["to"], s["to_many"] = np.array([k for k, _ in replies], np.int64), np.array([len(a[0]) for _, a in replies], np.int64)
                    s["place"] = _joined([a[0] for _, a in replies])
                elsewhere = _joined([a[-1] for _, a in replies])
                which = np.repeat(np.arange(len(s["pair_many"])), s["pair_many"])
                seated = np.concatenate((s["customers"] - discount * s["t"], often - discount * often_t))
                word = (seated + (STRENGTH + discount * tables) * np.concatenate((base, np.exp(spell_log(letters, pa.array(frequent, pa.large_binary())))))) / (STRENGTH + customers)
                s["pair_t"] = draw_tables(s["pair_c"], word[s["pair_word"]], elsewhere[which] - s["pair_t"], context_discount, CONTEXT_STRENGTH, rng)
                dishes = np.bincount(s["pair_word"], s["pair_t"], minlength=len(word)).astype(np.int64)
                s["customers"] = s["alone"] + dishes[: len(base)]
                s["customers"][s["often_at"]] = often_next[s["often"]]
                sums = np.bincount(which, s["pair_t"], minlength=len(s["pair_many"])).astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(s["to_many"])))
                sent = [(1, k, own, pack(s["place"][i:j], sums[i:j])) for k, i, j in zip(s["to"].tolist(), ends[:-1], ends[1:], strict=True)]
            s["t"] = draw_tables(s["customers"], base, np.maximum(tables - s["t"], 0), discount, STRENGTH, rng)
            if frequent:
                own_t = np.zeros(len(frequent), np.int64)
                own_t[s["often"]] = s["t"][s["often_at"]]
                sent.append((5, own, own, pack(s["often_alone"] + dishes[len(base) :], own_t)))
            if keep:
                s["pair_sum"] = s["pair_sum"] + s["pair_t"]
                s["past_customers"], s["past_t"] = np.concatenate((s["past_customers"], s["customers"])), np.concatenate((s["past_t"], s["t"]))
            stats = [int(s["customers"].sum()), int(s["t"].sum())]
            return [(0, own, 0, pack(*(s[k] for k in _STATE)), stats), *sent]

        rows = self.state.unionByName(self.replies) if contexts else self.state
        saved = self.work.save(_grouped(rows, run), f"seats{number}", by="kind", free=True)
        self.work.drop("gathered/kind=0" if first else f"seats{number - 1}")
        self.state = saved.where("kind = 0")
        self.customers, self.total_tables = self._stats(2)
        self.often, (self.often_next, self.often_t) = self.often_next, self._frequent_tables(saved)
        if contexts:
            totals = _grouped(saved.where("kind = 1").unionByName(self.links.where("kind = 0")), _totals(len(self.samples) if keep else None))
            replies = self.work.save(totals, f"totals{number}", by="kind", free=True)
            self.replies = replies.where("kind = 1")
            if keep:
                self.kept.append(replies.where("kind = 2"))
        if keep:
            self.samples.append((self.customers, self.total_tables, letters))

    def unknown(self) -> list[float]:
        """Of each sample, the probability of all unknown words together as next word of the word restaurant."""
        samples, discount = self.samples, self.discount

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    state = dict(zip(_STATE, unpack(row.as_py()), strict=True))
                    column = _column(state["size"], state["data"]).filter(pa.array(state["c"] > 0))
                    sums = [float(np.exp(spell_log(letters, column)).sum()) for *_, letters in samples]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["bucket", "s", "p"])

        spelled_known = self.state.select("bucket", "data").mapInArrow(known, "bucket int, s int, p double").orderBy("s", "bucket").collect()
        rest = np.ones(len(samples))
        for r in spelled_known:
            rest[r.s] -= r.p
        return [(STRENGTH + discount * tables) / (STRENGTH + customers) * max(r, 1e-12) for (customers, tables, _), r in zip(samples, rest.tolist(), strict=True)]

    def answers(self, index: DataFrame) -> DataFrame:
        """Per block and bucket (src, bucket) of what the block asked for: of words their count, tables as contexts by sample and probability in the word restaurant by sample; of pairs their count, and by how much the tables of all samples fall short of it."""
        samples, discount, contexts = self.samples, self.discount, self.contexts

        def run(own: int, kinds: dict) -> list[tuple]:
            s = dict(zip(_STATE, kinds[0][0][1], strict=True))
            c, column = s["c"], _column(s["size"], s["data"])
            cells = [c, *(a[0] for _, a in kinds.get(2, ()))]
            for i, (customers, tables, letters) in enumerate(samples):
                seated, t = (s[k][i * len(c) : (i + 1) * len(c)] for k in ("past_customers", "past_t"))
                base = np.exp(np.maximum(spell_log(letters, column), -690))
                p = (np.maximum(seated - discount * t, 0) + (STRENGTH + discount * tables) * base) / (STRENGTH + customers)
                cells.append((p.view(np.int64) + (1 << 19)) >> 20)  # 32 bits after the leading one
            if contexts:
                n, short = (np.concatenate((few, x)) for few, x in (([0, 1], s["pair_c"]), ([0, 0], len(samples) * s["pair_c"] - s["pair_sum"])))
            out = []
            for src, asked in kinds.get(1, ()):
                mine = np.cumsum(asked[0])
                got = [x[mine] for x in cells]
                if contexts:
                    got += [n[asked[1]], short[asked[1]]]
                out.append((0, own, src, pack(*got)))
            return out

        rows = index.unionByName(self.state)
        for kept in self.kept if contexts else ():
            rows = rows.unionByName(kept)
        return _grouped(rows, run).select("bucket", "src", "data")


def _frequent(work: Workspace, docs: DataFrame, text_col: str, buckets: int) -> list[bytes]:
    """Words with more tokens than half an average bucket has, in order: their pairs are dealt by context, as one bucket should not have them all. Counted in a sample that the texts decide; what it misses is only not dealt."""
    if buckets == 1:
        return []
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text")
    some = docs.select(text).where(F.crc32(F.col("text").cast("binary")) % SAMPLE_OF == 0)
    tokens = F.concat(F.array_remove(F.split("text", r"[ \t-\r]+"), ""), F.array(F.lit(END.decode())))
    counts = work.save(some.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "frequent", free=True)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r.word.encode() for r in counts.where(F.col("n") > total / (2 * buckets)).select("word").collect())


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", *, contexts: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (train is false), n_tokens, n_known, train_tokens, base_score, score, spelled_score, spelled_unknown.

    train: Column, whether the model learns from the row; null counts as false. contexts: whether words have restaurants by the word before them, or all words one. Null and empty texts are one end sign.
    base_score: add-a-half unigram counts; score: log10 probability of the text in the
    model where all unknown words are one outcome, as in base_score; spelled_score: log10 probability of the text itself, every unknown word by its spelling; spelled_unknown: the part of spelled_score that
    is the unknown words'. Repeated rows count, and come back, as often as they are given; ids may be null; with nothing to learn from, every token is unknown. An empty table gives an empty result; other columns are not
    looked at. Probabilities below 1e-300 count as that.
    """
    work = Workspace(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    frequent = _frequent(work, docs, text_col, buckets) if contexts else []
    blocks = _blocks(docs, id_col, text_col, F.coalesce(train, F.lit(False)), buckets, frequent, contexts=contexts)
    gathered = work.save(_grouped(blocks, _gather(buckets, frequent, contexts=contexts)), "gathered", by="kind", free=True)
    model = Model(work, gathered, frequent, contexts=contexts)
    for i in range(1, BURN_IN + SAMPLES + 1):
        model.sweep(i, keep=i > BURN_IN)
    unknown = np.array(model.unknown())
    total, types, n_samples, context_discount = model.train_tokens, model.types, len(model.samples), model.context_discount
    texts = gathered.where("kind = 4").select(F.col("src").alias("at"), "data")

    def run(docs_: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        answers = [unpack(got["data"][int(i)].as_py()) for i in np.argsort(got["bucket"].to_numpy())]
        bucket = np.repeat(np.arange(len(answers)), [len(a[0]) for a in answers])
        cells = [_joined(list(x)) for x in zip(*answers, strict=True)]
        for i in range(docs_.num_rows):
            held, lengths, flat, ids, no_id, often = unpack(docs_["data"][i].as_py())
            c = cells[0]
            base, known = np.log10((c + 0.5) / (total + 0.5 * (types + 1))), c > 0
            p = [(x << 20).view(np.float64) for x in (cells[1 + n_samples : 1 + 2 * n_samples] if contexts else cells[1:])]
            if contexts:
                _, u, w, which = _pairs(flat, bucket, np.isin(np.arange(len(c)), often))
                n, short = cells[-2:]
                whole = CONTEXT_STRENGTH + c[u]
                # customers less the discount of each table, as a mean over the samples
                each = (n - context_discount * (n - short / n_samples)) / whole
                one = np.zeros(len(u))
                for s in range(n_samples):
                    back = (CONTEXT_STRENGTH + context_discount * cells[1 + s][u]) / whole / n_samples
                    each += back * p[s][w]
                    one += back * unknown[s]
            else:
                w, which = np.arange(len(c)), flat
                each, one = sum(p) / n_samples, np.full(len(c), unknown.mean())
            each, one = (np.log10(np.maximum(x, 1e-300)) for x in (each, one))
            values = [base[flat], np.where(known[w], each, one)[which], known[flat].astype(float), each[which], np.where(known[w], 0.0, each)[which]]
            starts = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(v, starts) for v in values]
            columns = [pa.array(ids, mask=no_id > 0), pa.array(held > 0), pa.array(lengths), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(lengths), total)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[3]), pa.array(sums[4])]
            out.append(pa.RecordBatch.from_arrays(columns, schema=_RESULT))
        return pa.Table.from_batches(out, schema=_RESULT)

    answers = model.answers(gathered.where("kind = 1"))
    return texts.groupBy("at").cogroup(answers.groupBy("src")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double, spelled_unknown double")


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("spelled_score", pa.float64()), ("spelled_unknown", pa.float64())]
)
