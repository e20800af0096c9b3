"""Byte-level BPE by merge replay over a corpus block, and decoding.

Texts are split by the vocabulary's pattern. The distinct words of a block of documents are laid out as one chain of byte tokens, and an
inverted index leads from each mergeable pair to the places where it stands. Merges are applied in rank order, each to all its places in the block
at once; only the two pairs next to a merged place are looked at again. A word's tokens depend on the word alone, so blocks of any size give the
same ids and no rows need to move. Blocks hold about ``BLOCK`` bytes of text (a longer text stands alone), which bounds a task's memory.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenfield.llm import words
from lumenfield.llm.tables import TEXT_BYTES, end_batches, giving_back, picked, with_schema

BLOCK, FLUSH = 2 << 20, 1 << 20
MAX_CACHED = 100_000
PART = 1 << 18  # pairs looked up at a time


class Vocabulary:
    """Rank file: one token (base64) and its rank per line. Ranks are merge order and token ids."""

    def __init__(self, rank_file: str, pattern: str):
        self.pattern = regex.compile(pattern)
        ranks = {}
        with open(rank_file, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # all ways to join two tokens into a third
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.width = len(self.bytes_of)
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start = np.cumsum(self.size) - self.size
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        order = np.argsort(keys)
        # open addressing: a power of two at least four times the pairs, linear probing
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, -1, np.int64)
        place, todo = self._place(keys[order]), np.arange(len(keys))
        made_sorted = np.array(made, np.int64)[order]
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.slots[place[todo]] < 0]
            _, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.slots[place[won]] = keys[order][won]
            self.ranks[place[won]] = made_sorted[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            place[todo] = (place[todo] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B97F4A7C1) >> 17) & self.mask

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair joins into, -1 where there is none or an end is -1."""
        if len(a) > PART:
            return np.concatenate([self.joined(a[c : c + PART], b[c : c + PART]) for c in range(0, len(a), PART)])
        keys = a.astype(np.int64) * self.width + b
        place = self._place(keys)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        for _ in range(self.probes):
            found = self.slots[place[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[place[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & self.mask
        return out


    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, in pieces of bounded size."""
        cuts = range(0, len(ids), 1 << 18)
        return b"".join(self.all_bytes[_ragged(self.start[part], self.size[part])].tobytes() for part in (ids[c : c + (1 << 18)] for c in cuts))


@functools.lru_cache(maxsize=2)
def vocabulary(rank_file: str, pattern: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(rank_file, pattern)


def replay(vocab: Vocabulary, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after another, and the index of each word's first token (one more at the end)."""
    lengths = np.array([len(w) for w in distinct], np.int64)
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    starts = ends - lengths
    # places of a block fit 32 bits, but for those of a single longer text
    whole = np.int32 if n < 1 << 31 else np.int64
    tok = np.full(n + 1, -1, np.int32)
    tok[:n] = vocab.single[np.frombuffer(b"".join(distinct), np.uint8)]
    after = np.arange(1, n + 2, dtype=whole)
    before = np.arange(-1, n, dtype=whole)
    nonempty = lengths > 0
    after[ends[nonempty] - 1] = n  # place n stands for "no token"
    before[starts[nonempty]] = n
    after[n] = before[n] = n
    mark = np.zeros(n + 1, bool)
    rank = np.full(n + 1, -1, np.int32)
    rank[:n] = vocab.joined(tok[:n], tok[after[:n]])

    # inverted index: places by rank of the pair that starts there
    index: dict[int, list[np.ndarray]] = {}

    def enter(places: np.ndarray) -> list[int]:
        r = rank[places]
        order = np.argsort(r, kind="stable")
        places, r = places[order], r[order]
        cuts = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]))
        fresh = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                key = int(r[a])
                if key not in index:
                    index[key] = []
                    fresh.append(key)
                index[key].append(places[a:b])
        return fresh

    queue = enter(np.flatnonzero(rank[:n] >= 0))
    heapq.heapify(queue)
    while queue:
        now = heapq.heappop(queue)
        lists = index.pop(now)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == now]
        if not len(at):
            continue
        nxt = after[at]
        mark[at] = True
        if mark[nxt].any():
            # a place whose pair overlaps the one before it: leftmost first, as in "aaaa"
            taken, keep = set(), []
            for i, p, q in zip(range(len(at)), at.tolist(), nxt.tolist(), strict=True):
                if p not in taken:
                    keep.append(i)
                    taken.add(q)
            mark[at] = False
            at, nxt = at[keep], nxt[keep]
            mark[at] = True
        far = after[nxt]
        tok[at] = now
        tok[nxt] = -1
        rank[nxt] = -1
        after[at] = far
        before[far] = at
        before[n] = n
        prior = before[at]
        touched = np.concatenate((at, prior[(prior < n) & ~mark[prior]]))
        mark[at] = False
        rank[touched] = vocab.joined(tok[touched], tok[after[touched]])
        live = touched[rank[touched] >= 0]
        if len(live):
            for key in enter(live):
                heapq.heappush(queue, key)
    alive = tok[:n] >= 0
    first = np.zeros(len(distinct) + 1, np.int64)
    first[1:] = np.concatenate(([0], np.cumsum(alive)))[ends] if n else 0
    return tok[:n][alive], first


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, … of every (start, length) one after another."""
    total = np.cumsum(lengths)
    shift = np.repeat(starts - (total - lengths), lengths)
    return np.arange(len(shift)) + shift


class _Places(dict):
    """Number of each piece of text, in the order of first sight. A string stands behind a space, a string in a tuple does not."""

    def __missing__(self, piece: str | tuple[str]) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Encodes blocks of texts; keeps the tokens of the pieces met so far, up to a fixed number of pieces.

    cut_at_spaces: no match of the pattern goes on from a non-space to a space, so a text may be cut before each space that follows a non-space
    and such pieces, of which many repeat, be split by the pattern once. Texts with white space before a space are split as a whole. By default
    only the public pattern, which is known to behave so, is cut.
    """

    def __init__(self, rank_file: str, pattern: str, *, cut_at_spaces: bool | None = None):
        self.vocab = vocabulary(rank_file, pattern)
        self.cut_at_spaces = pattern == public_tokenizers.PATTERN if cut_at_spaces is None else cut_at_spaces
        self.loose = regex.compile(r"\s |\A ")
        self._forget()

    def _forget(self) -> None:
        self.pieces = _Places()
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def _places(self, text: str) -> np.ndarray:
        known = self.pieces.__getitem__
        if self.cut_at_spaces and not self.loose.search(text):
            head, *rest = text.split(" ")
            out = np.empty(len(rest) + 1, np.int32)
            out[0] = known((head,))
            out[1:] = np.fromiter(map(known, rest), np.int32, len(rest))
            return out
        found = self.vocab.pattern.findall(text)
        return np.fromiter((known((w,)) for w in found), np.int32, len(found))

    def _learn(self, old: int) -> None:
        """Tokens of the pieces from number ``old`` on."""
        words_of: dict[bytes, int] = {}
        flat, counts = [], []
        split = self.vocab.pattern.findall
        for piece in itertools.islice(self.pieces, old, None):
            found = split(piece[0] if isinstance(piece, tuple) else " " + piece)
            counts.append(len(found))
            flat += [words_of.setdefault(w.encode("utf-8", "surrogatepass"), len(words_of)) for w in found]
        ids, first = replay(self.vocab, list(words_of))
        which = np.array(flat, np.int64)
        sizes = first[which + 1] - first[which]
        self.ids = np.concatenate((self.ids, ids[_ragged(first[which], sizes)].astype(np.int32)))
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        self.first = np.concatenate((self.first, self.first[-1] + upto))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if len(self.pieces) > MAX_CACHED:
            self._forget()
        old = len(self.pieces)
        places = [self._places(t) for t in texts]
        if len(self.pieces) > old:
            self._learn(old)
        for p in places:
            start = self.first[p]
            yield self.ids[_ragged(start, self.first[p + 1] - start)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.vocab.decode(ids)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = True, keep_bytes: bool = False, carry: bool | list[str] = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens (array of ids, null unless ``keep_ids``), n_tokens, ids_sha256, decoded (binary, null unless
    ``keep_bytes``), decoded_sha256, exact (the decoded bytes are those of the text). carry: and the input row, or the named columns of it, as ``row``.

    Null texts count as empty: no tokens, the digests of no bytes. Repeated rows come back as often as they are given, ids may be null; an empty
    table gives an empty result; other columns are not looked at. Any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(rank_file, pattern)
        for batch in batches:
            column = batch.column(1).fill_null("")
            _, offsets = words.text_bytes(column)
            for a, b in words.slices(offsets, BLOCK):
                coded = coder.encode(column.slice(a, b - a).to_pylist())
                # a block is learned as a whole; its rows leave in small batches
                for c, d in words.slices(offsets[a : b + 1] - offsets[a], FLUSH):
                    part = batch.slice(a + c, d - c)
                    rows: tuple[list, ...] = ([], [], [], [], [], [])
                    for text, ids in zip(part.column(1), itertools.islice(coded, d - c), strict=True):
                        back = coder.decode(ids)
                        same = back == (text.as_py() or "").encode("utf-8", "surrogatepass")
                        digest = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
                        for cell, value in zip(rows, (ids if keep_ids else None, len(ids), digest, back if keep_bytes else None, hashlib.sha256(back).hexdigest(), same), strict=True):
                            cell.append(value)
                    kinds = (pa.list_(pa.int32()), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.bool_())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True)), *part.columns[2:]],
                        names=["doc_id", "tokens", "n_tokens", "ids_sha256", "decoded", "decoded_sha256", "exact", *(["row"] if carry else [])],
                    )

    end_batches(docs.sparkSession, TEXT_BYTES)
    ddl = "doc_id long, tokens array<int>, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string, exact boolean"
    return picked(docs, id_col, text_col, carry=carry).mapInArrow(giving_back(run), with_schema(docs, ddl, carry=carry))


def decode(encoded: DataFrame, rank_file: str, pattern: str, tokens_col: str = "tokens") -> DataFrame:
    """Adds ``text``: the tokens' bytes as UTF-8 (null for null tokens, U+FFFD for broken sequences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rank_file, pattern)
        for batch in batches:
            texts = [ids.as_py() if not ids.is_valid else vocab.decode(ids.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for ids in batch.column(tokens_col)]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    schema = encoded.drop("text").schema.add("text", "string")
    return encoded.drop("text").mapInArrow(run, schema)
