"""Words and word shingles of whole texts as 64-bit hashes, for code that runs on Arrow batches inside tasks.

A word is a run of bytes other than space and 0x09-0x0D of the UTF-8 text, with A-Z lower-cased. Work goes slice by
slice (whole documents, about ``SLICE`` bytes each), so memory follows the slice and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        steps = np.full(max(n, SLICE + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offset of each text (one more at the end). Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_bytes_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``text_bytes``, of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the index of each document's first word (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = _GAP[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = gap[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.empty(n, bool)
    last[:-1] = first[1:] | gap[1:]
    last[-1] = True
    inside = ~gap
    starts, ends = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * _power("step", _STEP, n), out=total[1:])
    value = (total[ends] - total[starts]) * _power("back", _BACK, n)[starts]
    return mix(value + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's k-word shingles. Fewer words: the whole sequence as one; none: empty."""
    words, at = word_hashes(data, offsets)
    n = len(words)
    ramp = np.array([pow(0xD6E8FEB86659FD93, i + 1, 2**64) for i in range(k)], np.uint64)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            rolled += words[i : n - k + 1 + i] * ramp[i]
        rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(rolled[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(mix(np.array([(words[a:b] * ramp[: b - a]).sum(dtype=np.uint64)], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
