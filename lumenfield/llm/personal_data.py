"""Personal data by patterns and by a semi-Markov conditional random field over whole segments.

The patterns find the unmistakable spans. The field then scores every candidate segment near a digit or ``@`` as a whole: its features describe the complete
span (length, number of digits, separators, checksum, agreement with a pattern, what stands beside it), not single characters. A segment has at most
``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters, so dynamic programming over all divisions of the text into segments chooses boundaries and types
jointly in linear time. Text outside the windows around digits and ``@`` has no candidate; it scores 0, and leaving it out changes nothing.

The field is trained here: on windows of a sample of documents (at most ``SAMPLE_DOCS`` documents and ``SAMPLE_WINDOWS`` windows, the lowest MD5 of id first),
labelled by the patterns, by gradient ascent on the conditional likelihood. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm import words
from lumenfield.llm.tables import TEXT_BYTES, end_batches, giving_back, picked, with_schema

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS = 20, 48
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS = 1500, 300, 40
MARGIN = MAX_CHARS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_SEED = re.compile(r"@|[0-9]+")
_DIGIT = re.compile(r"[0-9]")
_OTHER = re.compile(r"[^A-Za-z0-9@+(). -]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches that pass their checks, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Ranges that hold every admissible segment: around each ``@`` and each place with at least four digits near one another."""
    seeds = [(m.start(), m.end(), m.group() == "@") for m in _SEED.finditer(text)]
    near = []
    digits = [(a, b) for a, b, at in seeds if not at]
    starts = [a for a, _ in digits]
    total = np.concatenate(([0], np.cumsum([b - a for a, b in digits]))) if digits else np.zeros(1, np.int64)
    for a, b, at in seeds:
        if not at:
            upto = bisect.bisect_left(starts, a + MAX_CHARS)
            first = bisect.bisect_left(starts, a)
            if total[upto] - total[first] < 4:
                continue
        near.append((max(0, a - MARGIN), min(len(text), b + MARGIN)))
    out: list[tuple[int, int]] = []
    for a, b in near:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FULL = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(?:\.[0-9]+){3}"), _CARD, _PHONE)
N_FEATURES = 30


def _features(text: str, a: int, b: int) -> tuple[int, ...]:
    """Numbers of the features that hold for the whole segment text[a:b]."""
    s = text[a:b]
    d = "".join(_DIGIT.findall(s))
    n, letters = len(d), sum(c.isalpha() for c in s)
    f = [0]
    full = [p.fullmatch(s) is not None for p in _FULL]
    if full[0]:
        f.append(1)
    if full[1]:
        f.append(2 if all(len(p) <= 3 and int(p) <= 255 for p in s.split(".")) else 3)
    if full[2]:
        f.append(4 if 16 <= n <= 19 and luhn(d) else 5)
    if full[3]:
        f.append(6 if 8 <= n <= 15 else 7)
    f.append(8 + (0 if n < 4 else 1 if n < 8 else 2 if n < 16 else 3 if n < 20 else 4))
    f.append(13 if letters else 14)
    if "@" in s:
        f.append(15)
    if s[0] == "+":
        f.append(16)
    if "(" in s:
        f.append(17 if ")" in s else 18)
    if " " in s:
        f.append(19)
    if _OTHER.search(s):
        f.append(26)
    if "." in s:
        f.append(27 if s.count(".") == 3 else 29)
    if "-" in s:
        f.append(28)
    before, after = text[a - 1 : a], text[b : b + 1]
    f.append(20 if before.isalnum() else 21 if not before or before.isspace() else 22)
    f.append(23 if after.isalnum() else 24 if not after or after.isspace() else 25)
    return tuple(f)


def candidates(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int, tuple[int, ...]]], list[int]]:
    """Candidate segments (first token, last token + 1, features) of a window, and where each token starts (the window's end last)."""
    spans = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    starts = [a for a, _ in spans] + [hi]
    weight, ends_ok, starts_ok = [0], [], []
    for a, b in spans:
        c = text[a]
        weight.append(weight[-1] + (b - a if "0" <= c <= "9" else 4 if c == "@" else 0))
        ends_ok.append(c.isascii() and c.isalnum())
        starts_ok.append(ends_ok[-1] or c in "+(")
    out = []
    for i in range(len(spans)):
        if not starts_ok[i]:
            continue
        # an edge of the window is not the edge of the text: no segment touches it, unless the text ends there
        if spans[i][0] == lo > 0:
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, len(spans)) + 1):
            if spans[j - 1][1] - spans[i][0] > MAX_CHARS or text[spans[j - 1][0]] == "\n":
                break
            if ends_ok[j - 1] and weight[j] - weight[i] >= 4 and (spans[j - 1][1] < hi or hi == len(text)):
                out.append((i, j, _features(text, spans[i][0], spans[j - 1][1])))
    return out, starts


def _matrix(cands: list) -> np.ndarray:
    """One row per candidate, 1 for each feature that holds."""
    out = np.zeros((len(cands), N_FEATURES))
    for row, (_, _, f) in zip(out, cands, strict=True):
        row[list(f)] = 1
    return out


def best_segments(cands: list, n_tokens: int, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first token, last token + 1) of the best division of the window; a division without entities scores 0 and wins ties."""
    scores = _matrix(cands) @ weights
    kind = scores.argmax(1).tolist()
    top = scores.max(1).tolist()
    by_end: dict[int, list[int]] = {}
    for k, (_, j, _) in enumerate(cands):
        if top[k] > 1e-9:
            by_end.setdefault(j, []).append(k)
    best, back = [0.0] * (n_tokens + 1), [-1] * (n_tokens + 1)
    for j in range(1, n_tokens + 1):
        best[j] = best[j - 1]
        for k in by_end.get(j, ()):
            value = best[cands[k][0]] + top[k]
            if value > best[j]:
                best[j], back[j] = value, k
    out, j = [], n_tokens
    while j > 0:
        k = back[j]
        if k < 0:
            j -= 1
        else:
            out.append((kind[k], cands[k][0], j))
            j = cands[k][0]
    return out[::-1]


def _log_add(x: float, y: float) -> float:
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def _expected(cands: list, n_tokens: int, scores: np.ndarray) -> np.ndarray:
    """Probability of each candidate as each kind, by the forward and backward sums over all divisions of the window."""
    total = np.logaddexp.reduce(scores, axis=1).tolist()
    forward, backward = [0.0] * (n_tokens + 1), [0.0] * (n_tokens + 1)
    by_end: list[list[int]] = [[] for _ in range(n_tokens + 1)]
    by_start: list[list[int]] = [[] for _ in range(n_tokens + 1)]
    for at, (i, j, _) in enumerate(cands):
        by_end[j].append(at)
        by_start[i].append(at)
    for j in range(1, n_tokens + 1):
        value = forward[j - 1]
        for k in by_end[j]:
            value = _log_add(value, forward[cands[k][0]] + total[k])
        forward[j] = value
    for i in range(n_tokens - 1, -1, -1):
        value = backward[i + 1]
        for k in by_start[i]:
            value = _log_add(value, backward[cands[k][1]] + total[k])
        backward[i] = value
    outside = np.array([forward[i] + backward[j] for i, j, _ in cands]) - forward[-1]
    return np.exp(outside[:, None] + scores)


def train(texts: list[str]) -> np.ndarray:
    """Weights (feature x kind) from windows labelled by the patterns. No window: all 0, and the field adds nothing."""
    examples = []
    for text in texts:
        base = sorted(base_spans(text), key=lambda s: (s[1], -s[2]))
        for lo, hi in windows(text):
            if len(examples) >= SAMPLE_WINDOWS:
                break
            cands, starts = candidates(text, lo, hi)
            if not cands:
                continue
            place = {p: i for i, p in enumerate(starts)}
            by_range = {(i, j): k for k, (i, j, _) in enumerate(cands)}
            gold, end = [], 0
            for kind, a, b in base:
                k = by_range.get((place.get(a), place.get(b)))
                if k is not None and a >= end:
                    gold.append((k, kind))
                    end = b
            examples.append((cands, _matrix(cands), len(starts) - 1, gold))
    weights = np.zeros((N_FEATURES, len(KINDS)))
    squares = np.full_like(weights, 1e-6)
    for _ in range(EPOCHS if examples else 0):
        grad = -0.02 * weights * len(examples) / 100
        for cands, x, n, gold in examples:
            p = _expected(cands, n, x @ weights)
            for k, kind in gold:
                p[k, kind] -= 1
            grad -= x.T @ p
        squares += grad * grad
        weights += 0.8 * grad / np.sqrt(squares)
    return weights


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from a bounded sample of the documents that have a digit or ``@``."""
    rows = docs.select(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("k"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9]{4}|@"))
    # first the bound, from digests alone: then no task hands on more than the sample's own texts
    lowest = rows.select("k").orderBy("k").limit(SAMPLE_DOCS).agg(F.max("k")).first()[0]
    return train([r.text for r in rows.where(F.col("k") <= F.lit(lowest)).orderBy("k", "text").limit(SAMPLE_DOCS).collect()]) if lowest else train([])


def all_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Base spans, and those of the field that overlap none of them, by kind, then start."""
    taken = sorted((a, b) for _, a, b in base)
    out = list(base)
    for lo, hi in windows(text):
        cands, starts = candidates(text, lo, hi)
        for kind, i, j in best_segments(cands, len(starts) - 1, weights) if cands else ():
            a, b = starts[i], starts[j]
            at = bisect.bisect_left(taken, (b, 0))
            if not any(x < b and a < y for x, y in taken[max(0, at - 4) : at + 1]):
                out.append((kind, a, b))
    return sorted(out)


def _as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of overlapping spans replaced by its kind in brackets."""
    out, end = [], 0
    merged: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def find(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *, keep_text: bool = False, carry: bool | list[str] = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (pattern matches), base_sha256, spans (all, as kind:start:end by code points),
    masked (the text with all spans replaced; null unless ``keep_text``, and for null texts). carry: and the input row, or the named columns of it, as ``row``.

    Null texts count as empty: no spans. Ids may be null and rows repeat; an empty table gives an empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = words.text_bytes(batch.column(1))
            for a, b in words.slices(offsets, 4 << 20):
                rows: list[tuple] = []
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    t = text or ""
                    base = base_spans(t)
                    spans = all_spans(t, base, weights) if _SEED.search(t) else base
                    counts = [0, 0, 0, 0]
                    for k, _, _ in base:
                        counts[k] += 1
                    new = masked(t, spans) if keep_text and text is not None else None
                    rows.append((*counts, hashlib.sha256(_as_text(base).encode()).hexdigest(), _as_text(spans), new))
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), *(c.slice(a, b - a) for c in batch.columns[2:])],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked", *(["row"] if carry else [])],
                )

    end_batches(docs.sparkSession, TEXT_BYTES)
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"
    return picked(docs, id_col, text_col, carry=carry).mapInArrow(giving_back(run), with_schema(docs, ddl, carry=carry))
