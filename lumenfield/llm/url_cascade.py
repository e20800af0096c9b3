"""URL filter: a cascade of Bloom filters with exact membership over all keys of the corpus.

Keys are the hosts of all urls with their parent domains and, where the list holds such entries, host and path. The first filter holds the listed keys.
The second holds the unlisted keys of the corpus that the first lets through, the third those listed keys that the second lets through, and so on, until
none is let through. The first filter that lacks a key decides: lacking in an odd one means unlisted, in an even one listed. As every key of the corpus was
put through the cascade while it was built, the answer is exact, and a url is judged in its own row by a few hundred kilobytes of bits, without a join.

Lists of more than ``KEYS`` keys are split by hash into parts with a cascade of their own, of at most some 20 MB each; the urls then pass the parts one after another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.tables import Workspace
from lumenfield.llm.words import mix

#: Listed keys of one cascade; at 29 bits a key at most, its filters stay below about 20 MB.
KEYS = 4_000_000
#: Share of the keys let through by the first filter at least, and by all later ones.
LEAST_RATE, LATER_RATE = 1e-6, 0.5
MOST_LEVELS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    """One filter: ``size`` bits in 64-bit words, ``hashes`` bits a key; ``depth`` salts them."""

    depth: int
    size: int
    hashes: int
    words: np.ndarray

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        hashes = max(1, round(math.log2(1 / rate)))
        return max(64, math.ceil(n * math.log2(1 / rate) / math.log(2))), hashes


def places(depth: int, size: int, hashes: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """(n, hashes) bit places of keys given by two 64-bit hashes."""
    salt = mix(np.array([depth + 1], np.uint64))
    a, b = mix(h1.view(np.uint64) ^ salt), mix(h2.view(np.uint64) + salt) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(size)


def holds(level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = places(level.depth, level.size, level.hashes, h1, h2)
    return ((level.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def member(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed. Keys outside the universe the cascade was built over may be judged wrongly."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    left = np.arange(len(h1))
    for i, level in enumerate(levels):
        inside = holds(level, h1[left], h2[left])
        out[left[~inside]] = i % 2 == 1
        left = left[inside]
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the ``rules`` (host/path) that fits: its host or a subdomain, and a path that starts with the rule's; null if none. For some dozens of rules; long lists are keys."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, _, start = rule.partition("/")
        fits.append(F.when(((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def url_keys(host: Column, path: Column, labels: int, *, pages: bool) -> Column:
    """Array of a url's keys: the host's last 1 to ``labels`` labels, and host with path (at least ``/``) if ``pages``."""
    names = F.split(host, r"\.")
    n = F.size(names)
    tails = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, labels)))), lambda i: F.concat_ws(".", F.slice(names, n - i + 1, i)))
    whole = F.array(F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))) if pages else F.array().cast("array<string>")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(tails, whole))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _arrow(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(batch.schema.get_field_index(x)), np.int64) for x in names]


def _encode(keys: DataFrame, depth: int, size: int, hashes: int) -> np.ndarray:
    """The bits of ``keys`` (h1, h2): set inside the tasks, combined by word, and only then sent to the driver (at most 16 bytes for each word of the filter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(places(depth, size, hashes, *_arrow(b, "h1", "h2")))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(-(-size // 64), np.uint64)
    words[np.asarray(rows["word"], np.int64)] = np.asarray(rows["bits"], np.int64).view(np.uint64)
    return words


def _through(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that the filter lets through."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(holds(sent.value, *_arrow(b, "h1", "h2"))))

    return keys.mapInArrow(run, keys.schema)


def _cascade(work: Workspace, listed: DataFrame, others: DataFrame, n_listed: int, n_others: int, name: str) -> list[Level]:
    levels: list[Level] = []
    rate = min(LATER_RATE, max(LEAST_RATE, n_listed * math.sqrt(0.5) / max(n_others, 1)))
    inside, outside, n = listed, others, n_listed
    while n:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("a listed and an unlisted key have equal hashes")
        depth = len(levels)
        size, hashes = Level.shape(n, rate if depth == 0 else LATER_RATE)
        level = Level(depth, size, hashes, _encode(inside, depth, size, hashes))
        levels.append(level)
        passed = work.save(_through(outside, level), f"{name}-{depth}")
        inside, outside, n = passed, inside, passed.count()
    return levels


def build(universe: DataFrame, listed: DataFrame, work: Workspace, keys_a_part: int = KEYS) -> Iterator[tuple[int, int, list[Level]]]:
    """(number of parts, part, its cascade), one part at a time. Both tables have one column ``key``; repeated keys count once, null and empty ones are ignored."""
    flagged = universe.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True)))
    h1, h2 = _hashes(F.col("key"))
    keys = flagged.where("key <> ''").select(h1.alias("h1"), h2.alias("h2"), "listed").groupBy("h1", "h2").agg(F.max("listed").alias("listed"))
    keys = work.save(keys, "keys")
    parts = max(1, -(-keys.where("listed").count() // keys_a_part))
    part = F.pmod(F.col("h1"), F.lit(parts))
    counts = {r["part"]: (r["a"], r["b"]) for r in keys.groupBy(part.alias("part")).agg(F.count_if("listed").alias("a"), F.count_if(~F.col("listed")).alias("b")).collect()}
    for i in range(parts):
        mine = keys.where(part == i)
        a, b = counts.get(i, (0, 0))
        yield parts, i, _cascade(work, mine.where("listed").select("h1", "h2"), mine.where(~F.col("listed")).select("h1", "h2"), a, b, f"part-{i}")


def _lookup(sent: Broadcast[list[Level]], parts: int, part: int) -> Callable[..., Column]:
    """Column of (h1, h2), arrays of the hashes of a row's keys: whether any key of the part is listed."""

    @F.arrow_udf("boolean")
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        at = np.asarray(a.offsets, np.int64)
        x, y = (np.asarray(v.values, np.int64)[v.offsets[0].as_py() : v.offsets[-1].as_py()] for v in (a, b))
        hit = np.zeros(len(x) + 1, np.int64)
        mine = np.flatnonzero(x % parts == part)
        hit[mine + 1] = member(sent.value, x[mine], y[mine])
        total = np.cumsum(hit)[at - at[0]]
        return pa.array(total[1:] > total[:-1])

    return found


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", keys_a_part: int = KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row.

    listed: table with a column ``key``: domains (``example.com``, its subdomains included) and pages (``example.com/a``: host and path, without query);
    hosts in lower case. rules: ``host/path`` to ``allow`` or ``block``; the longest that fits decides, else ``block`` if a key of the url is listed, else ``allow``.

    Null urls and urls without ``://`` have empty host and path, fit nothing and are allowed. Null and empty keys list nothing. Repeated rows are judged
    each; null page ids stay. Very long hosts: only as many trailing labels as the longest listed domain has are looked up. An empty table gives an empty
    result, an empty list blocks nothing. Other columns are not looked at.
    """
    work = Workspace(pages.sparkSession)
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    listed = listed.select(F.col("key").cast("string").alias("key"))
    page_key = F.col("key").contains("/")
    most, with_pages = listed.agg(F.max(F.when(~page_key, F.size(F.split("key", r"\.")))), F.coalesce(F.bool_or(page_key), F.lit(False))).first()
    keys = url_keys(F.col("host"), F.col("path"), most or 1, pages=with_pages)
    # hosts, or urls without their queries, first: a hot host costs one row a task
    universe = rows.select("host", *(["path"] if with_pages else [])).distinct().select(F.explode(keys).alias("key"))

    h1, h2 = F.transform("keys", lambda k: _hashes(k)[0]), F.transform("keys", lambda k: _hashes(k)[1])
    out = rows.withColumn("keys", keys).withColumns({"h1": h1, "h2": h2}).drop("keys").withColumn("listed", F.lit(False))
    for parts, part, levels in build(universe, listed, work, keys_a_part):
        found = _lookup(pages.sparkSession.sparkContext.broadcast(levels), parts, part)
        out = out.withColumn("listed", F.col("listed") | found("h1", "h2"))
        if parts > 1:
            # one part's bits at a time in a worker
            out = work.save(out, f"judged-{part}")
    out = out.withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rule")) if rules else F.lit(None)
    verdict = F.coalesce(by_rule, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


# ---- the registered query

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: A host is listed if one of these words stands in it between dots, hyphens and its ends.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
_LISTED = f"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"


def listed_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The query's list: all hosts of the table that hold a listed word, as domain keys."""
    return pages.select(host_path(F.col(url_col))[0].alias("key")).where(F.col("key").rlike(_LISTED)).distinct()


def oracle() -> str:
    fits = " ".join(
        f"WHEN (host = '{d}' OR host LIKE '%.{d}') AND starts_with(path, '/{p}') THEN '{r}'" for r in sorted(RULES, key=lambda r: (-len(r), r)) for d, _, p in [r.partition("/")]
    )
    by_rule = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    return f"""
    WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    ruled AS (SELECT *, CASE {fits} END AS rule FROM split),
    -- a host is listed if it or a parent domain stands in the list
    list AS (SELECT DISTINCT host AS key FROM split WHERE regexp_matches(host, '{_LISTED}')),
    hosts AS (SELECT host, EXISTS (SELECT 1 FROM list WHERE host = key OR ends_with(host, '.' || key)) AS listed FROM (SELECT DISTINCT host FROM split))
    SELECT page_id, host, path, rule, CASE rule {by_rule} ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed
    FROM ruled JOIN hosts USING (host)"""
