"""Operators on texts against brute force, known answers and edge cases."""

import base64
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import byte_bpe, language, licences, mixing, near_duplicates, personal_data, pitman_yor, sharding
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# --- near-duplicates


def brute_components(docs, k=5, percent=75):
    sets = {}
    for i, t in docs:
        w = word_list(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, groups, size):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, size)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("seed,groups,size", [(1, 40, 6), (2, 2, 90)])
def test_near_duplicates_as_brute_force(make, seed, groups, size):
    docs = near_copies(seed, groups, size)
    want = brute_components(docs)
    got = near_duplicates.near_duplicates(make(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(edges, nothing):
    got = rows(near_duplicates.near_duplicates(edges), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 1, None, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True), (8, 1, 8, True)], key=str
    )
    assert near_duplicates.near_duplicates(nothing).count() == 0


# --- language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predict(docs, language.learn(docs.where(~language.held_out()))).withColumn("h", language.held_out())
    joined = found.join(docs.select("doc_id", "lang"), "doc_id").where("h").collect()
    assert len(joined) > 100
    assert sum(r.lang == r.lang_pred for r in joined) / len(joined) > 0.98
    assert all(0 <= r.score <= 1 for r in joined)


def test_language_edges(make, edges, nothing):
    known = make([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "ignored", None)])
    prototypes = language.learn(known)
    assert sorted(prototypes) == ["de", "en"]
    got = {r.doc_id: r for r in language.predict(make([(1, None), (2, ""), (3, "123 ... \n"), (4, "The Dog"), (5, "und die"), (6, "日本語のテキスト")]), prototypes).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert got[1].score == 0 and got[6].lang_pred in ("de", "en")
    assert language.predict(edges, prototypes).count() == len(EDGES)
    assert language.predict(nothing, prototypes).count() == 0
    assert language.learn(nothing) == {}
    assert {r.lang_pred for r in language.predict(edges, {}).collect()} == {"und"}


def test_language_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = language.learn(docs.repartition(7)), language.learn(docs.coalesce(1))
    assert sorted(a) == sorted(b) and all((a[k] == b[k]).all() for k in a)


# --- byte-level BPE


def reference_encoder(pattern=PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_same_ids_and_round_trip(spark, make):
    odd = ["", " a", "aaaaaaaa" * 50, "   \n\n  x  ", "你好世界" * 5, "1234567890 12", "'s't're I'LL", "😀 é", "!!!??", "x" * 3001, "\x00\x01", "end ", "a  b\tc \n d", "<|endoftext|>", "  x y"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = reference_encoder()
    coded = byte_bpe.encode(docs, RANKS, PATTERN, keep_bytes=True)
    for r in coded.collect():
        want = plain.encode_ordinary(texts[r.doc_id])
        assert r.tokens == want and r.n_tokens == len(want) and r.exact
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert bytes(r.decoded) == texts[r.doc_id].encode() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.text for r in byte_bpe.decode(coded, RANKS, PATTERN).collect()} == texts


def test_bpe_pieces_of_any_signs():
    rng = np.random.default_rng(11)
    coder, library = byte_bpe.Encoder(RANKS, PATTERN), reference_encoder()
    signs = ["\0", " ", "\t", "\n", "\x1f", "\x7f", "a", "b's", "'s", "'ll", "7", "é", "\u2028", "\u00a0", "\ufeff", "😀", "-", "\0x", " \0"]
    texts = ["a \0b", "a \0", "a's \0x", "\0", " \0", "\0 \0 \0"] + ["".join(rng.choice(signs, rng.integers(0, 14)).tolist()) for _ in range(4000)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_other_patterns_are_not_cut_at_spaces():
    pattern = r"\S+ \S+|\s+|\S+"
    texts = ["one two three", "a b", "x  y z"]
    for text, ids in zip(texts, byte_bpe.Encoder(RANKS, pattern).encode(texts), strict=True):
        assert ids.tolist() == reference_encoder(pattern).encode_ordinary(text)


def test_bpe_edges(edges, nothing):
    got = byte_bpe.encode(edges, RANKS, PATTERN, keep_ids=False).collect()
    assert len(got) == len(EDGES) and all(r.exact for r in got)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256) for r in got if r.doc_id in (1, 2)] == [(0, empty)] * 2
    assert byte_bpe.encode(nothing, RANKS, PATTERN).count() == 0


# --- personal data

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (16 <= len(d) <= 19 and luhn)) or (k == 3 and not 8 <= len(d) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_as_plain_patterns(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = random.Random(4)
    texts += ["".join(rng.choice("a1.@+- ()%9é٣") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 2", "1" * 50, "300.1.1.1 1.1.1.1", "007.1.2.3"]
    for t in texts:
        assert personal_data.base_spans(t) == plain_spans(t), t


def test_field_learns_the_patterns_and_keeps_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0")
    weights = personal_data.learn(docs)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    right = wanted = found = 0
    for t in texts:
        base = plain_spans(t)
        alone = set(personal_data.all_spans(t, [], weights))
        right, wanted, found = right + len(alone & set(base)), wanted + len(base), found + len(alone)
        assert set(base) <= set(personal_data.all_spans(t, base, weights))
    assert right >= 0.95 * wanted and right >= 0.9 * found


def best_by_enumeration(cands, n, scores):
    """Greatest score over all sets of candidates that do not overlap."""
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        best[j] = max([best[j - 1], *(best[i] + scores[k].max() for k, (i, e, _) in enumerate(cands) if e == j)])
    return best[n]


def test_segments_are_the_best_division():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(30):
        text = "".join(rng.choice(list("ab12.@ +-")) for _ in range(40)) + "1234"
        cands, starts = personal_data.candidates(text, 0, len(text))
        weights = rng.normal(size=(personal_data.N_FEATURES, 4))
        scores = personal_data._matrix(cands) @ weights
        chosen = personal_data.best_segments(cands, len(starts) - 1, weights)
        place = {(i, j): k for k, (i, j, _) in enumerate(cands)}
        assert sum(scores[place[i, j], kind] for kind, i, j in chosen) == pytest.approx(best_by_enumeration(cands, len(starts) - 1, scores))
        assert all(a[2] <= b[1] for a, b in zip(chosen, chosen[1:], strict=False))


def test_personal_data_edges(make, edges, nothing):
    weights = personal_data.learn(nothing)
    assert not weights.any()
    got = {r.doc_id: r for r in personal_data.find(make([(1, None), (2, "é a@b.co x"), (3, "")]), weights, keep_text=True).collect()}
    assert (got[1].n_email, got[1].spans, got[1].masked) == (0, "", None)
    assert (got[2].n_email, got[2].spans, got[2].masked) == (1, "email:2:8", "é [EMAIL] x")
    assert got[2].base_sha256 == hashlib.sha256(b"email:2:8").hexdigest() and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert personal_data.find(edges, weights).count() == len(EDGES)
    assert personal_data.find(nothing, weights).count() == 0


# --- sharding


def test_shards(spark, edges, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_table(docs, 40).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and 0 <= r.shard < 40
        assert r.grown_shard in (r.shard, 40)
    assert any(r.grown_shard == 40 for r in got)
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_table(nothing, 40).count() == 0
    got = sharding.shard_table(edges, 40).collect()
    assert len(got) == len(EDGES) and len({r.shard for r in got if r.doc_id == 5}) == 1
    assert [(r.size, r.text_crc32) for r in got if r.doc_id == 1] == [(16, 0)]


def test_movement_stays_where_weights_change(spark):
    ids = spark.range(20000)
    key = F.col("id").cast("string")
    tree = sharding.layout(16)
    heavier = [s if s.shard != 3 else sharding.Shard(s.region, s.rack, s.shard, 2.0) for s in tree]
    both = sharding.place(sharding.place(ids, key, tree, "a"), key, heavier, "b").collect()
    at = {s.shard: (s.region, s.rack) for s in tree}
    moved = [r for r in both if r.a != r.b]
    assert moved and all(at[r.b] == at[3] or at[r.b][0] == at[3][0] for r in moved)
    counts = Counter(r.b for r in both)
    assert 1.6 < counts[3] / (sum(counts[i] for i in range(16) if i != 3) / 15) < 2.4


# --- licences


def test_licence_variants(make, nothing):
    mit = licences.KNOWN["MIT"]
    docs = make([(1, "Copyright (c) 2020 X\nAll rights reserved.\n" + mit.upper().replace('"', "“")), (2, mit + " and more"), (3, None), (4, ""), (5, "licenced under the APACHE Licence, version 2.0"), (6, "Copyright 1999")])
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [got[i].licence for i in range(1, 7)] == ["MIT", None, None, None, "Apache-2.0-notice", None]
    assert got[1].n_copyright == 2 and got[3].digest is None and got[4].digest == got[6].digest
    assert licences.scan(nothing).count() == 0


# --- mixing


def test_mixing_reaches_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels, {"good": 0.6, "low": 0.4}).collect()
    reached = [sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS]
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    assert reached[0] / sum(reached) == pytest.approx(0.6, abs=0.04) and reached[2] < 0.05 * sum(reached)


def test_classifier_held_out_accuracy(spark):
    both = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    known = both.withColumn("domain", mixing.domain_of(F.col("quality"), F.col("toxic"))).orderBy("doc_id").collect()
    import numpy as np

    half = len(known) // 2
    weights = mixing.fit_classifier([r.text for r in known[:half]], np.array([r.domain for r in known[:half]]))
    rest = spark.createDataFrame([(r.doc_id, r.text, r.domain) for r in known[half:]], "doc_id long, text string, domain int")
    p = {r.doc_id: list(r.p) for r in mixing.posteriors(rest, weights).collect()}
    assert sum(max(range(3), key=p[r.doc_id].__getitem__) == r.domain for r in known[half:]) > 0.95 * (len(known) - half)


def test_mixing_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(edges, labels, {"good": 1.0}).count() == len(EDGES)
    assert mixing.mix(nothing, labels, {"good": 1.0}).count() == 0
    assert {(r.p_good, r.rate) for r in mixing.mix(edges.limit(2), labels.limit(0), {"good": 1.0}).collect()} == {(round(1 / 3, 9), 1.0)}


# --- language-model scores


def test_scores_base_and_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r.doc_id: r for r in pitman_yor.score(docs, train).collect()}
    tokens = {r.doc_id: [*word_list(r.text), " "] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    assert sum(got[i].score for i in got if held[i]) > sum(got[i].base_score for i in got if held[i])


def test_outcomes_sum_to_one(spark, make):
    """Known words and the unknown one are all outcomes: their probabilities add up to 1."""
    train = [(i, t) for i, t in enumerate(["a b a b c", "a a d", "b b e f"])]
    asked = [(100 + i, w) for i, w in enumerate(["a", "b", "c", "d", "e", "f", "zzz", ""])]
    got = {r.doc_id: r.score for r in pitman_yor.score(make(train + asked), F.col("doc_id") < 100).collect()}
    end = got[107]
    assert sum(10 ** (got[100 + i] - end) for i in range(7)) + 10**end == pytest.approx(1, abs=1e-9)


def test_unknown_words_are_scored_by_spelling(make):
    """Unknown words differ by their letters, and rank below known words; the known ones are scored alike in both columns."""
    train = [(i, t) for i, t in enumerate(["banana bandana", "banana cabana", "bandana banana ban"])]
    asked = [(100, "banana"), (101, "banan"), (102, "qxzjkwvq"), (103, "")]
    got = {r.doc_id: r for r in pitman_yor.score(make(train + asked), F.col("doc_id") < 100).collect()}
    assert got[100].spelled_score == pytest.approx(got[100].score) and got[100].spelled_unknown == got[103].spelled_unknown == 0
    assert got[101].score == pytest.approx(got[102].score)
    assert got[100].spelled_score > got[101].spelled_score > got[102].spelled_score
    assert got[102].spelled_unknown == pytest.approx(got[102].spelled_score - got[103].spelled_score)


def test_tables_follow_the_exact_conditional():
    """Three customers, one other table: the share of each number of tables against the closed form."""
    import numpy as np

    d, a, p, n = 0.5, 1.0, 0.3, 60000
    t = pitman_yor.draw_tables(np.full(n, 3), np.full(n, p), np.full(n, 1), d, a, np.random.default_rng(5))
    s = [(1 - d) * (2 - d), 3 * (1 - d), 1.0]
    w = np.array([s[k] * np.prod([(a + d * (1 + j)) * p for j in range(k + 1)]) for k in range(3)])
    assert np.bincount(t, minlength=4)[1:] / n == pytest.approx(w / w.sum(), abs=0.01)


def test_scores_edges(edges, nothing):
    got = pitman_yor.score(edges, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == len(EDGES) and all(math.isfinite(r.score) for r in got)
    assert {(r.n_tokens, r.held_out) for r in got if r.doc_id is None} == {(6, True)}
    assert pitman_yor.score(nothing, F.lit(True)).count() == 0
    assert json.dumps(sorted(r.n_tokens for r in got)) == json.dumps([1, 1, 1, 2, 2, 6, 6, 6, 6, 60001])


def test_personal_data_batches_are_no_larger_than_those_of_other_steps(spark):
    from lumenfield.llm import personal_data, tables

    docs = spark.createDataFrame([(1, "call +31 20 123 4567")], "doc_id long, text string")
    personal_data.find(docs, personal_data.train([]), keep_text=True)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= int(tables.ARROW_BYTES)


def test_texts_go_to_python_in_small_batches_whatever_was_set_before(spark):
    from lumenfield.llm import language, near_duplicates, tables

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "een twee drie vier vijf zes", "nl")], "doc_id long, text string, lang string")
    for step in (lambda: language.learn(docs), lambda: language.predict(docs, {}), lambda: near_duplicates.near_duplicates(docs)):
        spark.conf.set(size, str(64 << 20))
        step()
        assert spark.conf.get(size) == tables.TEXT_BYTES


def test_language_vectors_take_a_byte_each_and_are_widened_in_parts(monkeypatch):
    from lumenfield.llm.language import Profiler

    rng = np.random.default_rng(5)
    texts = ["".join(chr(c) for c in rng.integers(0x4E00, 0x4E00 + 900, 300)) for _ in range(9)]
    whole, count = Profiler().bundle(texts)
    monkeypatch.setattr(Profiler, "PART", 64)
    small = Profiler()
    assert small.table.nbytes <= small.CACHE * 1024
    parts, again = small.bundle(texts)
    assert (parts == whole).all() and (again == count).all() and len(small.grams) > 64


def test_tokens_get_small_batches_and_rates_need_one_python_worker(spark):
    from lumenfield.llm import tables

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, f"een twee {i} drie vier") for i in range(9)], "doc_id long, text string")
    spark.conf.set(size, str(64 << 20))
    byte_bpe.encode(docs, RANKS, PATTERN)
    assert spark.conf.get(size) == tables.TEXT_BYTES
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    whole = mixing.mix(docs, labels, {"good": 0.6, "low": 0.4}, carry=True)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    cols = ("doc_id", "n_tokens", "p_good", "p_low", "p_toxic", "rate", "copies")
    assert rows(whole, *cols) == rows(mixing.mix(docs, labels, {"good": 0.6, "low": 0.4}), *cols)
