"""Word restaurants by the word before: closed form, bookkeeping between buckets, order of words, partitioning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import pitman_yor
from lumenfield.llm.queries import QUERIES
from lumenfield.llm.tables import Workspace

SF = "/root/testdata/sf0.001"


def scores(df, **kw):
    return {r.doc_id: r for r in pitman_yor.score(df, F.col("doc_id") < 100, **kw).collect()}


@pytest.mark.parametrize("bucket,frequent", [(1 << 24, []), (2, []), (2, [b" ", b"b", b"c"])])
def test_contexts_as_closed_form(make, monkeypatch, bucket, frequent):
    """Every pair and every word has one customer, so all seating is certain: the discounted share of a seen pair and the back-off to the word restaurant."""
    monkeypatch.setattr(pitman_yor, "BUCKET", bucket)
    monkeypatch.setattr(pitman_yor, "_frequent", lambda *args: frequent)
    asked = {101: "a", 102: "b", 103: "c", 104: "d", 105: "zz", 106: ""}
    texts = {201: "a b c d", 202: "b a", 203: "c d zz a", 204: "", 205: "zz c"}
    docs = make([(1, "a b c d"), *asked.items(), *texts.items()])
    plain, got = scores(docs), scores(docs, contexts=True)
    end = 10 ** plain[106].spelled_score
    p0 = {w: 10 ** plain[i].spelled_score / end for i, w in asked.items()} | {"": end}
    unknown = 10 ** plain[105].score / end
    seen = {("", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "")}
    d, s = 0.9, pitman_yor.CONTEXT_STRENGTH  # all pairs seen once: the largest discount
    for i, text in {**asked, **texts}.items():
        w = ["", *text.split(), ""]
        want = one = 0.0
        for u, v in zip(w[:-1], w[1:], strict=True):
            back = 1.0 if u == "zz" else (s + d) / (s + 1)
            own = (1 - d) / (s + 1) if (u, v) in seen else 0.0
            want += math.log10(own + back * p0[v])
            one += math.log10(own + back * (unknown if v == "zz" else p0[v]))
        assert got[i].spelled_score == pytest.approx(want, abs=1e-7) and got[i].score == pytest.approx(one, abs=1e-7)
        assert got[i].base_score == plain[i].base_score and got[i].n_known == plain[i].n_known


def pair_texts(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("frequent", [[], [b" ", b"w0", b"w1", b"not there"]])
def test_buckets_agree_on_tables(spark, make, frequent):
    """Over all buckets, tables of pairs by their word are the customers of the word restaurant, and by their context the totals that come back. Frequent words take those of the sweep before."""
    docs = make(pair_texts(60))
    pairs = {}
    for _, text in pair_texts(60):
        w = ["", *text.split(), ""]
        for p in zip(w[:-1], w[1:], strict=True):
            pairs[p] = pairs.get(p, 0) + 1
    assert max(pairs.values()) > 3
    work, buckets = Workspace(spark), 5
    blocks = pitman_yor._blocks(docs.repartition(3), "doc_id", "text", F.lit(True), buckets, frequent, contexts=True)
    gathered = work.save(pitman_yor._grouped(blocks, pitman_yor._gather(buckets, frequent, contexts=True)), "gathered", by="kind")
    model = pitman_yor.Model(work, gathered, frequent, contexts=True)
    assert (model.train_tokens, model.customers) == (sum(pairs.values()), len(pairs))
    for i in (1, 2):
        before = model.often_next
        model.sweep(i, keep=True)
        states = [dict(zip(pitman_yor._STATE, pitman_yor.unpack(r.data), strict=True)) for r in model.state.collect()]
        for s in states:
            own = (s["alone"] + np.bincount(s["pair_word"], s["pair_t"], minlength=len(s["c"]))[: len(s["c"])]).astype(int)
            own[s["often_at"]] = before[s["often"]]
            assert (s["customers"] == own).all()
            assert ((s["pair_t"] >= 1) & (s["pair_t"] <= s["pair_c"])).all() and (s["t"] <= s["customers"]).all()
        assert len(states) > 1 and sum(s["pair_c"].sum() + s["alone"].sum() + s["often_alone"].sum() for s in states) == sum(pairs.values())
        totals = sum(int(pitman_yor.unpack(r.data)[0].sum()) for r in model.kept[-1].collect())
        assert model.customers == sum(int(s["customers"].sum()) for s in states)
        assert totals == model.customers + int((model.often_next - before).sum())
        home = {frequent[k]: (int(s["customers"][a]), int(s["t"][a])) for s in states for a, k in zip(s["often_at"], s["often"], strict=True)}
        assert home == {w: (int(n), int(t)) for w, n, t in zip(frequent, model.often, model.often_t, strict=True) if n}


def test_shuffled_texts_score_lower(make):
    rng = random.Random(8)
    lines = ["the cat sat on the mat", "a dog ran to the old house", "we read the long book at home"]
    train = [(i, " ".join(rng.choice(lines) for _ in range(3))) for i in range(40)]
    other = [(100 + i, t) for i, t in enumerate(lines)]
    mixed = [(200 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in enumerate(lines)]
    docs = make(train + other + mixed)
    got, plain = scores(docs, contexts=True), scores(docs)
    for i in range(3):
        assert got[100 + i].spelled_score > got[200 + i].spelled_score + 1
        assert plain[100 + i].spelled_score == pytest.approx(plain[200 + i].spelled_score)


def test_scores_do_not_follow_the_partitioning(make, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET", 4000)
    monkeypatch.setattr(pitman_yor, "SAMPLE_OF", 1)
    docs = make(pair_texts(150) + [(150, None), (151, "unheard of"), (152, "")])
    cols = ("doc_id", "n_tokens", "n_known", "base_score", "score", "spelled_score", "spelled_unknown")
    one, seven = ({tuple(r[c] for c in cols) for r in pitman_yor.score(docs.repartition(n, "doc_id"), F.col("doc_id") < 100, contexts=True).collect()} for n in (1, 7))
    assert one == seven and len(one) == 153


def test_query_scores_texts_in_the_order_of_their_words(spark):
    got = QUERIES["op8_pitman_yor"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) < sum(r.one_unknown_score for r in held)
    assert sum(r.one_unknown_score for r in held) > sum(r.base_score for r in held)


def test_contexts_edges(edges, nothing):
    got = pitman_yor.score(edges, F.col("doc_id") % 2 == 0, contexts=True).collect()
    assert len(got) == 10 and all(math.isfinite(r.spelled_score) for r in got)
    assert pitman_yor.score(nothing, F.lit(True), contexts=True).count() == 0
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in pitman_yor.score(edges, F.lit(False), contexts=True).collect())


def test_packed_numbers_come_back():
    for a in ([], [0], [255, 256, 3], [-1, 2**62, 5], np.array([2**64 - 1, 7], np.uint64).view(np.int64)):
        one, two = pitman_yor.unpack(pitman_yor.pack(np.array(a, np.int64), np.arange(3)))
        assert one.tolist() == list(a) and two.tolist() == [0, 1, 2]


def test_frequent_words_are_found(spark, make, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SAMPLE_OF", 1)
    words = lambda n: pitman_yor._frequent(Workspace(spark), make([(i, "The cat\tand  the dog\x0band the x%d" % i) for i in range(50)] + [(60, None)]).select("text"), "text", n)
    assert words(1) == [] and words(3) == [b"and", b"the"] and words(5) == [b" ", b"and", b"cat", b"dog", b"the"]
