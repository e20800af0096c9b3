"""The pipeline against plain versions of its stages, and its edges."""

import hashlib

import pytest

import corpus_pipeline
from lumenfield.llm import personal_data
from tests.llm.test_texts import brute_components, reference_encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        docs = spark.createDataFrame(made.toPandas(), made.schema)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_language_keeps_clean_documents(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert set(after) <= set(before) and len(after) >= 0.99 * len(before)


def test_one_of_each_group_stays(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert set(after) == {i for i, (_, c) in brute_components(sorted(before.items())).items() if i == c}


def test_personal_data_is_gone(steps):
    before, after = texts(steps[2]), texts(steps[3])
    assert set(before) == set(after)
    for i, t in before.items():
        base = personal_data.base_spans(t)
        assert (t == after[i]) == (not base) or "[" in after[i]
        assert all(t[a:b] not in after[i] for _, a, b in base if b - a > 7)


def test_mixing_takes_documents_once(steps):
    before, after = texts(steps[3]), steps[4].collect()
    assert len(after) == len({r.doc_id for r in after}) and all(before[r.doc_id] == r.text for r in after)


def test_tokens(steps):
    plain, before = reference_encoder(), texts(steps[4])
    got = steps[5].collect()
    assert len(got) == len(before)
    for r in got:
        assert list(r.tokens) == plain.encode_ordinary(before[r.doc_id]) and r.exact
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


def test_edges_go_through(spark, tmp_path):
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (None, "the and of in to the and", "en", "s", 1), (3, "the cat and the dog in the house", "en", "s", 9), (3, "the cat and the dog in the house", "en", "s", 9), (4, "123", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d, name in ((docs, "some"), (docs.limit(0), "none")):
        docs = d
        spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{step}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{step}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert sorted(ids, key=str) == ([3, None] if name == "some" else [])
