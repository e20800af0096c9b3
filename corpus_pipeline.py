"""Corpus pipeline: language ID, near-duplicates, personal data, mixing, tokenisation. Each stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import byte_bpe, language, mixing, near_duplicates, personal_data
from lumenfield.llm.queries import MIXTURE
from lumenfield.llm.tables import TEXT_BYTES, Workspace, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: From so many letters on a text can be judged; it is rejected when even the nearest language is farther than this cosine.
ENOUGH_LETTERS, LEAST_SCORE = 40, 0.1


def _rows(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The carried rows with the columns of ``docs``."""
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; ``lang`` becomes the recognised one. Texts without letters go, as do texts with enough letters that resemble no language."""
    found = language.predict(docs, language.learn(docs.where(~language.held_out())), carry=True)
    kept = found.where((F.col("lang_pred") != "und") & ((F.col("n_letters") < ENOUGH_LETTERS) | (F.col("score") >= LEAST_SCORE)))
    return kept.select(*[(F.col("lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one of the smallest id; documents without an id stay."""
    kept = near_duplicates.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    # one row of each id that stays: both steps use the same partitioning by id
    one = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.union(docs.where("doc_id is null"))


def personal_data_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; ``n_chars`` follows the text. Every document stays."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = personal_data.find(docs, personal_data.learn(docs), keep_text=True, carry=rest)
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def domain_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its rate says, at most once, so that the domains' tokens approach the mixture."""
    rates = mixing.mix(docs, table(spark, sf_dir, "labels"), MIXTURE, max_rate=1.0, carry=True)
    return _rows(rates.where("copies > 0"), docs)


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the proof that they decode to its text."""
    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=["lang", "source", "n_chars"])
    return coded.select("doc_id", "row.lang", "row.source", "row.n_chars", "n_tokens", "tokens", "ids_sha256", "decoded_sha256", "exact")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_texts),
    ("personal_data", personal_data_masking),
    ("mixing", domain_mixing),
    ("tokenisation", tokenisation),
]

#: No stage but the patterns of the third can be stated in SQL; tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, TEXT_BYTES)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
