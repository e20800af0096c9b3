"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import byte_bpe, filter_audit, hard_negatives, language, licences, mixing, near_duplicates, neighbours, personal_data, pitman_yor, sharding, top_k, url_cascade
from lumenfield.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op6_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.learn(docs.where(~language.held_out()))
    return language.predict(docs, prototypes).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.find(docs, personal_data.learn(docs)).drop("masked")


@query
def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"), 40)


@query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


#: Domains' shares of the tokens after mixing.
MIXTURE = {"good": 0.9, "low": 0.1, "toxic": 0.0}


@query
def op4_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIXTURE, max_rate=1.0)


@query
def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))[0]


@query
def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    # score is the probability of the text itself; the one that counts all unknown words as one outcome only compares with base_score
    scored = pitman_yor.score(table(spark, sf_dir, "documents"), train, contexts=True).withColumnRenamed("score", "one_unknown_score").withColumnRenamed("spelled_score", "score")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "one_unknown_score", "spelled_unknown")


@query
def op2_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


ORACLE["op2_licence_digests"] = licences.oracle()


@query
def op11_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_cascade.judge(pages, url_cascade.listed_hosts(pages), url_cascade.RULES)


ORACLE["op11_bloom_cascade"] = url_cascade.oracle()


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


ORACLE["op12_filter_audit"] = filter_audit.oracle()


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


ORACLE["op13_hard_negatives"] = hard_negatives.oracle()
