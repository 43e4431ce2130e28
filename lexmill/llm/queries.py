"""The registered queries of the training-data operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import oracles
from lexmill.llm.common import table


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("class_links")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.neighbours import search

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(vectors, vectors.where(F.col("id") % 20 == 0))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_jsd", "share_jsd", "word_jsd")})


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.spm import encode

    return encode(table(spark, sf_dir, "documents"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents")).drop("found")


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.chat import chat_windows, read_back

    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(chat_windows(convs.unionByName(planted)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_main_text": op1_html_main_text,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_language_id": op3_language_id,
    "op4_source_mix": op4_source_mix,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_pii_spans": op9_pii_spans,
    "op10_chat_windows": op10_chat_windows,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": oracles.op2(),
    "op7_quality_rules": oracles.op7(),
    "op10_chat_windows": oracles.op10(),
}
