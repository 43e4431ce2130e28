"""A corpus pipeline: quality rules, near-duplicate removal, redaction, source mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet in the
shared folder and read again as the next stage's docs, so a lost executor costs one stage at most.
All stages but the last return the columns of documents, others that the table has included, whatever
their names. The stages with Python do that part before they return, in small Arrow batches: with
Spark's 10,000 rows of whole texts in each task, executors outgrow their memory.

Defined results, for every stage: an empty table gives an empty one; rows without text go in the first
stage (too few words); rows without doc_id or source are rows like others (without doc_id they are no
copies of anything); repeated rows are near copies, of which one stays; ties fall to the smallest
doc_id; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import small_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    from lexmill.llm.quality import filter_quality

    return filter_quality(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    from lexmill.llm.jaccard import keep_one

    with small_batches(spark):
        return keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to the names of their kinds."""
    from lexmill.llm.pii import redact

    with small_batches(spark):
        return written(redact(docs), "redacted")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    from lexmill.llm.mixing import mix

    return mix(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document: doc_id, n_tokens, ids, round_trip."""
    from lexmill.llm.spm import encode

    with small_batches(spark):
        return written(encode(docs), "encoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("encode_text", encode_text),
]

#: The component search, the rounding and the encoding are not expressible in SQL; tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
