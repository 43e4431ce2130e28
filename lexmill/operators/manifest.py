"""Build records and the checks of a store against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA_VERSION, ZIPF_CEILING = 2, 7.5
BUILD = "component string, version int, commit string, run_at timestamp, row_counts map<string,bigint>"


def latest(builds: DataFrame) -> DataFrame:
    """The newest build of each component; builds of the same time are all kept."""
    rank = F.rank().over(Window.partitionBy("component").orderBy(F.desc("run_at")))
    return builds.withColumn("place", rank).where("place = 1").drop("place")


def checks(builds: DataFrame, frequency: DataFrame, drift: DataFrame, tables: list[str]) -> DataFrame:
    """check, failed, detail: version, coverage of tables, the Zipf scale and complete drift columns."""
    now = latest(builds)
    version = now.agg(F.count_if(F.col("version") != SCHEMA_VERSION).alias("n"), F.count("*").alias("all")).select(F.lit("schema_version").alias("check"), ((F.col("n") > 0) | (F.col("all") == 0)).alias("failed"), F.col("n").cast("string").alias("detail"))
    listed = now.select(F.explode(F.map_keys("row_counts")).alias("t")).agg(F.collect_set("t").alias("seen"))
    lost = F.array_except(F.array(*[F.lit(t) for t in tables]), "seen")
    coverage = listed.select(F.lit("manifest_coverage").alias("check"), (F.size(lost) > 0).alias("failed"), F.array_join(F.array_sort(lost), ",").alias("detail"))
    scale = frequency.agg(F.max("zipf").alias("z")).select(F.lit("zipf_scale").alias("check"), F.coalesce(F.col("z") > ZIPF_CEILING, F.lit(False)).alias("failed"), F.col("z").cast("string").alias("detail"))
    half = F.count_if(F.col("drift_ci_lo").isNotNull() & F.col("drift_score_boot").isNull())
    columns = drift.agg(half.alias("n")).select(F.lit("drift_columns").alias("check"), (F.col("n") > 0).alias("failed"), F.col("n").cast("string").alias("detail"))
    return version.unionByName(coverage).unionByName(scale).unionByName(columns)


def store_checks(predicted: DataFrame, lemmas: DataFrame) -> DataFrame:
    """check, failed, detail: classifier scores are probabilities, and words that only an accent tells apart are lemmas of their own.

    A lexicon keyed on the folded word would have one lemma for each key and part of speech, whatever
    the accents of its forms say: lemmas(lemma, normalized_lemma, pos, forms) has in forms the
    accented spellings known of each key.
    """
    odd = F.count_if((F.col("source") == "classifier") & ~F.coalesce(F.col("score").between(0, 1), F.lit(False)))
    floor = predicted.agg(odd.alias("n")).select(F.lit("classifier_floor").alias("check"), (F.col("n") > 0).alias("failed"), F.col("n").cast("string").alias("detail"))
    own = lemmas.groupBy("normalized_lemma", "pos").agg(F.collect_set("lemma").alias("own"), F.flatten(F.collect_list("forms")).alias("known"))
    lost = F.array_except(F.array_distinct("known"), "own")
    missing = own.select(F.explode(lost).alias("lemma")).agg(F.array_join(F.array_sort(F.collect_set("lemma")), ",").alias("detail"))
    identity = missing.select(F.lit("lemma_identity").alias("check"), (F.col("detail") != "").alias("failed"), "detail")
    return floor.unionByName(identity)


def status(found: DataFrame, builds: DataFrame) -> DataFrame:
    """ok, n_failed, failed (names), components: the state of a store by its checks and newest builds."""
    a = found.agg(F.count_if("failed").alias("n_failed"), F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("check")))).alias("failed"))
    b = latest(builds).agg(F.array_sort(F.collect_set("component")).alias("components"), F.max("run_at").alias("last_build"))
    return a.join(b).select((F.col("n_failed") == 0).alias("ok"), "n_failed", "failed", "components", "last_build")  # one row each


def fingerprint(rows: DataFrame) -> DataFrame:
    """rows and digest of a table: the same for the same rows in any order and partitioning."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    low = F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string")
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), low, F.coalesce(F.bit_xor(h), F.lit(0)).cast("string")), 256).alias("digest"))
