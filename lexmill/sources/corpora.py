"""Readers of dated corpora and word lists, and the replacing writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of corpus folders and the corpus each belongs to.
LABELS = {"ell_news": "news", "ell_newscrawl": "news", "ell_wikipedia": "wiki", "ell-eu_web": "web", "ell_web": "web", "ell_mixed": "mixed", "ell_literature": "literature"}
STRIP = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.split("value", "\t").alias("f"))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """sentence from lines "id TAB sentence"; a line without a tab is a sentence."""
    text = F.btrim(F.regexp_replace("value", r"^[^\t]*\t", ""), F.lit(STRIP))
    return spark.read.text(path).select(text.alias("sentence")).where("sentence != ''")


def words(spark: SparkSession, path: str) -> DataFrame:
    """word_id, word, freq; lines with fewer than three fields or without a number are left out."""
    rows = _fields(spark, path).where(F.size("f") >= 3)
    return rows.select(F.get("f", F.lit(0)).alias("word_id"), F.get("f", F.lit(1)).alias("word"), F.get("f", F.lit(2)).try_cast("bigint").alias("freq")).where("freq is not null")


def cooccurrences(spark: SparkSession, path: str) -> DataFrame:
    """w1, w2, freq, significance; lines with fewer than four fields or without a number are left out."""
    rows = _fields(spark, path).where(F.size("f") >= 4)
    at = lambda i: F.get("f", F.lit(i))
    return rows.select(at(0).alias("w1"), at(1).alias("w2"), at(2).try_cast("bigint").alias("freq"), at(3).try_cast("double").alias("significance")).where("significance is not null")


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """word, count of lines "word count" with a count above 0."""
    f = F.split(F.btrim("value"), r"\s+")
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("word"), F.get(f, F.lit(1)).try_cast("bigint").alias("count")).where("count > 0")


def year_of(text: Column) -> Column:
    """The first year 1900 to 2099 among four-digit runs that stand alone; a delimiter belongs to one run only."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)"), F.lit(1))
    years = F.filter(F.transform(runs, lambda y: y.cast("int")), lambda y: y.between(1900, 2099))
    return F.get(years, F.lit(0))


def corpus_of(folder: Column) -> Column:
    """The corpus of a folder named source_year_size: its label, or the source without its language prefix."""
    source = F.regexp_extract(folder, r"([^/\\]+?)_[0-9]{4}(?:_[^/\\]*)?[/\\]?$", 1)
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.when(source != "", F.coalesce(F.try_element_at(label, source), F.regexp_replace(source, "^ell[-_]", "")))


def speeches(spark: SparkSession, path: str, text: str = "speech", date: str = "sitting_date") -> DataFrame:
    """text, year from a CSV file with a header; rows without text or year are left out, a missing column is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    if lost := {text, date} - set(rows.columns):
        raise ValueError(f"the file has no column {', '.join(sorted(lost))}")
    kept = rows.select(F.btrim(text, F.lit(STRIP)).alias("text"), year_of(F.col(date)).alias("year"))
    return kept.where("text != '' and year is not null")


def one_corpus(folders: DataFrame, chosen: str | None = None) -> DataFrame:
    """folders(path) of one corpus; several without a choice are refused, for series of corpora are never pooled."""
    named = folders.withColumn("corpus", corpus_of(F.col("path"))).withColumn("year", year_of(F.regexp_extract("path", r"([^/\\]+)[/\\]?$", 1)))
    if chosen:
        return named.where(F.col("corpus") == chosen)
    found = [r[0] for r in named.select("corpus").distinct().limit(20).collect()]
    if len(found) > 1:
        raise ValueError(f"several corpora, choose one: {sorted(map(str, found))}")
    return named


def replace_partition(df: DataFrame, path: str, by: list[str]) -> None:
    """Write df so that the partitions it has rows for are replaced and the others stay: running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def word_ids(rows: DataFrame) -> DataFrame:
    """word_id and word of words() rows with their line number `line`: the last line of an id holds."""
    return rows.groupBy("word_id").agg(F.max_by("word", "line").alias("word"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """word_id, word, line of a word file; lines with fewer than two fields are left out. Lines are numbered within a file."""
    rows = _fields(spark, path).withColumn("line", F.monotonically_increasing_id())
    return rows.where(F.size("f") >= 2).select(F.get("f", F.lit(0)).alias("word_id"), F.get("f", F.lit(1)).alias("word"), "line")


def folders(spark: SparkSession, root: str, chosen: str | None = None, ending: str = "-sentences.txt") -> DataFrame:
    """path, source, corpus, year of the dated corpus folders under root that hold a file with the ending; chosen is a source or a corpus.

    The names come from a listing of the store, which holds a few files for each folder.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = base.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(base, f"*/*{ending}"))
    paths = sorted({f.getPath().getParent().toString() for f in found or []})
    named = spark.createDataFrame([(p,) for p in paths], "path string")
    named = named.withColumn("source", F.regexp_extract("path", r"([^/\\]+?)_[0-9]{4}(?:_[^/\\]*)?$", 1)).withColumn("corpus", corpus_of(F.col("path")))
    named = named.withColumn("year", year_of(F.regexp_extract("path", r"([^/\\]+)$", 1))).where("year is not null")
    return named if chosen is None else named.where((F.col("source") == chosen) | (F.col("corpus") == chosen))


def available(named: DataFrame) -> DataFrame:
    """corpus and its sorted years, of folders()."""
    return named.where("corpus is not null").groupBy("corpus").agg(F.array_sort(F.collect_list("year")).alias("years"))


def slices(spark: SparkSession, root: str) -> DataFrame:
    """corpus, year, tokens of the slice files <corpus>/<year>.txt under root: a line is a sentence of tokens."""
    rows = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(root)
    path = F.col("_metadata.file_path")
    named = rows.select(F.regexp_extract(path, r"([^/]+)/[0-9]{4}\.txt$", 1).alias("corpus"), F.regexp_extract(path, r"/([0-9]{4})\.txt$", 1).try_cast("int").alias("year"), "value")
    return named.where("year is not null and btrim(value) != ''").select("corpus", "year", F.split(F.btrim("value"), " +").alias("tokens"))
