"""Collocations, example sentences, the query log's gaps, and bands of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import tokens


def collocations(rows: DataFrame, least: int, top: int, text: str = "text") -> DataFrame:
    """word, collocate, n, score, place: the best right neighbours of each word; pairs are formed inside the token array, without a join."""
    t = tokens(F.col(text))
    pairs = rows.select(t.alias("t")).select(F.explode(F.expr("transform(slice(t, 1, greatest(size(t) - 1, 0)), (w, i) -> struct(w AS word, t[i + 1] AS collocate))")).alias("p"))
    counted = pairs.select("p.*").where("word != collocate").groupBy("word", "collocate").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    singles = rows.select(F.explode(t).alias("token")).groupBy("token").agg(F.count("*").alias("count")).withColumn("total", F.sum("count").over(Window.partitionBy()))
    x, y = singles.select(F.col("token").alias("word"), F.col("count").alias("nx"), "total"), singles.select(F.col("token").alias("collocate"), F.col("count").alias("ny"))
    score = F.col("n") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny").cast("double")))
    scored = counted.join(x, "word").join(y, "collocate").withColumn("score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "collocate"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select("word", "collocate", "n", "score", "place")


def examples(docs: DataFrame, by: str, top: int) -> DataFrame:
    """by, sentence, score, place: well-formed sentences nearest to 14 words. A text without a sentence end has none.

    Stretches without an end are read whole and left out: looking for an end from each of their letters takes the square of their length.
    """
    raw = docs.select(by, F.explode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]++[.!?]?"), F.lit(0))).alias("raw")).where(F.substring("raw", -1, 1).isin(".", "!", "?"))
    s = raw.select(by, F.btrim("raw", F.lit(" \t\n\r")).alias("sentence")).withColumn("n", F.size(F.split("sentence", r"\s+")))
    digits = F.length(F.regexp_replace("sentence", "[^0-9]", ""))
    good = F.col("n").between(6, 28) & F.col("sentence").rlike(r"^\p{Lu}") & ~F.col("sentence").rlike(r"https?://|www\.|@") & (digits <= 0.15 * F.length("sentence"))
    score = (-F.abs(F.col("n") - 14) + F.when(F.col("sentence").endswith("."), 0.5).otherwise(0.0)).cast("double")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.length("sentence"), "sentence"))
    return s.where(good).select(by, "sentence", score.alias("score")).distinct().withColumn("place", place).where(F.col("place") <= top).select(by, "sentence", "score", "place")


def gap_analysis(log: DataFrame, failed: Column, normalized: str, sample: str, top: int) -> DataFrame:
    """The most frequent unresolved queries with the log's totals."""
    total = log.agg(F.count("*").alias("total"), F.count_if(failed).alias("unresolved"))
    worst = log.where(failed).groupBy(F.col(normalized).alias("normalized")).agg(F.max(sample).alias("sample"), F.count("*").alias("hits")).orderBy(F.desc("hits"), "normalized").limit(top)
    both = worst.join(F.broadcast(total))  # one row
    return both.select("total", "unresolved", F.round(1 - F.col("unresolved") / F.col("total"), 4).alias("resolution_rate"), "normalized", "sample", "hits")


def bands(days: DataFrame, width: int) -> DataFrame:
    """centre, first_day, last_day, size: the days within `width` of each day. Every day goes to the centres it is in: no range join."""
    near = days.select("n", "day", F.explode(F.sequence(F.date_sub("day", width), F.date_add("day", width))).alias("centre"))
    pooled = near.groupBy("centre").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("size"))
    return pooled.join(days.select(F.col("day").alias("centre")), "centre", "left_semi")


def adaptive_bands(days: DataFrame, widest: int, times_mean: float) -> DataFrame:
    """centre, width: the least width whose band has times_mean the mean of a day, at most widest."""
    gap = F.abs(F.datediff("day", "centre"))
    near = days.select("n", "day", F.explode(F.sequence(F.date_sub("day", widest), F.date_add("day", widest))).alias("centre")).withColumn("gap", gap)
    rings = near.join(days.select(F.col("day").alias("centre")), "centre", "left_semi").groupBy("centre", "gap").agg(F.sum("n").alias("n"))
    size = F.sum("n").over(Window.partitionBy("centre").orderBy("gap"))
    target = days.agg((F.avg("n") * times_mean).alias("target"))
    wide = rings.withColumn("size", size).join(F.broadcast(target))  # one row
    return wide.groupBy("centre").agg(F.coalesce(F.min(F.when(F.col("size") >= F.col("target"), F.col("gap"))), F.lit(widest)).cast("int").alias("width"))
