"""Slices of a dated corpus: which are dense, what is skipped, pools, halves, and the payload of one word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.stats import pool_budget

DENSE_SHARE, ERA_FLOOR = 0.4, 50


def dense(slices: DataFrame, share: float = DENSE_SHARE) -> DataFrame:
    """slices(corpus, year, vocabulary) with at least share of the corpus' largest vocabulary; all of a corpus with fewer than two such."""
    corpus = Window.partitionBy("corpus")
    marked = slices.withColumn("dense", F.col("vocabulary") >= share * F.max("vocabulary").over(corpus))
    kept = marked.withColumn("n_dense", F.count_if("dense").over(corpus)).where(F.col("dense") | (F.col("n_dense") < 2))
    return kept.drop("dense", "n_dense")


def span(slices: DataFrame) -> DataFrame:
    """corpus, first_year, last_year of its slices."""
    return slices.groupBy("corpus").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def skipped(all_slices: DataFrame, used: DataFrame) -> DataFrame:
    """(corpus, year) of the slices that are not used."""
    return all_slices.select("corpus", "year").join(used.select("corpus", "year"), ["corpus", "year"], "left_anti")


def distinct_pools(pools: DataFrame) -> DataFrame:
    """pools(corpus, year, members) without those of the same members as an earlier year: they are one population."""
    same = Window.partitionBy("corpus", F.array_sort(F.array_distinct("members"))).orderBy("year")
    return pools.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def pooled_lines(lines: DataFrame, members: dict[int, list[int]], cap: int, seed: int = 1) -> DataFrame:
    """centre and line: for each centre year the lines of its member years, each with its share of cap (water filling), picked by hash.

    lines(year, line). members is a small table: the years of a corpus. One row for each year comes to the driver.
    """
    sizes = {r["year"]: r["n"] for r in lines.groupBy("year").agg(F.count("*").alias("n")).collect()}
    shares = [(centre, year, n) for centre, years in members.items() for year, n in pool_budget({y: sizes.get(y, 0) for y in years}, cap).items()]
    wanted = lines.sparkSession.createDataFrame(shares, "centre int, year int, share long")
    order = Window.partitionBy("year").orderBy(F.xxhash64(F.lit(seed), "line"), "line")
    ranked = lines.withColumn("_n", F.row_number().over(order))
    return ranked.join(F.broadcast(wanted), "year").where(F.col("_n") <= F.col("share")).select("centre", "year", "line")


def halves(lines: DataFrame, seed: int = 1) -> DataFrame:
    """lines with half 0 or 1, by hash of the line and its number among equal lines: disjoint, and the same in every run."""
    number = F.row_number().over(Window.partitionBy(*lines.columns).orderBy(F.lit(0)))
    return lines.withColumn("_n", number).withColumn("half", F.pmod(F.xxhash64(F.lit(seed), *lines.columns, "_n"), F.lit(2))).drop("_n")


def era_neighbours(vectors: DataFrame, years: list[int], wanted: DataFrame, resolve: DataFrame, stop: list[str], k: int = 8, pool: int = 40, floor: int = ERA_FLOOR) -> DataFrame:
    """year, lemma_id, place, neighbour, neighbour_id, score: the nearest words of wanted(lemma_id, token) in each of the years.

    vectors(year, token, vector, count) of one corpus; words under the floor take no part. Of the pool of
    nearest words those with three letters that are no stop word and belong to a lemma of
    resolve(token, lemma_id), each lemma once and never the word's own, fill k places.
    """
    from lexmill.operators.vectors import exact_neighbours

    out = None
    for year in years:
        here = vectors.where((F.col("year") == year) & (F.col("count") >= floor))
        coded = here.withColumn("vec_id", F.xxhash64("token"))
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        rows = coded.select("vec_id", "token", F.transform("vector", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("embedding"))
        asked = rows.join(wanted.select("token").distinct(), "token", "left_semi")
        near = exact_neighbours(asked, rows, pool)
        named = near.join(rows.select("vec_id", F.col("token").alias("word")), "vec_id").join(rows.select(F.col("vec_id").alias("neighbor"), F.col("token").alias("neighbour")), "neighbor")
        named = named.where((F.length("neighbour") >= 3) & ~F.col("neighbour").isin(stop))
        named = named.join(wanted.withColumnRenamed("token", "word"), "word")
        first = resolve.groupBy(F.col("token").alias("neighbour")).agg(F.min("lemma_id").alias("neighbour_id"))
        named = named.join(first, "neighbour").where("neighbour_id != lemma_id")
        once = named.withColumn("_n", F.row_number().over(Window.partitionBy("lemma_id", "neighbour_id").orderBy(F.desc("score"), "neighbour"))).where("_n = 1")
        place = F.row_number().over(Window.partitionBy("lemma_id").orderBy(F.desc("score"), "neighbour"))
        part = once.withColumn("place", place).where(F.col("place") <= k).select(F.lit(year).alias("year"), "lemma_id", "place", "neighbour", "neighbour_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def then_and_now(neighbours: DataFrame) -> DataFrame:
    """neighbours(corpus, lemma_id, year, ...) of the first and, if there are several, the last stored year of each lemma, as era then and now."""
    own = Window.partitionBy("corpus", "lemma_id")
    marked = neighbours.withColumn("_low", F.min("year").over(own)).withColumn("_high", F.max("year").over(own))
    era = F.when(F.col("year") == F.col("_low"), "then").when(F.col("year") == F.col("_high"), "now")
    return marked.withColumn("era", era).where("era is not null").drop("_low", "_high")


def word_history(lemma_ids: list[int], series: DataFrame, drift: DataFrame, trajectory: DataFrame, neighbours: DataFrame) -> DataFrame:
    """corpus with series, trajectory, drift and neighbours (arrays of structs) of the first of lemma_ids, in year order; no rows for none."""
    mine = lambda df: df.where(F.col("lemma_id") == (lemma_ids[0] if lemma_ids else None)).drop("lemma_id")
    packed = None
    for name, rows in (("series", mine(series)), ("trajectory", mine(trajectory)), ("drift", mine(drift)), ("neighbours", mine(then_and_now(neighbours)))):
        rest = sorted((c for c in rows.columns if c != "corpus"), key=lambda c: (c != "year", c != "place", c))
        part = rows.groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        packed = part if packed is None else packed.join(part, "corpus", "full")
    return packed
