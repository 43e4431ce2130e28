"""Counts of tokens, their ranks and bands, and yearly series. Table and column names are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.stats import g2, g2_p, log_ratio, log_ratio_spread, with_bh, zipf
from lexmill.functions.text import tokens

#: Lower ends of the Zipf bands and the share of a corpus above which a count is implausible.
BANDS, SHARE_CAP = (5, 4, 3, 2), 0.005


def token_counts(docs: DataFrame, by: list[str] | None = None, text: str = "text") -> DataFrame:
    """(by..., token, count): exploded and counted; partial counts are made before the shuffle."""
    by = by or []
    return docs.select(*by, F.explode(tokens(F.col(text))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("count"))


def with_rank(counts: DataFrame, count: str = "count", token: str = "token", rank: str = "rank") -> DataFrame:
    """counts with its rank by count downwards, then token: all different, and no task sorts all rows.

    Rows are ranked within (count, first two characters of the token), and a histogram of these cells,
    far smaller than the vocabulary, says how many rows come before each cell.
    """
    cell = counts.withColumn("_head", F.substring(token, 1, 2))
    before = F.sum("_n").over(Window.orderBy(F.desc(count), "_head").rowsBetween(Window.unboundedPreceding, -1))
    cells = cell.groupBy(count, "_head").agg(F.count("*").alias("_n")).select(count, "_head", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(count, "_head").orderBy(token))
    return cell.withColumn("_inside", inside).join(cells, [count, "_head"]).withColumn(rank, (F.col("_before") + F.col("_inside")).cast("int")).drop("_head", "_before", "_inside")


def with_total(counts: DataFrame, count: str = "count", total: str = "total") -> DataFrame:
    """counts with the sum over all rows, by a partial sum and one broadcast row."""
    return counts.join(F.broadcast(counts.agg(F.sum(count).alias(total))))  # one row


def ranked_zipf(counts: DataFrame) -> DataFrame:
    """counts with rank (all different), zipf and band, and without tokens that own more than SHARE_CAP of all."""
    kept = with_total(counts).where(F.col("count") <= SHARE_CAP * F.col("total"))
    z = zipf(F.col("count"), F.col("total"))
    band = F.lit(1)
    for i, low in enumerate(reversed(BANDS)):
        band = F.when(F.col("zipf") >= low, i + 2).otherwise(band)
    return with_rank(kept.withColumn("zipf", F.round(z, 3)).withColumn("band", band))


def yearly_series(facts: DataFrame, corpus: str, lemma: str, year: Column, n: Column) -> DataFrame:
    """(corpus, lemma, year, count, per_million): the total of a corpus and year counts all its facts."""
    counted = facts.groupBy(F.col(corpus).alias("corpus"), F.col(lemma).alias("lemma"), year.alias("year")).agg(F.sum(n).alias("count"))
    total = F.sum("count").over(Window.partitionBy("corpus", "year"))
    return counted.withColumn("per_million", F.round(F.col("count") / F.when(total == 0, 1).otherwise(total) * 1e6, 3))


def keyness(counts: DataFrame, by: str, left: str, right: str, least: int) -> DataFrame:
    """token, a, b, g2, p_value, q_value, log_ratio, ci for tokens with a + b >= least in two corpora."""
    wide = counts.where(F.col(by).isin(left, right)).groupBy("token").agg(F.sum(F.when(F.col(by) == left, F.col("count")).otherwise(0)).alias("a"), F.sum(F.when(F.col(by) == right, F.col("count")).otherwise(0)).alias("b"))
    wide = wide.join(F.broadcast(wide.agg(F.sum("a").alias("c"), F.sum("b").alias("d")))).where(F.col("a") + F.col("b") >= least)  # one row
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    wide = wide.withColumn("g2", F.round(g2(a, b, c, d), 6)).withColumn("log_ratio", F.round(log_ratio(a, b, c, d), 6))
    wide = wide.withColumn("ci", F.round(log_ratio_spread(a, b, c, d), 6)).withColumn("p_value", F.round(g2_p(F.col("g2")), 12))
    return with_bh(wide, "p_value", ["token"]).withColumn("q_value", F.round("q_value", 10))


def distinctive(found: DataFrame, dispersed: DataFrame, left: str, right: str, by: str, most_dp: float = 0.8, alpha: float = 0.05, top: int = 30) -> DataFrame:
    """The top tokens of each side of keyness() by log ratio: significant by q_value and spread over the parts of their corpus.

    dispersed(by, token, dp) has Gries' DP of a token within each corpus; a token without one counts as 1.
    """
    side = F.when(F.col("log_ratio") > 0, left).when(F.col("log_ratio") < 0, right)
    found = found.where(F.col("q_value") <= alpha).withColumn("side", side).where("side is not null")
    found = found.join(dispersed.select(F.col(by).alias("side"), "token", "dp"), ["side", "token"], "left").where(F.coalesce("dp", F.lit(1.0)) <= most_dp)
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("log_ratio")), "token"))
    return found.withColumn("place", place).where(F.col("place") <= top)


def dispersion_by(docs: DataFrame, corpus: str, part: str) -> DataFrame:
    """(corpus, token, count, dp): Gries' DP of every token over the parts of each corpus."""
    return dispersion_of(token_counts(docs, [corpus, part]), corpus, part)


def dispersion_of(counts: DataFrame, corpus: str, part: str) -> DataFrame:
    """dispersion_by() of counts(corpus, part, token, count)."""
    sizes = counts.groupBy(corpus, part).agg(F.sum("count").alias("size"))
    sizes = sizes.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy(corpus)))
    inside = counts.withColumn("total", F.sum("count").over(Window.partitionBy(corpus, "token"))).join(sizes, [corpus, part])
    own = F.sum(F.abs(F.col("count") / F.col("total") - F.col("share")))
    return inside.groupBy(corpus, "token").agg(F.max("total").alias("count"), F.round((own + 1 - F.sum("share")) / 2, 6).alias("dp"))


def dispersion(docs: DataFrame, part: str, least: int) -> DataFrame:
    """token, count, dp: Gries' deviation of proportions over all parts (a part without the token counts its whole share)."""
    counts = token_counts(docs, [part])
    sizes = with_total(counts.groupBy(part).agg(F.sum("count").alias("size")), "size", "all").withColumn("share", F.col("size") / F.col("all")).drop("all")
    total = F.sum("count").over(Window.partitionBy("token"))
    inside = counts.withColumn("total", total).where(F.col("total") >= least).join(sizes, part)
    # parts without the token add their share; those are one less the shares of parts with it
    own = F.sum(F.abs(F.col("count") / F.col("total") - F.col("share")))
    return inside.groupBy("token").agg(F.max("total").alias("count"), F.round((own + 1 - F.sum("share")) / 2, 6).alias("dp"))
