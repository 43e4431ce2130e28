"""Trends of yearly series: gates, robust slopes, monotone trend tests, change points, movers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import stats


def ols_gate(series: DataFrame, key: str, least_years: int, least_mean: float, least_r2: float) -> DataFrame:
    """key, n, avg_pm, slope_ols, r2 of series(key, year, per_million) that pass. Rounded twice, so that the order of a sum does not decide a tie."""
    x, y = F.col("year").cast("double"), F.col("per_million")
    sums = series.groupBy(key).agg(F.count("*").alias("n"), F.avg(y).alias("avg_pm"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sx2"), F.sum(y * y).alias("sy2"), F.sum(x * y).alias("sxy0"))
    sums = sums.withColumns({"sxx": F.expr("sx2 - sx * sx / n"), "syy": F.expr("sy2 - sy * sy / n"), "sxy": F.expr("sxy0 - sx * sy / n")})
    fit = sums.where("n >= 1 AND sxx > 1e-9 AND syy > 1e-9").withColumn("r2", F.expr("sxy * sxy / (sxx * syy)")).withColumn("slope_ols", F.expr("sxy / sxx"))
    passed = fit.where((F.col("n") >= least_years) & (F.col("avg_pm") >= least_mean) & (F.col("r2") >= least_r2))
    return passed.select(key, "n", F.round(F.round("avg_pm", 8), 4).alias("avg_pm"), F.round(F.round("slope_ols", 7), 4).alias("slope_ols"), F.round("r2", 6).alias("r2"))


def pairwise(series: DataFrame, key: str) -> DataFrame:
    """key, theil_sen (median slope) and mk_s (sign sum) by pairs of years of one key."""
    a, b = series.alias("a"), series.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.year") < F.col("b.year")))
    rise = F.col("b.per_million") - F.col("a.per_million")
    slope = rise / (F.col("b.year") - F.col("a.year"))
    return pairs.groupBy(F.col(f"a.{key}").alias(key)).agg(F.round(F.median(slope), 4).alias("theil_sen"), F.sum(F.signum(rise).cast("bigint")).alias("mk_s"))


def mann_kendall(series: DataFrame, key: str) -> DataFrame:
    """key, n, tau, p_plain and p_value (corrected for autocorrelation), a series at a time."""

    def fit(pdf):
        import pandas as pd

        values = pdf.sort_values("year")["per_million"].tolist()
        found = stats.mann_kendall(values)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(values)], "tau": [found["tau"]], "p_plain": [found["p_plain"]], "p_value": [found["p"]]})

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, "year", "per_million").groupBy(key).applyInPandas(fit, f"{key} {kind}, n bigint, tau double, p_plain double, p_value double")


def pettitt_change(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key, n, change_at (last place before the change), k, p_value: Pettitt's test by windows."""
    a, b = series.alias("a"), series.alias("b")
    sums = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).groupBy(F.col(f"a.{key}").alias(key), F.col(f"a.{at}").alias("at")).agg(F.sum(F.signum(F.col(f"a.{value}") - F.col(f"b.{value}")).cast("bigint")).alias("v"))
    order = Window.partitionBy(key).orderBy("at")
    u = F.abs(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = sums.withColumn("u", u).withColumn("n", F.count("*").over(Window.partitionBy(key))).withColumn("place", F.row_number().over(order))
    steps = steps.where("n >= 4 AND place < n")
    best = steps.groupBy(key).agg(F.max("n").alias("n"), F.max("u").alias("k"), F.max_by("at", F.struct("u", -F.col("place"))).alias("change_at"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    return best.withColumn("p_value", F.round(F.least(F.lit(1.0), 2 * F.exp(-6 * k * k / (n * n * n + n * n))), 6))


def movers(drift: DataFrame, series: DataFrame, key: str, least: float, limit: int) -> DataFrame:
    """The limit keys of drift(key, score, first_year, last_year) that move most and have least per million in both anchor years."""
    at = lambda year: series.where(F.col("per_million") >= least).select(key, F.col("year").alias(year))
    gated = drift.join(at("first_year"), [key, "first_year"]).join(at("last_year"), [key, "last_year"])
    return gated.select(key, "score", "first_year", "last_year").orderBy(F.desc("score"), key).limit(limit)
