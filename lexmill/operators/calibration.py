"""Calibration of scores: reliability, thresholds for a wanted precision, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confident(scored: DataFrame) -> DataFrame:
    """scored(doc_id, quality, s) with the predicted class, its confidence and whether it is right."""
    cls = F.when(F.col("s") >= 0.5, 1).otherwise(0)
    return scored.withColumn("cls", cls).withColumn("conf", F.when(F.col("s") >= 0.5, F.col("s")).otherwise(1 - F.col("s"))).withColumn("ok", (F.col("cls") == F.col("quality")).cast("int"))


def reliability(rows: DataFrame, bins: int) -> DataFrame:
    """bin, n, confidence, accuracy and the expected calibration error over all bins."""
    cell = F.greatest(F.ceil(F.round(F.col("conf") * bins, 9)), F.lit(1)).cast("int")
    g = rows.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("ok").alias("a"))
    over = Window.partitionBy()
    ece = F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))).over(over) / F.sum("n").over(over)
    return g.select("bin", "n", F.round("c", 6).alias("confidence"), F.round("a", 6).alias("accuracy"), F.round(ece, 6).alias("ece"))


def thresholds(rows: DataFrame, precision: float, least: float) -> DataFrame:
    """cls, threshold: the confidence at the end of the longest prefix with the wanted precision, 1.01 if there is none."""
    order = Window.partitionBy("cls").orderBy(F.desc("conf"), "doc_id")
    run = rows.select("cls", "conf", F.row_number().over(order).alias("n"), F.avg("ok").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p"))
    at = F.max(F.when(F.col("p") >= precision, F.struct("n", "conf")))
    return run.groupBy("cls").agg(at.alias("at")).select("cls", F.when(F.col("at").isNull(), 1.01).otherwise(F.greatest("at.conf", F.lit(least))).alias("threshold"))


def decide(probabilities: Column, classes: list[str], limits: dict[str, float], margin: float) -> Column:
    """The class of the largest probability, null under its threshold or within margin of the next."""
    pairs = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("neg"), i.alias("i"))))
    top, second = F.get(pairs, F.lit(0)), F.get(pairs, F.lit(1))
    name = F.get(F.array(*[F.lit(c) for c in classes]), top["i"])
    need = F.get(F.array(*[F.lit(float(limits.get(c, 0.0))) for c in classes]), top["i"])
    clear = (-top["neg"] >= need) & F.coalesce(second["neg"] - top["neg"] >= margin, F.lit(True))
    return F.when(clear, name)
