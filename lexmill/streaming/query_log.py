"""The query log as a stream: append, stream-static resolution, and windowed gaps (an extension: the batch report is unwindowed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "query string, normalized string, ts timestamp"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).json(path)


def resolved(log: DataFrame, index: DataFrame) -> DataFrame:
    """log with resolved: whether the static index(normalized_surface) has the key."""
    known = index.select(F.col("normalized_surface").alias("normalized")).distinct().withColumn("hit", F.lit(True))
    return log.join(known, "normalized", "left").withColumn("resolved", F.coalesce("hit", F.lit(False))).drop("hit")


def append(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there and stops; run again it takes up where it stopped."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_gaps(log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """day, normalized, hits of unresolved queries; rows later than `late` are left out."""
    return log.where("not resolved").withWatermark("ts", late).groupBy(F.window("ts", window).alias("day"), "normalized").agg(F.count("*").alias("hits"))
