"""What the training-data operators share: the word rule, table reading, shared storage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these six white space characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE_RUN = r"[^\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SMALL_BATCH = 1000  #: rows of an Arrow batch under small_batches()
SUMMED = 1 << 18  #: sums that a task of map_lists() holds at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order, as array<string>; null gives an empty array.

    The white space becomes blanks first: a split at one plain character needs no regular expression.
    """
    plain = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(old: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """written(df, label), after which the table that written() gave as old is deleted: for the steps of a loop."""
    new = written(df, label)
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in old.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return new


def clear_name(df: DataFrame, wanted: str) -> str:
    """A column name close to wanted that df does not have (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is executed (not only planned) within has Arrow batches of at most SMALL_BATCH rows; then the session's own size holds again.

    A batch of whole texts stands in the JVM's memory outside its heap and in the worker, in every task.
    """
    own = spark.conf.get(BATCH, None)
    if own is None or not 0 < int(own) <= SMALL_BATCH:
        spark.conf.set(BATCH, str(SMALL_BATCH))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if own is None else spark.conf.set(BATCH, own)


def map_lists(df: DataFrame, func, schema: str, rows: int | None = 2000, summed: bool = False) -> DataFrame:
    """func(dict of column -> list) -> dict of column -> list, at most `rows` rows at a time (None: a whole Arrow batch). Rows may grow or go.

    The parts bound what Python objects take; functions that sum up what they get take whole batches.
    summed: the last column is added up over a task's rows that agree in the others, whatever the size of batches.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def results(batches):
        for batch in batches:
            step = rows or max(batch.num_rows, 1)
            for at in range(0, batch.num_rows, step):
                out = func(batch.slice(at, step).to_pydict())
                yield [out[f.name] for f in target]

    def sums(found):
        total = Counter()
        for *keys, n in found:
            for key, k in zip(zip(*keys), n):
                total[key] += k
            if len(total) >= SUMMED:
                yield [*map(list, zip(*total)), list(total.values())]
                total.clear()
        if total:
            yield [*map(list, zip(*total)), list(total.values())]

    def run(batches):
        for out in sums(results(batches)) if summed else results(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, target)], schema=target)

    return df.mapInArrow(run, schema)


def bitmap(cells: DataFrame, bits: int) -> bytes:
    """A bitmap of 2**bits cells, little end first, with the numbers in cells' one column set.

    The tasks put the bits together, 64 to a word, so that the driver gets words of the bitmap and
    never what they stand for: 2**(bits - 6) small rows at most.
    """
    import numpy as np

    parts = cells.toDF("cell").selectExpr("shiftright(cast(cell as bigint), 6) AS word", "shiftleft(1L, cast(cell % 64 as int)) AS bit")
    found = parts.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << max(bits - 6, 0), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bit"].to_numpy(np.int64)
    return out.astype("<i8").tobytes()
