"""The composite reads of a lexicon store: one plan each, children gathered by key instead of a query for every hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.lexicon import MISSING_RANK

ENTRIES_SHOWN, NAMES_SHOWN = 12, 12
SNAPSHOTS_KEPT, KEY_PLACES = 500, 3


def gathered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """key and an array of the other columns as structs, in order."""
    rest = [c for c in rows.columns if c != key and c not in order]
    packed = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return rows.groupBy(key).agg(packed.alias(name))


def word(lemmas: DataFrame, key: str, frequency: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The entries of a folded key: exact lemma first, then frequency, then id; 12 at most with the true total.

    children: name -> (rows with lemma_id, columns that order them); an entry without rows has an empty array.
    """
    found = lemmas.where(F.col("normalized_lemma") == key).join(frequency.select(F.col("lemma_id").alias("id"), "rank", "zipf", "band"), "id", "left")
    place = F.row_number().over(Window.orderBy((F.col("lemma") != key), F.coalesce("rank", F.lit(MISSING_RANK)), "id"))
    shown = found.withColumn("entries_total", F.count("*").over(Window.partitionBy())).withColumn("place", place).where(F.col("place") <= ENTRIES_SHOWN)
    for name, (rows, order) in children.items():
        mine = rows.join(F.broadcast(shown.select(F.col("id").alias("lemma_id"))), "lemma_id", "left_semi")  # 12 ids at most
        nested = gathered(mine, "lemma_id", order, name).withColumnRenamed("lemma_id", "id")
        shown = shown.join(nested, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return shown.withColumn("entries_truncated", F.col("entries_total") > ENTRIES_SHOWN)


def search(passes: DataFrame, lemmas: DataFrame, senses: DataFrame, limit: int) -> DataFrame:
    """Ranked hits of passes(pass, lemma_id, order_key struct, surface, features): the first pass that finds a lemma shows it.

    Content and names are two lists. Reading stops at the limit-th content row, so a name ranked
    after it is not shown; at most NAMES_SHOWN names are.
    """
    first = passes.withColumn("n", F.row_number().over(Window.partitionBy("lemma_id").orderBy("pass", "order_key"))).where("n = 1").drop("n")
    hits = first.join(lemmas.select(F.col("id").alias("lemma_id"), "lemma", "pos", "gender", "lemma_class"), "lemma_id")
    order = Window.orderBy("pass", "order_key", "lemma_id")
    is_name = F.col("lemma_class") == "name"
    ranked = hits.withColumn("is_name", is_name).withColumn("content_seen", F.sum((~is_name).cast("int")).over(order)).withColumn("names_seen", F.sum(is_name.cast("int")).over(order))
    shown = ranked.where(F.when(F.col("is_name"), (F.col("names_seen") <= NAMES_SHOWN) & (F.col("content_seen") < limit)).otherwise(F.col("content_seen") <= limit))
    snippet = senses.groupBy("lemma_id").agg(F.min_by("gloss", "sense_index").alias("snippet"))
    return shown.join(snippet, "lemma_id", "left").withColumn("features", F.nullif(F.array_join("features", ", "), F.lit(""))).drop("content_seen", "names_seen")


def graph(lemma_id: int, lemmas: DataFrame, edges: DataFrame, etymons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a lemma: its top relations and its line of ancestors."""
    from lexmill.operators.lexicon import lineage, top_edges

    near = top_edges(edges.where(F.col("source") == lemma_id), 60).select(F.col("source").cast("string"), F.col("target").cast("string"), "type", "weight")
    line = lineage(etymons.where(F.col("lemma_id") == lemma_id), "lemma_id", "seq", F.concat_ws(":", "lang_code", "term"), 20)
    steps = line.select(F.col("from_node").alias("source"), F.col("to_node").alias("target"), F.lit("etymon").alias("type"), F.lit(1.0).alias("weight"))
    all_ = near.unionByName(steps)
    ids = all_.select(F.col("source").alias("id")).unionAll(all_.select("target")).distinct()
    nodes = ids.join(lemmas.select(F.col("id").cast("string").alias("id"), F.col("lemma").alias("label")), "id", "left").withColumn("resolved", F.col("label").isNotNull())
    return nodes.withColumn("label", F.coalesce("label", "id")), all_


def stats(lemmas: DataFrame) -> DataFrame:
    name = F.col("lemma_class") == "name"
    return lemmas.agg(F.count_if(~name).alias("content"), F.count_if(name).alias("name"), F.count("*").alias("total"))


def attributions(registry: DataFrame, newer: DataFrame) -> DataFrame:
    """The registry with newer rows in place of those of the same source."""
    return registry.join(newer, "source_name", "left_anti").unionByName(newer)


def lemma_classes(senses: DataFrame, markers: list[str], lemmas: DataFrame) -> DataFrame:
    """lemmas with lemma_class: a name if its part of speech says so or every gloss has a marker (null is not a name)."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.col("gloss").contains(m)
    every = senses.groupBy(F.col("lemma_id").alias("id")).agg(F.bool_and(marked).alias("all_names"))
    is_name = F.col("pos").eqNullSafe("name") | F.coalesce("all_names", F.lit(False))
    return lemmas.drop("lemma_class").join(every, "id", "left").withColumn("lemma_class", F.when(is_name, "name").otherwise("content")).drop("all_names")


def snapshot(result: DataFrame, path: str, key: str, signature: str) -> DataFrame:
    """result as kept under key and signature (a table version, say); computed and written once for each."""
    spark = result.sparkSession
    where = f"{path}/key={key}/sig={signature}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(where)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        result.write.mode("errorifexists").parquet(where)
    return spark.read.parquet(where)


def snapshot_key(name: str, **parameters) -> str:
    """A key for snapshot: parameters by name, fractions rounded, so that near values share one result."""
    shown = lambda v: f"{round(v, KEY_PLACES):.{KEY_PLACES}f}" if isinstance(v, float) else str(v)
    return "-".join([name, *(f"{k}~{shown(v)}" for k, v in sorted(parameters.items()))])


def trim_snapshots(spark: SparkSession, path: str, keep: int = SNAPSHOTS_KEPT) -> int:
    """Deletes what snapshot keeps under path but for the newest signature of each of the keep newest keys; the number deleted."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    every = hadoop.Path(f"{path}/key=*/sig=*")
    files = every.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(((s.getModificationTime(), s.getPath().toString()) for s in files.globStatus(every)), reverse=True)
    kept, spent = set(), []
    for _, where in found:
        key = where.rsplit("/", 2)[1]
        if key in kept or len(kept) >= keep:
            spent.append(where)
        else:
            kept.add(key)
    for where in spent:
        files.delete(hadoop.Path(where), True)
    return len(spent)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Every part as a folder of JSON lines under path, in place of what was there."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
