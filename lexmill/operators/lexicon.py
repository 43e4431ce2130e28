"""Resolution, merging and graph operations over lexicon-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING_RANK = 1e9


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def upsert_sources(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key (nulls are a key), its sources united, sorted and joined by commas."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n_rows"))


def precedence_merge(rows: DataFrame, key: str, preferred: str) -> DataFrame:
    """For each key the newest row of the preferred source, else the newest of any. rows(key, source, value, seq)."""
    return first_by(rows, [key], F.desc(F.col("source") == preferred), F.desc("seq"), "value").select(key, "source", "value")


def two_tier_resolve(wanted: DataFrame, index: DataFrame, also: list[str] | None = None) -> DataFrame:
    """wanted(surface, key) with id: the exact surface's, else the key's if only one id has it, else null.

    also names columns, the part of speech say, that must be the same on both sides (nulls are).
    """
    also = also or []
    exact = index.groupBy("surface", *also).agg(F.min("id").alias("exact_id"))
    folded = index.groupBy("key", *also).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low = high").select("key", *also, F.col("low").alias("key_id"))
    out = wanted
    for side, by in ((exact, "surface"), (folded, "key")):
        renamed = side.select(*[F.col(c).alias(f"_{c}") for c in (by, *also)], side.columns[-1])
        same = [out[by] == renamed[f"_{by}"], *[out[c].eqNullSafe(renamed[f"_{c}"]) for c in also]]
        out = out.join(renamed, same, "left").drop(*[f"_{c}" for c in (by, *also)])
    return out.select("surface", "key", *also, F.coalesce("exact_id", "key_id").alias("id"))


def ranked_search(queries: DataFrame, index: DataFrame, ranks: DataFrame, limit: int) -> DataFrame:
    """query, place, id, surface: exact matches of the folded key; exact surface first, then frequency rank, weight, id."""
    hits = queries.join(index, "key").join(ranks, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(MISSING_RANK)))
    hits = hits.withColumn("exact", (F.col("query") == F.col("surface")).cast("int"))
    order = [F.desc("exact"), "rank", F.desc("weight"), "id", "surface"]
    once = first_by(hits, ["query", "id"], *order)
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return once.withColumn("place", place).where(F.col("place") <= limit).select("query", "place", "id", "surface", "exact")


def top_edges(edges: DataFrame, limit: int) -> DataFrame:
    """The first `limit` edges of each source by type rank, resolved first, weight, id; then one for each (target, type)."""
    order = Window.partitionBy("source").orderBy("type_rank", F.desc(F.col("target_id").isNotNull()), F.desc("weight"), "edge_id")
    top = edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return first_by(top, ["source", "target", "type"], "place").select("source", "target", "type", "weight", "place")


def lineage(steps: DataFrame, key: str, seq: str, node: Column, limit: int) -> DataFrame:
    """Each of the first `limit` steps of a key with the one before it (the key itself for the first)."""
    order = Window.partitionBy(key).orderBy(seq)
    linked = steps.withColumn("node", node).withColumn("place", F.row_number().over(order))
    linked = linked.withColumn("from_node", F.lag("node", 1).over(order))
    return linked.where(F.col("place") <= limit).select(key, F.coalesce("from_node", F.col(key).cast("string")).alias("from_node"), F.col("node").alias("to_node"), "place")


def families(members: DataFrame, group: str, item: str, largest: int, limit: int) -> DataFrame:
    """item, kin, group_size: items of one group of 1 to `largest` others; the smallest group wins, `limit` kin for each item.

    Not all pairs are formed. A group gives an item its `limit` least kin at most, for any other of the same
    group comes after those; and once one group has `limit` kin, larger groups come after it.
    """
    once = members.select(group, item).where(F.col(group).isNotNull()).distinct()
    w = Window.partitionBy(group)
    at = F.row_number().over(w.orderBy(F.asc_nulls_last(item)))
    sized = once.withColumn("group_size", F.count("*").over(w) - 1).withColumn("_known", F.count(item).over(w)).withColumn("_at", at).where(F.col("group_size").between(1, largest))
    full = sized.where(F.col("_known") > limit).groupBy(F.col(item).alias("_item")).agg(F.min("group_size").alias("_full"))
    asked = sized.join(full, F.col(item) == F.col("_item"), "left").where(F.col("group_size") <= F.coalesce("_full", "group_size"))
    pairs = asked.alias("a").join(sized.where(F.col("_at") <= limit + 1).alias("b"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{item}") != F.col(f"b.{item}")))
    least = pairs.groupBy(F.col(f"a.{item}").alias("item"), F.col(f"b.{item}").alias("kin")).agg(F.min("a.group_size").alias("group_size"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("group_size", "kin"))
    return least.withColumn("place", place).where(F.col("place") <= limit).select("item", "kin", "group_size")


def missing_cells(stored: DataFrame, rows: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of the grid rows x columns (both small, fixed domains) that stored lacks."""
    return rows.crossJoin(F.broadcast(columns)).join(stored.select(*keys).distinct(), keys, "left_anti")
