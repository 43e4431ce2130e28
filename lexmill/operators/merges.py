"""Merges of a new pass into a store: what a preferred source replaces, what another only fills in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.lexicon import first_by

PREFERRED = "el-wiktionary"


def merged_by_source(stored: DataFrame, new: DataFrame, key: str, preferred: str = PREFERRED) -> DataFrame:
    """stored after a pass new, both (key, source, ...).

    New rows of the preferred source replace all rows of their key. Rows of another source are left
    out where the preferred one has rows, stored or new, and else replace those of their own source.
    """
    best = new.where(F.col("source") == preferred)
    held = stored.where(F.col("source") == preferred).select(key).unionAll(best.select(key)).distinct()
    others = new.where(F.col("source") != preferred).join(held, key, "left_anti")
    left = stored.join(best.select(key).distinct(), key, "left_anti").join(others.select(key, "source").distinct(), [key, "source"], "left_anti")
    return left.unionByName(best).unionByName(others)


def merged_pronunciations(stored: DataFrame, new: DataFrame, preferred: str = PREFERRED) -> DataFrame:
    """merged_by_source of (lemma_id, ipa, source, seq), each ipa of a lemma once: its first."""
    return first_by(merged_by_source(stored, new, "lemma_id", preferred), ["lemma_id", "ipa"], F.desc(F.col("source") == preferred), "seq")


def updated(stored: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """stored with columns from new where new has the key; new keys are not added."""
    fresh = new.select(*keys, F.struct(*columns).alias("_new"))
    joined = stored.join(fresh, keys, "left")
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in columns else F.col(c) for c in stored.columns])


def split_sources(rows: DataFrame, sources: str = "sources") -> DataFrame:
    """rows with the comma-joined sources as an array without empty ones."""
    return rows.withColumn(sources, F.filter(F.transform(F.split(sources, ","), lambda s: F.btrim(s)), lambda s: s != ""))


def would_change(stored: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """added, removed, changed, same: what a merge would do, without writing (a dry run). Keys are unique on both sides."""
    rest = [c for c in stored.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.xxhash64(*rest).alias(name) if rest else F.lit(0).alias(name))
    both = side(stored, "_old").join(side(after, "_new"), keys, "full")
    old, new = F.col("_old"), F.col("_new")
    return both.agg(F.count_if(old.isNull()).alias("added"), F.count_if(new.isNull()).alias("removed"), F.count_if(old != new).alias("changed"), F.count_if(old == new).alias("same"))


def targeted(stored: dict[str, DataFrame], new: dict[str, DataFrame], only: str, merge) -> dict[str, DataFrame]:
    """The tables of a store after a pass that merges one of them and leaves the others as they are."""
    if only not in stored or only not in new:
        raise ValueError(f"no table {only}")
    return {name: merge(table, new[name]) if name == only else table for name, table in stored.items()}


def part_of_speech(code: Column) -> Column:
    """The part of speech of a wordnet code."""
    #: The codes.
    names = {"n": "noun", "v": "verb", "a": "adj", "s": "adj", "r": "adv"}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code)


def wordnet_relations(members: DataFrame, rels: DataFrame, lemmas: DataFrame, kinds: dict[str, str], key_of) -> DataFrame:
    """(lemma_id, relation, target, target_id) of an exported wordnet: synonyms share a synset, others follow rels.

    members(synset, lemma, pos), rels(src, rel, tgt), lemmas(id, normalized_lemma, pos); kinds names the
    relations wanted. Only words with a lemma of their key and part of speech have edges; an edge is there once.
    """
    named = members.withColumns({"key": key_of(F.col("lemma")), "part": part_of_speech(F.col("pos"))})
    own = named.join(lemmas.select(F.col("id").alias("lemma_id"), F.col("normalized_lemma").alias("key"), F.col("pos").alias("part")), ["key", "part"])
    own = own.select("synset", "lemma_id", F.col("key").alias("own_key"))
    other = named.join(lemmas.groupBy(F.col("normalized_lemma").alias("key"), F.col("pos").alias("part")).agg(F.min("id").alias("target_id")), ["key", "part"], "left")
    other = other.select(F.col("synset").alias("tgt"), F.col("lemma").alias("target"), F.col("key").alias("other_key"), "target_id")
    label = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    steps = rels.where(F.col("rel").isin(list(kinds))).select(F.col("src").alias("synset"), F.try_element_at(label, F.col("rel")).alias("relation"), "tgt")
    same = own.select("synset").distinct().select("synset", F.lit("synonym").alias("relation"), F.col("synset").alias("tgt"))
    edges = own.join(steps.unionByName(same), "synset").join(other, "tgt").where("own_key != other_key")
    return edges.select("lemma_id", "relation", "target", "target_id").distinct()
