"""Looking a word up from one string: the folded key, Greek readings of a Latin spelling, English glosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import fold_key, greeklish_candidates
from lexmill.operators.lexicon import MISSING_RANK, first_by
from lexmill.operators.store import search

LONGEST_QUERY, MOST_HITS = 120, 50
DIRECT, LATIN, TRANSLATION = 0, 1, 2


def checked(query: str, limit: int) -> str:
    """The query without outer blanks; a ValueError if it or the limit is out of bounds."""
    if not 1 <= len(query) <= LONGEST_QUERY:
        raise ValueError(f"a query has 1 to {LONGEST_QUERY} characters")
    if not 1 <= limit <= MOST_HITS:
        raise ValueError(f"a limit is 1 to {MOST_HITS}")
    return query.strip()


def gloss_index(senses: DataFrame, phrases: Column) -> DataFrame:
    """(en_term, lemma_id, weight, source) of the English senses(lemma_id, sense_index, gloss, source).

    phrases is an array of terms for each row; the n-th weighs 1 / n. The best weight of a term and
    lemma stays, with the source of its first sense.
    """
    english = senses.where(F.col("source").startswith("en") & (F.coalesce("gloss", F.lit("")) != ""))
    terms = english.select("lemma_id", "sense_index", "source", F.posexplode(phrases).alias("at", "en_term"))
    weighed = terms.withColumn("weight", F.round(1 / (F.col("at") + 1), 4))
    best = F.max_by("source", F.struct("weight", -F.col("sense_index")))
    return weighed.groupBy("en_term", "lemma_id").agg(F.max("weight").alias("weight"), best.alias("source"))


def passes(query: str, index: DataFrame, glosses: DataFrame, ranks: DataFrame) -> DataFrame:
    """pass, lemma_id, order_key, surface and features of what the three passes find for one query.

    index(lemma_id, normalized, surface, features, weight) holds lemmas and forms, glosses is a
    gloss_index, ranks(lemma_id, rank) a frequency list. The keys are a few literals, so every scan
    is filtered at its source.
    """
    raw, key = query.strip(), fold_key(query)
    latin = [k for k in dict.fromkeys(fold_key(c) for c in greeklish_candidates(query)) if k and k != key]
    english = " ".join(query.lower().split()).strip(" .,;:!?\"'()[]")
    rank = F.coalesce("rank", F.lit(MISSING_RANK)).cast("double")
    order = lambda *parts: F.array(*[p.cast("double") for p in parts])
    same = F.when(F.col("surface") == raw, 0).otherwise(1)
    found = index.where(F.col("normalized").isin([key, *latin])).join(ranks, "lemma_id", "left")
    direct = found.where(F.col("normalized") == key).select(F.lit(DIRECT).alias("pass"), "lemma_id", order(same, rank, -F.col("weight"), F.col("lemma_id")).alias("order_key"), "surface", "features")
    fanned = found.where(F.col("normalized") != key).select(F.lit(LATIN).alias("pass"), "lemma_id", order(rank, -F.col("weight"), F.col("lemma_id"), F.lit(0)).alias("order_key"), "surface", "features")
    meant = glosses.where((F.col("en_term") == english) & (F.lit(english) != "")).join(ranks, "lemma_id", "left")
    no_features = F.lit(None).cast(index.schema["features"].dataType).alias("features")
    meant = meant.select(F.lit(TRANSLATION).alias("pass"), "lemma_id", order(-F.col("weight"), rank, F.col("lemma_id"), F.lit(0)).alias("order_key"), F.lit(None).cast("string").alias("surface"), no_features)
    return direct.unionByName(fanned).unionByName(meant)


def look_up(query: str, index: DataFrame, glosses: DataFrame, ranks: DataFrame, lemmas: DataFrame, senses: DataFrame, limit: int = 10) -> DataFrame:
    """Ranked hits of one query string: direct ones, then Latin readings, then translations; a lemma is shown once."""
    query = checked(query, limit)
    return search(passes(query, index, glosses, ranks), lemmas, senses, limit)


def translated(terms: DataFrame, glosses: DataFrame, ranks: DataFrame, limit: int) -> DataFrame:
    """en_term, place, lemma_id, weight: the lemmas of many English terms at once, by weight, then frequency, then id."""
    hits = terms.join(glosses, "en_term").join(ranks, "lemma_id", "left").withColumn("rank", F.coalesce("rank", F.lit(MISSING_RANK)))
    order = [F.desc("weight"), "rank", "lemma_id"]
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("en_term").orderBy(*order))).where(F.col("place") <= limit).select("en_term", "place", "lemma_id", "weight")


def token_lemmas(counts: DataFrame, index: DataFrame, token: str = "token", by: list[str] | None = None, n: str = "count") -> DataFrame:
    """(by..., lemma_id, count): every token's count credited once to each lemma that has its key, whatever its number of index rows."""
    keys = index.select(F.col("normalized").alias(token), "lemma_id").distinct()
    return counts.join(keys, token).groupBy(*(by or []), "lemma_id").agg(F.sum(n).alias("count"))


def lemma_series(counts: DataFrame, index: DataFrame, token: str = "token") -> DataFrame:
    """(corpus, year, lemma_id, count, per_million) of counts(corpus, year, token, count): a year's total has all its tokens, matched or not."""
    totals = counts.groupBy("corpus", "year").agg(F.sum("count").alias("total"))
    own = token_lemmas(counts, index, token, ["corpus", "year"])
    per = F.round(F.col("count") / F.greatest("total", F.lit(1)) * 1e6, 3)
    return own.join(F.broadcast(totals), ["corpus", "year"]).withColumn("per_million", per).drop("total")  # a row for each corpus and year


def lemma_collocations(pairs: DataFrame, index: DataFrame, key_of, stop: list[str], top: int = 12, least_letters: int = 3) -> DataFrame:
    """lemma_id, place, collocate, significance, collocate_id of pairs(w1, w2, significance), which have no direction.

    key_of gives the key of a word column. A pair is credited to both words' lemmas with its best
    significance; short words, stop words and the word itself are left out. Collocates of one lemma,
    or with one key if they have none, are one: the strongest.
    """
    both = pairs.select(F.col("w1").alias("word"), F.col("w2").alias("collocate"), "significance").unionAll(pairs.select("w2", "w1", "significance"))
    both = both.withColumns({"key": key_of(F.col("word")), "other": key_of(F.col("collocate"))})
    both = both.where((F.length("collocate") >= least_letters) & (F.col("key") != F.col("other")) & ~F.col("other").isin(stop))
    keys = index.select(F.col("normalized").alias("key"), "lemma_id").distinct()
    best = both.join(keys, "key").groupBy("lemma_id", "collocate", "other").agg(F.max("significance").alias("significance"))
    target = index.groupBy(F.col("normalized").alias("other")).agg(F.min("lemma_id").alias("collocate_id"))
    named = best.join(target, "other", "left").where(~F.col("collocate_id").eqNullSafe(F.col("lemma_id")))
    named = named.withColumn("same", F.coalesce(F.col("collocate_id").cast("string"), F.concat(F.lit("="), "other")))
    once = first_by(named, ["lemma_id", "same"], F.desc("significance"), "collocate")
    place = F.row_number().over(Window.partitionBy("lemma_id").orderBy(F.desc("significance"), "collocate"))
    return once.withColumn("place", place).where(F.col("place") <= top).select("lemma_id", "place", "collocate", "significance", "collocate_id")
