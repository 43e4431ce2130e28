"""Mixing sources to target weights by entropy balancing.

Sources by code point (null last) weigh 1, 2, 3, repeating, and share all words by weight; a
target stops at max_ratio times its source's words and the excess is shared again. Each document
gets a rate min(max_ratio, exp(lambda * size)): the rates nearest to 1 in relative entropy, within
the cap, whose words meet the source's target. The dual is convex and has one lambda for each
source. Newton steps (on the logarithm, kept inside a bracket) take its gradient and curvature
from sums over a histogram (source, size, documents) that Spark adds up in every iteration.

Rates become whole copies in two levels. Within a source, sizes from the largest down carry their
rounding error on to the next, so that the total misses the target by half a small document at
most. Within a (source, size) the copies are dealt to hash buckets and in them by rank, so that a
source or size with a large share of all rows is never one task.

Defined results: null text has size 0, rate 1 and no words; repeated rows are documents of their
own; an empty table gives no rows; texts of any length count whole; reruns agree; other columns stay
(mix) or are ignored (mixture), whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import clear_name, replaced, words, written


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (1, 2, 3)
    max_ratio: int = 3
    tolerance: float = 1e-9
    most_steps: int = 60
    bucket_rows: int = 20_000  #: documents for each hash bucket


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def source_key(source: Column) -> Column:
    """A source as text that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(totals: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(key, source_size) with target. A window over the sources, one small row each."""
    w = F.get(F.array(*[F.lit(float(x)) for x in params.weights]), ((F.row_number().over(Window.orderBy("key")) - 1) % len(params.weights)).cast("int"))
    out = totals.withColumn("weight", w).withColumn("cap", F.lit(float(params.max_ratio)) * F.col("source_size"))
    # from the least cap for its weight on: a source is full if its share of what is left is no less than its cap
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("source_size").over(Window.partitionBy()) - before
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    first = F.min_by("level", F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("weight")))
    return out.select("key", "source_size", target.alias("target"))


def tilt(lam: Column, size: Column, most: int) -> Column:
    return F.exp(F.least(lam * size, F.lit(math.log(most))))


def balanced(hist: DataFrame, goals: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """goals(key, source_size, target) with lam: damped Newton, each step a sum over hist(key, size, n)."""
    top = math.log(params.max_ratio)
    state = goals.withColumns({"lam": F.when(F.col("target") >= params.max_ratio * F.col("source_size"), F.lit(top)).otherwise(0.0), "low": F.lit(-60.0), "high": F.lit(top)})
    state = written(state.withColumn("done", (F.col("target") <= 0) | (F.col("target") >= params.max_ratio * F.col("source_size"))), "mix-state")
    for _ in range(params.most_steps):
        if state.where(~F.col("done")).isEmpty():
            break
        open_ = hist.join(state.where(~F.col("done")), "key")
        rate, x = tilt(F.col("lam"), F.col("size"), params.max_ratio), F.col("size")
        bent = F.when(F.col("lam") * x < top, F.col("n") * x * x * rate).otherwise(0.0)
        sums = open_.groupBy("key").agg(F.sum(F.col("n") * x * rate).alias("g"), F.sum(bent).alias("h"))
        step = state.join(sums, "key", "left")
        miss = F.log(F.col("target")) - F.log("g")
        newton = F.col("lam") + miss * F.col("g") / F.nullif(F.col("h"), F.lit(0.0))
        low = F.when(miss > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("high")).otherwise(F.col("lam"))
        step = step.withColumns({"miss": miss, "newton": newton, "low2": low, "high2": high})
        inside = (F.col("newton") > F.col("low2")) & (F.col("newton") < F.col("high2"))
        near = (F.abs("miss") < params.tolerance) | (F.col("high2") - F.col("low2") < 1e-15)
        moved = F.when(near, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("low2") + F.col("high2")) / 2)
        was = F.col("done")
        pick = lambda new, old: F.when(was, F.col(old)).otherwise(new)
        state = replaced(state, step.select("key", "source_size", "target", pick(moved, "lam").alias("lam"), pick(F.col("low2"), "low").alias("low"), pick(F.col("high2"), "high").alias("high"), (was | F.coalesce(near, F.lit(True))).alias("done")), "mix-state")
    return state.select("key", "source_size", "target", "lam")


def rounded(rates: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """rates(key, size, n, rate) with copies of the n documents together. A source's sizes are one group: as many rows as it has distinct sizes."""
    most = params.max_ratio

    def carry(pdf):
        pdf = pdf.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
            if size == 0:
                copies.append(n)
                continue
            wanted = n * rate * size + owed
            c = int(min(max(math.floor(wanted / size + 0.5), 0), most * n))
            owed = wanted - c * size
            copies.append(c)
        return pdf.assign(all_copies=copies)[["key", "size", "n", "rate", "all_copies"]]

    return rates.groupBy("key").applyInPandas(carry, "key string, size bigint, n bigint, rate double, all_copies bigint")


def keyed(docs: DataFrame, kept: list[str]) -> tuple[DataFrame, str]:
    """docs(doc_id, text, source, ...) as a struct of the kept columns, with key, size and tie; and the struct's name."""
    whole = clear_name(docs, "whole_row")
    return docs.select(F.struct(*kept).alias(whole), source_key(F.col("source")).alias("key"), size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tie")), whole


def allotted(base: DataFrame, whole: str, params: MixParams = MixParams()) -> DataFrame:
    """keyed() rows with struct column mix: size, source_size, target, rate, copies."""
    buckets = max(16, math.ceil(base.count() / params.bucket_rows))
    base = base.withColumn("bucket", F.pmod("tie", F.lit(buckets)))
    cells = written(base.groupBy("key", "size", "bucket").agg(F.count("*").alias("k")), "mix-cells")
    hist = written(cells.groupBy("key", "size").agg(F.sum("k").alias("n")), "mix-sizes")
    goals = targets(hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), params)
    solved = balanced(hist, goals, params)
    full = F.col("target") >= params.max_ratio * F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(full, float(params.max_ratio)).otherwise(tilt(F.col("lam"), F.col("size"), params.max_ratio))
    whole_copies = rounded(hist.join(solved, "key").select("key", "size", "n", rate.alias("rate")), params)
    dealt = cells.join(whole_copies, ["key", "size"])
    to_here = F.sum("k").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    upto = lambda c: F.floor(F.col("all_copies") * c / F.col("n"))
    dealt = dealt.withColumn("to_here", to_here).withColumn("copies", (upto(F.col("to_here")) - upto(F.col("to_here") - F.col("k"))).cast("bigint"))
    dealt = written(dealt.join(solved, "key").select("key", "size", "bucket", "k", "rate", "copies", "source_size", "target"), "mix-dealt")
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("tie", f"{whole}.doc_id"))
    out = base.join(dealt, ["key", "size", "bucket"]).withColumn("rank", rank)
    each = F.floor(F.col("copies") / F.col("k")) + F.when(F.col("rank") <= F.col("copies") % F.col("k"), 1).otherwise(0)
    mix = F.struct("size", "source_size", "target", "rate", each.cast("bigint").alias("copies"))
    return out.select(F.col(whole), mix.alias("mix"))


def mixture(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies times size): a row for each document. The texts are read once."""
    base, row = keyed(docs.select("doc_id", "text", "source"), ["doc_id", "source"])
    out = allotted(written(base, "mix-rows"), row, params)
    return out.select(f"{row}.doc_id", f"{row}.source", "mix.*", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    base, row = keyed(docs, docs.columns)
    out = allotted(base, row, params)
    return out.where("mix.copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))).select(f"{row}.*")
