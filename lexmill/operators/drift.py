"""Semantic drift: skip-gram vectors of slices, alignment on anchors, trajectories, bootstrap significance, and how much of a drift is noise."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


WORDS = 5_000_000  #: words that one partition of training reads


def train(slices: DataFrame, size: int = 100, window: int = 5, min_count: int = 10, epochs: int = 5, seed: int = 1) -> DataFrame:
    """token, vector, count of one slice(tokens). Slices of up to WORDS words are trained in one partition, larger ones in as many as they need, whose vectors Spark averages after each epoch."""
    from pyspark.ml.feature import Word2Vec

    words = slices.agg(F.sum(F.size("tokens"))).first()[0] or 0
    parts = max(1, -(-words // WORDS))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=parts, inputCol="tokens", outputCol="v").fit(slices)
    from pyspark.ml.functions import vector_to_array

    counts = slices.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector")).join(counts, "token")


def pooled_vectors(slices: DataFrame, size: int = 150, min_count: int = 3, **training) -> DataFrame:
    """token, vector, count over all slices(tokens) at once."""
    return train(slices.select("tokens"), size=size, min_count=min_count, **training)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def rotation(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The orthogonal map of source rows nearest to target rows."""
    u, _, vt = np.linalg.svd(source.T @ target)
    return u @ vt


def residuals(source: np.ndarray, target: np.ndarray, anchors: np.ndarray, rounds: int = 2, share: float = 0.25, least: int = 20) -> np.ndarray:
    """Cosine distance of every row after a rotation fitted on anchors, twice without the worst quarter of them."""
    a, b, at = unit(source), unit(target), np.asarray(anchors)
    for _ in range(rounds):
        far = 1 - (a[at] @ rotation(a[at], b[at]) * b[at]).sum(1)
        keep = at[np.argsort(far, kind="stable")[: int(np.ceil(len(at) * (1 - share)))]]
        if len(keep) < least:
            break
        at = keep
    return 1 - (a @ rotation(a[at], b[at]) * b).sum(1)


def aligned_drift(vectors: DataFrame, reference: int, floor: int = 20, anchors: int = 5000, least: int = 10) -> DataFrame:
    """corpus, year, token, drift of vectors(corpus, year, token, vector, count) against the reference year.

    Anchors are tokens that are among the most frequent `anchors` of both years. Every (corpus, year)
    is one task: its vocabulary, not its text.
    """
    top = F.row_number().over(Window.partitionBy("corpus", "year").orderBy(F.desc("count"), "token"))
    ranked = vectors.withColumn("top", top)
    ref = ranked.where(F.col("year") == reference).select("corpus", "token", F.col("vector").alias("ref"), F.col("top").alias("ref_top"), F.col("count").alias("ref_count"))
    shared = ranked.join(ref, ["corpus", "token"])

    def align(pdf):
        import pandas as pd

        pdf = pdf.sort_values("token")
        chosen = np.flatnonzero((pdf["top"] <= anchors) & (pdf["ref_top"] <= anchors))
        if len(chosen) < least:
            chosen = np.arange(len(pdf))
        if len(chosen) < least:
            return pd.DataFrame({"corpus": [], "year": [], "token": [], "drift": []})
        far = residuals(np.stack(pdf["vector"].to_numpy()), np.stack(pdf["ref"].to_numpy()), chosen)
        far = np.where(pdf["year"] == reference, 0.0, far)
        fine = (pdf["count"] >= floor) & (pdf["ref_count"] >= floor)
        return pd.DataFrame({"corpus": pdf["corpus"], "year": pdf["year"], "token": pdf["token"], "drift": far})[fine.to_numpy()]

    return shared.groupBy("corpus", "year").applyInPandas(align, "corpus string, year int, token string, drift double")


def bootstrap_weights(lines: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """lines with replicate and weight: a Poisson(1) draw for each line and replicate from a hash, the same in every run."""
    u = (F.xxhash64(F.lit(seed), "replicate", *lines.columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("u")
    out = lines.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    cumulative, weight = 0.0, F.lit(8)
    steps = []
    mass = float(np.exp(-1))
    for k in range(8):
        cumulative += mass
        steps.append((k, cumulative))
        mass /= k + 1
    for k, c in reversed(steps):
        weight = F.when(F.col("u") < c, k).otherwise(weight)
    return out.select("*", u).withColumn("weight", weight).drop("u").where("weight > 0")


def percentile_interval(samples: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """keys, mean, low, high, n of replicates; keys with fewer than least samples are left out."""
    out = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, [0.025, 0.975]).alias("p"), F.count(value).alias("n")).where(F.col("n") >= least)
    return out.select(*keys, "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "n")


def hash_sample(rows: DataFrame, by: list[str], size: int, seed: int = 1) -> DataFrame:
    """size rows of each group in hash order: uniform, and the same in every run."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("place")


def resampled(lines: DataFrame, replicate: int, cap: int | None = None, seed: int = 1) -> DataFrame:
    """lines(tokens) drawn with replacement: each as often as its Poisson draw says; thinned by hash to about cap lines."""
    share = 1.0 if cap is None else min(1.0, cap / max(1, lines.count()))
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.lit(replicate), F.lit("cap"), "tokens"), F.lit(1_000_000)) < int(1_000_000 * share)
    drawn = bootstrap_weights(lines.where(chosen), 1, seed * 1_000_003 + replicate)
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), "weight"))).select("tokens")


def pair_drift(first: DataFrame, last: DataFrame, floor: int = 0) -> DataFrame:
    """token, drift between two sets of vectors(token, vector, count)."""
    both = first.withColumn("year", F.lit(0)).unionByName(last.withColumn("year", F.lit(1))).withColumn("corpus", F.lit(""))
    return aligned_drift(both, 0, floor).where("year = 1").select("token", "drift")


def bootstrap_drift(first: DataFrame, last: DataFrame, replicates: int = 12, cap: int | None = None, seed: int = 1, **training) -> tuple[DataFrame, DataFrame]:
    """(replicate, token, drift) of real pairs, and of control pairs that only differ by resampling.

    first and last are slices(tokens). The loop is over replicates, each a distributed draw and a
    training run; pair i of the real ones is first i against last i, of the control first i against
    the next first.
    """
    firsts = [train(resampled(first, i, cap, seed), seed=seed + i, **training) for i in range(replicates)]
    lasts = [train(resampled(last, replicates + i, cap, seed), seed=seed + replicates + i, **training) for i in range(replicates)]
    real = [pair_drift(a, b).withColumn("replicate", F.lit(i)) for i, (a, b) in enumerate(zip(firsts, lasts))]
    control = [pair_drift(a, b).withColumn("replicate", F.lit(i)) for i, (a, b) in enumerate(zip(firsts, firsts[1:] + firsts[:1]))]
    united = lambda parts: reduce(DataFrame.unionByName, parts)
    return united(real), united(control)


def significance(real: DataFrame, control: DataFrame, observed: DataFrame, replicates: int, alpha: float = 0.05) -> DataFrame:
    """token, drift (mean of the replicates), low, high, z, p_value, q_value, significant.

    real and control(replicate, token, drift), observed(token, drift) of the whole slices. The
    interval is bias-corrected around the observed drift (percentiles without one); z holds the mean
    against the token's own control pairs, one-sided; the false discovery rate is over all tested.
    Tokens with fewer than max(4, half the replicates) real pairs are left out, with fewer control
    pairs untested.
    """
    from lexmill.functions.stats import bca_interval, with_bh

    least = max(4, replicates // 2)
    mine = real.groupBy("token").agg(F.avg("drift").alias("mean"), F.sort_array(F.collect_list("drift")).alias("all")).where(F.size("all") >= least)
    null = control.groupBy("token").agg(F.avg("drift").alias("mu"), F.stddev("drift").alias("sd"), F.count("drift").alias("n"))
    null = null.where((F.col("n") >= least) & (F.col("sd") > 1e-9)).drop("n")
    joined = mine.join(observed.select("token", F.col("drift").alias("observed")), "token", "left").join(null, "token", "left")

    @F.pandas_udf("low double, high double, p_value double")
    def judge(mean, replicated, at, mu, sd):
        import math

        import pandas as pd

        rows = []
        for m, r, o, u, s in zip(mean, replicated, at, mu, sd):
            low, high = bca_interval(o, list(r), []) if o == o and o is not None else np.percentile(r, [2.5, 97.5])
            p = 0.5 * math.erfc((m - u) / s / math.sqrt(2)) if s == s and s is not None else None
            rows.append((float(low), float(high), p))
        return pd.DataFrame(rows, columns=["low", "high", "p_value"])

    judged = joined.withColumn("j", judge("mean", "all", "observed", "mu", "sd")).select("token", F.col("mean").alias("drift"), "j.*", ((F.col("mean") - F.col("mu")) / F.col("sd")).alias("z"))
    tested = with_bh(judged.where("p_value is not null"), "p_value", ["token"]).withColumn("significant", F.col("q_value") <= alpha)
    return tested.unionByName(judged.where("p_value is null"), allowMissingColumns=True)


def signal(real: DataFrame, noise: DataFrame, counts: DataFrame, edges: list[int]) -> DataFrame:
    """band (least count), n, real and noise medians, noise p95, snr and the share of tokens above the noise's p95.

    real and noise(token, drift): drifts between two slices, and between two disjoint halves of one.
    """
    floor = noise.agg(F.percentile("drift", 0.95).alias("noise_p95"))
    band = F.lit(None).cast("int")
    for low in sorted(edges):
        band = F.when(F.col("count") >= low, low).otherwise(band)
    both = real.withColumnRenamed("drift", "real").join(noise.withColumnRenamed("drift", "noise"), "token").join(counts.select("token", "count"), "token").withColumn("band", band)
    rows = both.where("band is not null").join(F.broadcast(floor))  # one row
    out = rows.groupBy("band").agg(F.count("*").alias("n"), F.median("real").alias("real_median"), F.median("noise").alias("noise_median"), F.first("noise_p95").alias("noise_p95"), F.avg((F.col("real") > F.col("noise_p95")).cast("int")).alias("above"))
    return out.withColumn("snr", F.col("real_median") / F.nullif(F.col("noise_median"), F.lit(0.0)))


def reproducibility(one: DataFrame, two: DataFrame) -> DataFrame:
    """n, largest and mean distance between two trainings(token, vector, count) of the same lines."""
    return pair_drift(one, two).agg(F.count("*").alias("n"), F.max(F.abs("drift")).alias("largest"), F.avg(F.abs("drift")).alias("mean"))


def false_positives(series: list[list[float]], detector) -> float:
    """The share of series without a change in which detector(values) finds one."""
    return sum(detector(s) is not None for s in series) / len(series) if series else 0.0
