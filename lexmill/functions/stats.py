"""Statistics as column expressions, and the ones that need a whole series as plain functions."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from statistics import NormalDist, median, pstdev

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A Chebyshev fit of erfc with a relative error under 1.2e-7 everywhere, from the constant up.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, far tails included."""
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for a in reversed(ERFC[1:]):
        poly = (poly + F.lit(a)) * t
    return t * F.exp(-x * x + F.lit(ERFC[0]) + poly)


def g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Dunning's G2 of a in c words against b in d words."""
    share = (a + b) / (c + d)
    part = lambda o, e: F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)
    return 2 * (part(a, c * share) + part(b, d * share))


def g2_p(x: Column) -> Column:
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def log_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """log2 of the ratio of relative frequencies, 0 if a count is 0."""
    return F.when((a > 0) & (b > 0), F.log2((a / c) / (b / d))).otherwise(0.0)


def log_ratio_spread(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Half the 95 % interval of log_ratio, by the delta method of a log relative risk; 0 if a count is 0."""
    var = 1 / a + 1 / b - 1 / c - 1 / d
    return F.when((a > 0) & (b > 0) & (var > 0), 1.96 * F.sqrt(var) / F.ln(F.lit(2.0))).otherwise(0.0)


def zipf(count: Column, total: Column) -> Column:
    return F.log10(count) - F.log10(total) + 9


def with_bh(df: DataFrame, p: str, by: list[str], q: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q of column p over all rows (candidates after gating). Ties of p have one q, so `by` cannot change it.

    Equal p-values are counted first. They are ranked within ranges of p (64 to a doubling), and the ranges,
    a few thousand, say how many rows come before and the least step after: no task has all rows.
    """
    start, before = Window.unboundedPreceding, -1
    counted = df.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_range", F.floor(F.log2("_p") * 64))
    ranges = counted.groupBy("_range").agg(F.sum("_n").alias("_rows"))
    ahead = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(start, before)), F.lit(0))
    ranges = ranges.select(F.col("_range").alias("_own"), ahead.alias("_ahead"), F.sum("_rows").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_range")
    rank = F.col("_ahead") + F.sum("_n").over(inside.orderBy("_p").rowsBetween(start, 0))
    stepped = counted.join(ranges, F.col("_range").eqNullSafe(F.col("_own"))).withColumn("_step", F.col("_p") * F.col("_all") / rank).drop("_own", "_ahead", "_all")
    after = stepped.groupBy("_range").agg(F.min("_step").alias("_least"))
    after = after.select(F.col("_range").alias("_own"), F.min("_least").over(Window.orderBy(F.desc("_range")).rowsBetween(start, before)).alias("_after"))
    low = F.least(F.min("_step").over(inside.orderBy(F.desc("_p")).rowsBetween(start, 0)), "_after", F.lit(1.0))
    found = stepped.join(after, F.col("_range").eqNullSafe(F.col("_own"))).select("_p", low.alias(q))
    return df.join(found, F.col(p).eqNullSafe(F.col("_p"))).drop("_p")


def theil_sen(years: list[float], values: list[float]) -> float:
    slopes = [(values[j] - values[i]) / (years[j] - years[i]) for i in range(len(years)) for j in range(i + 1, len(years)) if years[j] != years[i]]
    return median(slopes) if slopes else 0.0


def mann_kendall(values: list[float]) -> dict:
    """tau, the plain p and the p corrected for autocorrelation (Hamed and Rao) of a series in order."""
    n = len(values)
    if n < 4:
        return {"tau": 0.0, "p_plain": 1.0, "p": 1.0}
    s = sum((b > a) - (b < a) for i, a in enumerate(values) for b in values[i + 1 :])
    ties = sum(t * (t - 1) * (2 * t + 5) for t in Counter(values).values())
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    slope = theil_sen(list(range(n)), values)
    rest = [round(v - slope * i, 12) for i, v in enumerate(values)]
    order = sorted(rest)
    first = {v: order.index(v) for v in order}
    count = Counter(order)
    ranks = [first[v] + (count[v] + 1) / 2 for v in rest]
    mean = sum(ranks) / n
    square = sum((r - mean) ** 2 for r in ranks)
    extra = 0.0
    for k in range(1, n):
        rho = sum((ranks[i] - mean) * (ranks[i + k] - mean) for i in range(n - k)) / square if square else 0.0
        if abs(rho) > 1.96 / math.sqrt(n):
            extra += (n - k) * (n - k - 1) * (n - k - 2) * rho
    factor = max(1 + 2 / (n * (n - 1) * (n - 2)) * extra, 1e-6)

    def p_of(v: float) -> float:
        return math.erfc(max(0.0, abs(s) - 1) / math.sqrt(v) / math.sqrt(2)) if v > 0 and s else 1.0

    return {"tau": s / (n * (n - 1) / 2), "p_plain": p_of(var), "p": p_of(var * factor)}


def pettitt(values: list[float]) -> tuple[int | None, float]:
    """Place before the change and p; (None, 1) for fewer than four values."""
    n = len(values)
    if n < 4:
        return None, 1.0
    best, at, u = 0, 0, 0
    for t in range(n - 1):
        u += sum((values[t] > v) - (values[t] < v) for v in values)
        if abs(u) > best:
            best, at = abs(u), t
    return at, min(1.0, 2 * math.exp(-6 * best**2 / (n**3 + n**2)))


def pettitt_permuted(values: list[float], permutations: int = 999, seed: int = 1) -> tuple[int | None, float]:
    """As pettitt(), with the p-value of K among that of shuffled series (the series itself counts as one)."""
    import numpy as np

    x = np.asarray(values, float)
    if len(x) < 4:
        return None, 1.0
    v = np.sign(x[:, None] - x[None, :]).sum(1)
    steps = np.abs(np.cumsum(v)[:-1])
    rng = np.random.default_rng(seed)
    shuffled = rng.permuted(np.tile(v, (permutations, 1)), axis=1)  # shuffling a series shuffles its rank sums
    above = (np.abs(np.cumsum(shuffled, axis=1)[:, :-1]).max(1) >= steps.max()).sum()
    return int(steps.argmax()), float((1 + above) / (1 + permutations))


def steepest_step(series: list[tuple[int, float]], least_z: float = 2.0, floor: float = 0.05) -> tuple[int | None, float | None]:
    """(year, z) of the largest rise between neighbours of a distance series, held against the median and MAD of the other rises.

    The first rise, from the reference itself, is left out. The year is None under least_z, z is 0 if
    nothing rises; (None, None) for fewer than two rises. floor is the least spread.
    """
    rises = [(year, value - series[i + 1][1]) for i, (year, value) in enumerate(series[2:])]
    if len(rises) < 2:
        return None, None
    at = max(range(len(rises)), key=lambda i: rises[i][1])
    year, best = rises[at]
    if best <= 0:
        return None, 0.0
    rest = [r for i, (_, r) in enumerate(rises) if i != at]
    middle = median(rest)
    spread = 1.4826 * median([abs(r - middle) for r in rest])
    z = (best - middle) / max(spread if spread > 1e-9 else pstdev(rest), floor)
    return (year if z >= least_z else None), round(z, 2)


def mean_year(lines: dict[int, int]) -> float:
    """The mean year of a pooled slice, weighted by lines; NaN without lines."""
    total = sum(lines.values())
    return sum(y * n for y, n in lines.items()) / total if total else math.nan


def cache_key(name: str, *parts: object, places: int = 3) -> str:
    """A key of a stored result: numbers with a fraction are rounded, so that what nobody can tell apart shares a key."""
    return ":".join([name, *(f"{round(x, places):.{places}f}" if isinstance(x, float) else str(x) for x in parts)])


def bca_interval(value: float, replicates: list[float], jackknife: list[float], alpha: float = 0.05) -> tuple[float, float]:
    """Bias-corrected and accelerated bootstrap interval; NaN without replicates."""
    if not replicates:
        return math.nan, math.nan
    norm, r = NormalDist(), len(replicates)
    share = min(max(sum(x < value for x in replicates) / r, 1 / (r + 1)), 1 - 1 / (r + 1))
    z0 = norm.inv_cdf(share)
    mean = sum(jackknife) / len(jackknife) if jackknife else 0.0
    cube, square = sum((mean - x) ** 3 for x in jackknife), sum((mean - x) ** 2 for x in jackknife)
    a = cube / (6 * square**1.5) if square else 0.0
    ordered = sorted(replicates)

    def at(q: float) -> float:
        z = z0 + norm.inv_cdf(q)
        place = norm.cdf(z0 + z / (1 - a * z)) * (r - 1)
        low = int(place)
        return ordered[low] + (place - low) * (ordered[min(low + 1, r - 1)] - ordered[low])

    return at(alpha / 2), at(1 - alpha / 2)


def pool_budget(sizes: dict[int, int], total: int) -> dict[int, int]:
    """Equal lines for each year up to its size (water filling); what is left of a division goes one by one, earliest first. 0 stays 0."""
    given, left, open_ = dict.fromkeys(sizes, 0), min(total, sum(sizes.values())), sorted(y for y, n in sizes.items() if n > 0)
    while left and open_:
        each = left // len(open_)
        if each == 0:
            for y in open_[:left]:
                given[y] += 1
            break
        for y in open_:
            add = min(each, sizes[y] - given[y])
            given[y] += add
            left -= add
        open_ = [y for y in open_ if given[y] < sizes[y]]
    return given


def exact_quantiles(rows: DataFrame, by: str, value: str, shares: list[float], *more: Column) -> DataFrame:
    """by, p (an array of the exact quantiles, interpolated), more (aggregates): a row for each group, few groups of any size.

    A sketch gives brackets for each share, counts of the cells between them say which cells hold the wanted
    ranks, and only these cells' values, equal ones as one, are ordered. Where a sketch misses, a larger cell is read.
    """
    share = lambda s, d: min(1.0, max(0.0, s + d))
    ends = [share(s, d) for s in shares for d in (-0.001, 0.001)]
    groups = rows.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx(value, ends, 10_000).alias("_ends"), F.count(value).alias("_n"), *more)
    given = rows.select(F.col(by).alias("_of"), F.col(value).alias("_v")).where("_v is not null")
    cell = sum(((F.col("_v") > F.col("_ends")[i]) if i % 2 else (F.col("_v") >= F.col("_ends")[i])).cast("int") for i in range(len(ends)))
    celled = given.join(F.broadcast(groups.select("_by", "_ends", "_n")), F.col("_of").eqNullSafe(F.col("_by"))).select("_by", "_n", "_v", cell.alias("_cell"))  # few groups
    place = lambda s: F.lit(s) * (F.col("_n") - 1)
    ranks = [f(place(s)) for s in shares for f in (F.floor, F.ceil)]
    sizes = celled.groupBy("_by", "_n", "_cell").agg(F.count("*").alias("_rows"))
    until = F.sum("_rows").over(Window.partitionBy("_by").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumn("_before", until - F.col("_rows"))
    holds = lambda r, n: (r >= F.col("_before")) & (r < F.col("_before") + F.col(n))
    wanted = sizes.where(reduce(Column.__or__, [holds(r, "_rows") for r in ranks])).select(F.col("_by").alias("_of"), F.col("_cell").alias("_in"), "_before")
    inside = celled.join(F.broadcast(wanted), F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_cell") == F.col("_in")))  # few cells
    counts = inside.groupBy("_by", "_n", "_cell", "_before", "_v").agg(F.count("*").alias("_rows"))
    until = F.sum("_rows").over(Window.partitionBy("_by", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_before", F.col("_before") + until - F.col("_rows"))
    found = counts.groupBy("_by", "_n").agg(*[F.max(F.when(holds(r, "_rows"), F.col("_v"))).alias(f"_r{i}") for i, r in enumerate(ranks)])
    low, high = (lambda i: F.col(f"_r{2 * i}")), (lambda i: F.col(f"_r{2 * i + 1}"))
    values = F.array(*[low(i) + (high(i) - low(i)) * (place(s) - F.floor(place(s))) for i, s in enumerate(shares)])
    found = found.select(F.col("_by").alias("_of"), values.alias("p"))
    return groups.join(found, F.col("_by").eqNullSafe(F.col("_of")), "left").withColumnRenamed("_by", by).drop("_ends", "_n", "_of")
