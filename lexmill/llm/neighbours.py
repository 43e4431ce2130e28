"""Nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a long string of bits (signs of random projections; vectors get one
more component that makes their norms equal, so that the largest inner product is the smallest
angle). In a tree the strings are sorted arrays, split where a prefix has at most leaf_rows vectors.
A query descends in all trees to its longest prefix and ascends in all of them together, one level
at a time, until the prefixes hold enough vectors in sum; those are scored exactly, in double
precision. The counts of prefixes that decide the level are a table whose depth grows with the
vectors, up to a bound.

How many are enough is measured on the data at hand. A sample of the queries is held against every
vector, and `candidates` is doubled until the prefixes hold least_recall of the sample's true
neighbours, by the mean less three standard errors. Where no prefix is enough, every row is scored.

Equal vectors are one entry with their k + 1 smallest ids, so a vector that many rows share is no
hot spot; queries with equal vectors are searched once. A leaf that cannot be split by prefix is
dealt to sub-leaves. Each level looks at whole leaves: shuffled rows are trees times vectors.

On directions without clusters a share of all rows has to be scored, so that work on such data grows
with vectors times queries.

Defined results: vectors that are null, empty, all zero, or hold null, NaN or infinite components
take no part, nor do null ids; shorter vectors are padded with zeros; rows that repeat an id and a
vector count once; ties go to the smaller id; no candidates, no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import map_lists, written


@dataclass(frozen=True)
class ForestParams:
    k: int = 20
    trees: int = 10
    bits: int = 63
    route_bits: int | None = None  #: depth of the table of prefix counts; as the number of vectors asks, if None
    most_route_bits: int = 18  #: bounds that table, and with it what is broadcast
    leaf_rows: int = 16_384
    candidates: int = 2_048  #: the least that the prefixes hold, before recall is measured
    least_recall: float = 0.92  #: of the true neighbours of sampled queries
    sampled: int = 128  #: queries held against every vector
    seed: int = 11


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each vector once with its keep smallest ids."""
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= keep)
    return first.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def planes(dimension: int, params: ForestParams) -> np.ndarray:
    return np.random.default_rng(params.seed).standard_normal((dimension + 1, params.trees * params.bits))


def hashes(vectors: list, norm: float | None, dimension: int, params: ForestParams) -> np.ndarray:
    """A hash of params.bits bits for each vector and tree. norm: the largest of all; None for queries."""
    x = np.zeros((len(vectors), dimension + 1))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    if norm is not None:
        x[:, dimension] = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    signs = (x @ planes(dimension, params) > 0).reshape(len(vectors), params.trees, params.bits)
    out = np.zeros((len(vectors), params.trees), np.int64)
    for b in range(params.bits):
        out = out << 1 | signs[:, :, b]
    return out


def _hashed(rows: DataFrame, norm: float | None, dimension: int, params: ForestParams, other: str, kind: str) -> DataFrame:
    """rows(v, other) with h: the hashes."""

    def run(batch: dict) -> dict:
        h = hashes(batch["v"], norm, dimension, params) if batch["v"] else np.zeros((0, params.trees))
        return {"v": batch["v"], other: batch[other], "h": h.tolist()}

    return map_lists(rows.select("v", other), run, f"v array<double>, {other} {kind}, h array<bigint>")


class Router:
    """Prefix counts of each tree at each level, the leaves, and where queries go."""

    def __init__(self, counts: np.ndarray, params: ForestParams):
        self.params, depth = params, params.route_bits
        self.levels = [counts.reshape(params.trees, 1 << x, -1).sum(2) for x in range(depth + 1)]
        self.starts, self.parts = [], []
        for t in range(params.trees):
            starts, parts, todo = [], [], [(0, 0)]
            while todo:
                level, prefix = todo.pop()
                n = int(self.levels[level][t, prefix])
                if n > params.leaf_rows and level < depth:
                    todo += [(level + 1, 2 * prefix + 1), (level + 1, 2 * prefix)]
                    continue
                starts.append(prefix << (depth - level))
                parts.append(max(1, math.ceil(n / params.leaf_rows)))
            self.starts.append(np.array(starts))
            self.parts.append(np.array(parts))

        self.candidates = params.candidates

    def level(self, h: np.ndarray) -> int:
        """How deep the prefixes of a query with hashes h go: the deepest level with enough vectors in all trees together."""
        top = h >> (self.params.bits - self.params.route_bits)
        for x in range(self.params.route_bits, 0, -1):
            if sum(int(self.levels[x][t, p >> (self.params.route_bits - x)]) for t, p in enumerate(top)) >= self.candidates:
                return x
        return 0

    def widen(self, h: np.ndarray, depths: list[list[int]]) -> None:
        """Sets candidates by queries with hashes h, whose true neighbours share prefixes of depths with them."""
        some = [(x, np.array(d)) for x, d in zip(h, depths) if d]
        while some and self.candidates <= int(self.levels[0].sum()):
            recall = np.array([(d >= self.level(x)).mean() for x, d in some])
            if recall.mean() - 3 * recall.std() / math.sqrt(len(recall)) >= self.params.least_recall:
                return
            self.candidates *= 2

    def groups(self, h: np.ndarray, level: int):
        """(tree, leaf, part) that hold the query's prefixes; at level 0 one tree has all."""
        depth = self.params.route_bits
        for t in range(self.params.trees if level else 1):
            low = int(h[t] >> (self.params.bits - depth)) >> (depth - level) << (depth - level)
            first = int(np.searchsorted(self.starts[t], low, "right")) - 1
            last = int(np.searchsorted(self.starts[t], low + (1 << (depth - level)), "left"))
            for leaf in range(first, last):
                for part in range(int(self.parts[t][leaf])):
                    yield t, leaf, part

    def home(self, t: int, h: int) -> int:
        return int(np.searchsorted(self.starts[t], h >> (self.params.bits - self.params.route_bits), "right")) - 1


def common_depths(a: np.ndarray, b: np.ndarray, params: ForestParams) -> np.ndarray:
    """The longest prefix, up to route_bits, that the hashes a and b (the last axis: trees) share in any tree."""
    apart = (a ^ b) >> (params.bits - params.route_bits)
    return (params.route_bits - np.frexp(apart.astype(float))[1]).max(-1)


def true_depths(data: DataFrame, q: np.ndarray, h: np.ndarray, params: ForestParams) -> list[list[int]]:
    """For each query of q with hashes h, the common depths of its k nearest other vectors among all of data(v, ids, h)."""
    import pandas as pd

    def run(batches):
        best = pd.DataFrame({"query": [], "neg": [], "id": [], "depth": []})
        for batch in batches:
            v = np.zeros((len(batch), q.shape[1]))
            for i, x in enumerate(batch["v"]):
                v[i, : len(x)] = x
            own, ids = np.stack(batch["h"]), np.array([x[0] for x in batch["ids"]])
            scores = q @ v.T
            for i, row in enumerate(scores):
                top = np.argpartition(-row, params.k)[: params.k + 1] if len(row) > params.k + 1 else np.arange(len(row))
                top = top[(v[top] != q[i]).any(1)]
                best = [best] if isinstance(best, pd.DataFrame) else best
                best.append(pd.DataFrame({"query": i, "neg": -row[top], "id": ids[top], "depth": common_depths(own[top], h[i], params)}))
            best = pd.concat(best).sort_values(["query", "neg", "id"]).groupby("query").head(params.k)
        yield best.astype({"query": "int32", "id": "int64", "depth": "int32"})

    near = data.mapInPandas(run, "query int, neg double, id bigint, depth int")
    rows = near.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("neg", "id", "depth"))), 1, params.k).alias("best")).collect()
    found: list[list[int]] = [[] for _ in q]
    for r in rows:
        found[r["query"]] = [b["depth"] for b in r["best"]]
    return found


def _best(queries, data, params: ForestParams):
    """For each query of a group, its k + 1 best (-score, id) among the rows with its prefix."""
    import pandas as pd

    if not len(queries) or not len(data):
        return pd.DataFrame({"query": pd.Series([], dtype="int64"), "best": pd.Series([], dtype=object)})
    data = data.sort_values("h", kind="stable")
    sorted_h, ids = data["h"].to_numpy(), data["ids"].to_list()
    width = max(max(map(len, data["v"])), max(map(len, queries["v"])))
    pad = lambda vs: np.stack([np.pad(np.asarray(v, float), (0, width - len(v))) for v in vs])
    v, q = pad(data["v"]), pad(queries["v"])
    shift = params.bits - queries["level"].to_numpy()
    low = queries["h"].to_numpy() >> shift << shift
    # the prefix's last hash, not the next prefix's first one: past the prefix of ones that is no long any more
    first, last = np.searchsorted(sorted_h, low), np.searchsorted(sorted_h, low | ((np.int64(1) << np.minimum(shift, 62)) - 1), "right")
    last = np.where(shift >= params.bits, len(v), last)
    out = []
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ v.T
        for i in range(len(scores)):
            a, b = first[at + i], last[at + i]
            if a == b:
                out.append([])
                continue
            part = scores[i, a:b]
            chosen = np.arange(b - a)
            if b - a > params.k + 1:
                edge = np.partition(part, b - a - params.k - 1)[b - a - params.k - 1]
                chosen = np.flatnonzero(part >= edge - 1e-9 * max(1.0, abs(edge)))
            exact = (v[a + chosen] * q[at + i]).sum(1)
            found = sorted((-s, x) for s, c in zip(exact.tolist(), chosen) for x in ids[a + c])
            out.append([{"neg": s, "id": int(x)} for s, x in found[: params.k + 1]])
    return pd.DataFrame({"query": queries["query"].to_numpy(), "best": out})


def search(vectors: DataFrame, queries: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors(id, v) for every row of queries(id, v)."""
    double = lambda df: df.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    vectors, asked = double(vectors), double(queries).withColumn("query", F.xxhash64("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shape = vectors.agg(F.max(F.size("v")).alias("d"), F.max(norm2).alias("n2")).unionAll(asked.agg(F.max(F.size("v")), F.max(norm2))).collect()
    dimension, norm = max([r["d"] or 0 for r in shape]), math.sqrt(shape[0]["n2"] or 0)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not shape[0]["d"] or not shape[1]["d"]:
        return vectors.sparkSession.createDataFrame([], schema)

    data = written(_hashed(distinct_vectors(vectors, params.k + 1), norm, dimension, params, "ids", "array<bigint>"), "forest")
    if params.route_bits is None:
        wanted = math.ceil(math.log2(max(2, data.count() * params.trees / params.candidates)))
        params = replace(params, route_bits=min(wanted, params.most_route_bits))
    shift = params.bits - params.route_bits
    each = data.select(F.posexplode("h").alias("tree", "h"))
    table = each.groupBy("tree", F.shiftright("h", shift).alias("prefix")).count().toPandas()
    counts = np.zeros((params.trees, 1 << params.route_bits), np.int64)
    counts[table["tree"], table["prefix"]] = table["count"]
    router, once = Router(counts, params), asked.groupBy("query").agg(F.first("v").alias("v"))
    if params.candidates <= counts.sum():
        sample = [r["v"] for r in once.orderBy("query").limit(params.sampled).collect()]
        q, h = np.array([v + [0.0] * (dimension - len(v)) for v in sample]), hashes(sample, None, dimension, params)
        router.widen(h, true_depths(data, q, h, params))
    sent = vectors.sparkSession.sparkContext.broadcast(router)

    def deal(batch: dict) -> dict:
        router, out = sent.value, {name: [] for name in ("tree", "leaf", "part", "h", "v", "ids")}
        for v, ids, h in zip(batch["v"], batch["ids"], batch["h"]):
            for t, x in enumerate(h):
                leaf = router.home(t, x)
                row = (t, leaf, ids[0] % int(router.parts[t][leaf]), x, v, ids)
                for name, value in zip(out, row):
                    out[name].append(value)
        return out

    def ask(batch: dict) -> dict:
        router, out = sent.value, {name: [] for name in ("tree", "leaf", "part", "h", "v", "query", "level")}
        for v, query, h in zip(batch["v"], batch["query"], batch["h"]):
            level = router.level(np.array(h))
            for t, leaf, part in router.groups(np.array(h), level):
                for name, value in zip(out, (t, leaf, part, h[t], v, query, level)):
                    out[name].append(value)
        return out

    group = ["tree", "leaf", "part"]
    rows = map_lists(data, deal, "tree int, leaf int, part int, h bigint, v array<double>, ids array<bigint>")
    probes = map_lists(_hashed(once, None, dimension, params, "query", "bigint"), ask, "tree int, leaf int, part int, h bigint, v array<double>, query bigint, level int")
    best = probes.groupBy(*group).cogroup(rows.groupBy(*group)).applyInPandas(lambda a, b: _best(a, b, params), "query bigint, best array<struct<neg:double,id:bigint>>")
    merged = best.groupBy("query").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, params.k + 1).alias("best"))
    own = asked.select(F.col("id").alias("query_id"), "query").distinct().join(merged, "query")
    found = own.select("query_id", F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, params.k).alias("best"))
    ranked = found.select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.neg")).alias("score"))
