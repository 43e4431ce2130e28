"""Exact neighbours of query sets, and centroids of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Vectors in a block at least and at most, about how many blocks a side has between, blocks of rows that a task meets, and queries and rows of one product.
LEAST, MOST, BLOCKS, MET, TILE = 256, 8192, 32, 8, (512, 2048)


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """n blocks of (block, ids, vectors, width): the bytes of numpy arrays, dealt evenly whatever the keys."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        batches = [x for x in batches if x.num_rows]
        if batches:
            t = pa.Table.from_batches(batches).combine_chunks()
            ids, flat = t["vec_id"].to_numpy(), pa.concat_arrays([c.flatten() for c in t["embedding"].chunks]).to_numpy(zero_copy_only=False)
            if len(flat) % len(ids) or t["embedding"].null_count:
                raise ValueError("vectors of one width are needed")
            yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "vectors": [flat.astype(float).tobytes()], "width": pa.array([len(flat) // len(ids)], pa.int32())})

    return rows.select("vec_id", "embedding").repartition(n).mapInArrow(pack, "block int, ids binary, vectors binary, width int")


def count_blocks(rows: DataFrame) -> int:
    n = rows.count()
    return max(1, -(-n // min(MOST, max(LEAST, n // BLOCKS))))


def half_away(x):
    """x to six places, halves away from zero as in SQL."""
    import numpy as np

    y = x * 1e6
    whole = np.trunc(y)
    return (whole + np.copysign(np.abs(y - whole) >= 0.5, y)) / 1e6


class Best:
    """The k best rows so far for each query of one block, exactly.

    A product in single precision only says which rows cannot be among them: what is above a query's k-th score
    less the largest error of the product is computed again in double precision.
    """

    def __init__(self, ids, vectors, k: int):
        import numpy as np

        self.ids, self.v, self.k, n = ids, vectors, k, len(ids)
        self.low, self.norm = np.full(n, -np.inf), np.linalg.norm(vectors, axis=1)
        self.small = vectors.astype(np.float32)
        self.at, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, ids, vectors):
        import numpy as np

        small = vectors.astype(np.float32)
        error = (vectors.shape[1] + 8) * 1.2e-7 * self.norm * np.linalg.norm(vectors, axis=1).max() + 1.1e-6
        for r in range(0, len(ids), TILE[1]):
            ats, rows = [], []
            for q in range(0, len(self.ids), TILE[0]):
                s, one = self.small[q : q + TILE[0]] @ small[r : r + TILE[1]].T, slice(q, q + TILE[0])
                fresh = np.isneginf(self.low[one])
                if fresh.any() and s.shape[1] > self.k:
                    s[self.ids[one, None] == ids[None, r : r + TILE[1]]] = -np.inf
                    kth = np.partition(s, -self.k, axis=1)[:, -self.k] - 2 * error[one]
                    self.low[one] = np.where(fresh, kth + error[one], self.low[one])
                found = np.flatnonzero(~(s < (self.low[one] - error[one])[:, None]))
                ats.append(found // s.shape[1] + q)
                rows.append(found % s.shape[1] + r)
            self.merge(np.concatenate(ats), np.concatenate(rows), ids, vectors)

    def merge(self, at, row, ids, vectors, step: int = 1 << 18):
        import numpy as np

        other = self.ids[at] != ids[row]
        at, row = at[other], row[other]
        score = np.concatenate([np.einsum("ij,ij->i", self.v[at[i : i + step]], vectors[row[i : i + step]]) for i in range(0, len(at), step)] or [np.empty(0)])
        at, row, score = np.concatenate([self.at, at]), np.concatenate([self.row, ids[row]]), np.concatenate([self.score, half_away(score)])
        order = np.lexsort((row, -score, at))
        at, row, score = at[order], row[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.at, self.row, self.score = (x[place < self.k] for x in (at, row, score))
        last = place == self.k - 1
        self.low[at[last]] = np.maximum(self.low[at[last]], score[last])


def exact_neighbours(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """vec_id, neighbor, score, place: the k nearest rows by inner product for a stated query set, blocks of queries against blocks of rows.

    Every pair is scored. A task holds one block of queries with their best rows, meets MET blocks of rows and gives k
    rows for each query at its end; so its memory is bounded and few rows are shuffled. Work grows with queries times rows.
    """

    def score(batches):
        import numpy as np
        import pyarrow as pa

        def out(best):
            return pa.RecordBatch.from_pydict({"vec_id": best.ids[best.at], "neighbor": best.row, "score": best.score})

        best, held = None, None
        for batch in batches:
            for pair in batch.to_pylist():
                asked, given = ((np.frombuffer(pair[f"{side}ids"], np.int64), np.frombuffer(pair[f"{side}vectors"]).reshape(-1, pair[f"{side}width"])) for side in ("", "given_"))
                if held != pair["block"]:
                    if best is not None:
                        yield out(best)
                    best, held = Best(*asked, k), pair["block"]
                best.add(*given)
        if best is not None:
            yield out(best)

    n, m = count_blocks(queries), count_blocks(rows)
    given = blocks(rows, m).toDF("given", "given_ids", "given_vectors", "given_width")
    parts = -(-m // MET)
    pairs = blocks(queries, n).repartitionById(n, F.col("block")).join(given.repartitionById(parts, F.pmod("given", F.lit(parts))).drop("given").hint("shuffle_replicate_nl"))
    best = pairs.mapInArrow(score, "vec_id bigint, neighbor bigint, score double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def centroid_distances(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """first_label, last_label, distance: cosine distances of the groups' mean vectors, 0 with a zero vector."""
    means = rows.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    a, b = means.alias("a"), means.alias("b")
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col(f"a.{group}") < F.col(f"b.{group}")))
    dot = lambda x, y: F.sum(F.col(f"{x}.m") * F.col(f"{y}.m"))
    return pairs.groupBy(F.col(f"a.{group}").alias("first_label"), F.col(f"b.{group}").alias("last_label")).agg(F.round(F.coalesce(1 - dot("a", "b") / F.nullif(F.sqrt(dot("a", "a") * dot("b", "b")), F.lit(0.0)), F.lit(0.0)), 6).alias("distance"))
