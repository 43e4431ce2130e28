"""N-gram Jaccard join of documents under several global token orders.

A document's tokens are the hashes of its distinct five-word shingles. Two documents link when
100 * |intersection| >= 80 * |union|. Under any order of all tokens, linked documents share a token
among the first n - ceil(0.8 n) + 1 of each. Three orders are used; candidates come from the first
and must share prefix tokens under the other two as well, before their whole sets are compared.

All orders put frequent tokens last (a bitmap says which; any bitmap is right, a good one keeps
passages that many documents share out of the prefixes) and are pseudo-random otherwise. Tokens are
counted where a task's share has them often enough, and all tokens of every 64th distinct text by
hash are counted besides, so that a passage that is thinly spread over very many documents is found.
If a document has enough tokens that are not frequent, its prefix is cut where a link would be
missed with a probability under 1e-15 over the random order, as rare as a clash of token hashes;
with miss=0 prefixes have their full exact length.

No bucket of a token is expanded into pairs. First every member is compared with its bucket's
leader, the document with the fewest rare tokens: in a group of near copies that is the one nearest
to their common source. Components of these links are found; then only pairs across components are
left, and of those only pairs with a member outside its bucket's largest component, within the
bounds on size and position. So a large group costs what it has members, and no link is lost.

Equal sets are one class from the start, under its smallest doc_id.

Defined results: a null or empty text, or one without words, has no shingles and links with
nothing; with fewer than five words the whole sequence is the one shingle; rows with the same
doc_id are one document with several texts; rows without doc_id link with nothing; an empty table
has no rows. Texts of any length are read whole. Other columns stay (keep_one) or are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import bitmap, map_lists, replaced, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
EVERY = 64  #: of so many distinct texts, one has all its tokens counted
ORDERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    percent: int = 80
    frequent: int = 48  #: documents from which on a token is frequent
    local: int = 3  #: documents of a token in one task's share from which on it is counted
    sampled: int = 16  #: documents of a token among every 64th from which on it is frequent, too
    most_bits: int = 28  #: log2 of the cells of a bitmap at most; its size follows what it holds
    miss: float = 1e-15  #: 0: exact prefixes


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)] if found else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out = np.zeros(len(found) - words + 1, np.uint64)
    for i in range(words):
        out = (out ^ h[i : i + len(out)]) * STEPS[i % len(STEPS)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def least_overlap(n: Column, percent: int) -> Column:
    """How many tokens documents with n tokens together must share."""
    return F.ceil(n * F.lit(percent) / F.lit(100 + percent))


def prefix_lengths(n: int, rare: int, params: JaccardParams) -> tuple[int, int]:
    """Prefix length of a document as either side of a pair, and as the smaller side."""
    probe = n - -(-params.percent * n // 100) + 1
    index = n - -(-2 * params.percent * n // (100 + params.percent)) + 1
    gone = (100 - params.percent) / params.percent * n  # at most this many tokens are in one document alone
    if params.miss > 0 and rare > 1.2 * gone:
        probe = min(probe, math.ceil(math.log(params.miss) / math.log(gone / rare)))
    return probe, min(index, probe)


def surveyed(docs: DataFrame, params: JaccardParams) -> DataFrame:
    """Rows (doc_id, n, print) of documents and rows (token, n, m) of tokens that are frequent in one task's share or in a sampled text, in one pass.

    n counts a token's texts in the share if they are many enough (else 0), m its sampled ones.
    """

    def run(batch_rows: list, held: list, done: set) -> None:
        for doc_id, text in batch_rows:
            tokens = shingles(text, params.words)
            digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
            held.append((doc_id, len(tokens), digest, None if digest in done or digest is None else tokens))
            done.add(digest)

    schema = "doc_id bigint, n bigint, print binary, token bigint, m bigint"

    def survey(batches):
        import pyarrow as pa

        types = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("token", pa.int64()), ("m", pa.int64())])
        parts, some, size, done = [], [np.empty(0, np.uint64)], 0, set()

        def tokens_out():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            chosen, k = np.unique(np.concatenate(some), return_counts=True)
            m = np.zeros(len(keys), np.int64)
            m[np.searchsorted(keys, chosen)] = k
            n[n < params.local] = 0
            kept = (n > 0) | (m > 0)
            none = [None] * int(kept.sum())
            return pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(n[kept], pa.int64()), pa.array(none, pa.binary()), pa.array(keys[kept].view(np.int64)), pa.array(m[kept], pa.int64())], schema=types)

        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            held: list = []
            run(list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())), held, done)
            new = [t for *_, t in held if t is not None]
            parts += new
            some += [t for *_, digest, t in held if t is not None and digest[0] < 256 // EVERY]
            size += sum(map(len, new))
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], types.field(i).type) for i in range(3)] + [pa.array([None] * len(held), pa.int64())] * 2, schema=types)
            if size > 3_000_000:
                yield tokens_out()
                parts, some, size = [], some[:1], 0
        if parts:
            yield tokens_out()

    return docs.select("doc_id", "text").mapInArrow(survey, schema)


def bits_for(rows: int, params: JaccardParams) -> int:
    """log2 of the cells of a bitmap that rows leave mostly empty, within the bound."""
    return min(params.most_bits, max(16, math.ceil(math.log2(max(rows, 1))) + 5))


def frequent_bitmap(survey: DataFrame, params: JaccardParams) -> bytes:
    """The bitmap of frequent tokens."""
    tokens = survey.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    tokens = written(tokens.where((F.col("n") >= params.frequent) | (F.col("m") >= params.sampled)).select("token"), "frequent")
    bits = bits_for(tokens.count(), params)
    return bitmap(tokens.select(F.pmod("token", F.lit(1 << bits))), bits)


def prefixes(docs: DataFrame, frequent: bytes, params: JaccardParams) -> DataFrame:
    """(doc_id, print, n, rare, index, p0, p1, p2): prefix tokens under each order; index is the smaller side's length in p0."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    mask = np.uint64(8 * len(frequent) - 1)

    def run(batch: dict) -> dict:
        bits = np.frombuffer(sent.value, np.uint8)
        out: dict = {name: [] for name in ("doc_id", "print", "n", "rare", "index", "p0", "p1", "p2")}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            tokens = shingles(text, params.words)
            n = len(tokens)
            if not n:
                continue
            cell = tokens & mask
            often = (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
            rare = n - int(often.sum())
            probe, index = prefix_lengths(n, rare, params)
            row = [doc_id, hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), n, rare, index]
            for step in ORDERS:
                rank = tokens * step
                rank ^= rank >> np.uint64(31)
                rank *= STEPS[1]
                if rare >= probe:  # the rare tokens are enough
                    some, key = tokens[~often], rank[~often]
                    order = np.argpartition(key, probe - 1)[:probe]
                    order = order[np.argsort(key[order])]
                else:
                    some, order = tokens, np.lexsort((rank, often))[:probe]
                row.append(some[order].view(np.int64).tolist())
            for name, value in zip(out, row):
                out[name].append(value)
        return out

    return map_lists(docs.select("doc_id", "text"), run, "doc_id bigint, print binary, n bigint, rare bigint, index int, p0 array<bigint>, p1 array<bigint>, p2 array<bigint>")


def compared(docs: DataFrame, pairs: DataFrame, params: JaccardParams) -> DataFrame:
    """The rows of pairs(a, b) that link, by their whole sets. Only documents of pairs are read into sets."""
    bits = bits_for(2 * pairs.count(), params)
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(cell("id")), bits))

    def read(batch: dict) -> dict:
        flags = np.frombuffer(sent.value, np.uint8)
        hit = [(i, t) for i, t, c in zip(batch["doc_id"], batch["text"], batch["cell"]) if c is not None and flags[c >> 3] >> (c & 7) & 1]
        return {"id": [i for i, _ in hit], "tokens": [shingles(t, params.words).tobytes() for _, t in hit]}

    read_in = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", cell("doc_id").alias("cell"))
    sets = map_lists(read_in, read, "id bigint, tokens binary")
    sets = sets.where(F.length("tokens") > 0)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def judge(batch: dict) -> dict:
        out: dict = {"a": [], "b": []}
        for a, b, x, y in zip(batch["a"], batch["b"], batch["a_tokens"], batch["b_tokens"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= params.percent * (len(x) + len(y) - shared):
                out["a"].append(a), out["b"].append(b)
        return out

    return map_lists(both, judge, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the ids of edges(a, b): comp is the smallest id reachable. Labels pass along edges and are followed to their own labels."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("low"))
        lower = labels.join(near, "id").select("id", "comp", F.least("comp", "low").alias("low"))
        onward = labels.select(F.col("id").alias("low"), F.col("comp").alias("root"))
        new = replaced(labels, lower.join(onward, "low", "left").select("id", F.least("low", F.coalesce("root", "low")).alias("comp"), (F.coalesce("root", "low") < F.col("comp")).alias("moved")), "labels")
        labels = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return labels


def passing(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of pairs(a, b) that share prefix tokens under the second and third order, too."""
    side = lambda x: lists.select(F.col("rep").alias(x), F.col("p1").alias(f"{x}1"), F.col("p2").alias(f"{x}2"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2")).select("a", "b").distinct()


def linked_classes(docs: DataFrame, classes: DataFrame, params: JaccardParams) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes that connect all that is linked, and (id, comp) of the classes with links."""
    lists = classes.select("rep", "p1", "p2")
    posts = classes.select("rep", "n", "rare", "index", F.posexplode("p0").alias("pos", "token"))
    heads = posts.groupBy("token").agg(F.min(F.struct("rare", "rep")).alias("head"), F.count("*").alias("members")).where(F.col("members") > 1)
    shared = written(posts.join(heads.select("token", F.col("head.rep").alias("leader")), "token"), "postings")
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = shared.where("rep != leader").select(*ordered("rep", "leader")).distinct()
    first = written(compared(docs, written(passing(stars, lists), "stars"), params), "links")
    comps = components(first)

    named = shared.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    open_ = named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("token")
    named = written(named.join(open_, "token", "left_semi").select("token", "rep", "n", "pos", "index", "comp"), "postings")
    largest = named.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    minor = named.join(largest, "token").where("comp != main").drop("main")
    x, y = minor.alias("x"), named.alias("y")
    small = lambda s, g: (F.col(f"{s}.n") <= F.col(f"{g}.n")) & (F.col(f"{s}.pos") < F.col(f"{s}.index")) & (100 * F.col(f"{s}.n") >= params.percent * F.col(f"{g}.n"))
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = rest >= least_overlap(F.col("x.n") + F.col("y.n"), params.percent)
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & (small("x", "y") | small("y", "x")) & fits)
    pairs = across.select(*ordered("x.rep", "y.rep")).distinct().join(stars, ["a", "b"], "left_anti")
    more = compared(docs, written(passing(pairs, lists), "across"), params)
    links = written(first.unionAll(more), "links")
    return links, components(links)


def near_duplicates(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id (smallest with an equal set) and class_links (links found of its class): a row for each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    survey = written(surveyed(docs, params), "survey")
    rows = survey.where(F.col("token").isNull()).select("doc_id", "n", "print")
    known = prefixes(docs.where(F.col("doc_id").isNotNull()), frequent_bitmap(survey, params), params)
    same = [F.first(c).alias(c) for c in ("n", "rare", "index", "p0", "p1", "p2")]
    classes = written(known.groupBy("print").agg(F.min("doc_id").alias("rep"), *same), "classes")
    links, comps = linked_classes(docs, classes, params)
    # rows of one doc_id with several texts are one document
    class_of = classes.select("print", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("class_links"))
    out = rows.join(class_of.join(degree, "class_id", "left"), "print", "left").where(F.lit(True))
    lone = F.col("class_id").isNull() | F.col("doc_id").isNull()
    own = lambda c: F.when(lone, F.col("doc_id")).otherwise(F.col(c))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id").alias("component_id"), own("class_id").alias("class_id"), F.coalesce("class_links", F.lit(0)).alias("class_links"))


def keep_one(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """The rows of docs that stay when one document of each component does: the one with the smallest doc_id. Rows without doc_id stay."""
    found = near_duplicates(docs, params)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # rows without doc_id are no group: they are dealt by their text
    rank = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text")))
    names = docs.columns
    held = left.select(F.struct(*names).alias("row"), "doc_id", "text").withColumn("rank", F.when(F.col("doc_id").isNull(), 1).otherwise(rank))
    return held.where("rank = 1").select("row.*")
