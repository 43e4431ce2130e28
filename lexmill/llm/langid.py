"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased and every run of characters that are not letters becomes one blank. For
each language a model of order 4 is learned from all training rows: counts of 4-grams for each
language are summed in the tasks and shuffled as (language, 4-gram, count); lower orders are
continuation counts, which follow from the distinct n-grams of the order above. An n-gram of up to
four characters is one 64-bit key (16 bits for each; characters outside the basic plane share one
code), and each order is a sorted array of keys with a column of log-probabilities for every
language. The language with the lowest cross-entropy per character wins.

All n-grams of all training rows are counted, and continuation counts, discounts and context totals
are taken over all of them in Spark. Where they are more than the memory that the model may take in
a worker (most_cells numbers), the n-grams with the lowest counts go; what they had goes to the
back-off weight of their context, so that the model stays a distribution.

The score is calibrated: a logistic curve of the margin to the runner-up, fitted on the training rows
with the lowest hashes (a twentieth of them, calibration_rows at most) as a model without
these rows judges them. rejected marks scores under reject_below and texts whose cross-entropy is far
above what the winner's own texts have there.

Defined results: a null text, or one without a letter, is "und" with score 0. Ties go to the first
language by name. Without any training row everything is "und"; an empty table has no rows. Texts of
any length are read whole. Repeated rows are repeated; other columns, whatever their names, are
ignored. Reruns agree, however the rows are dealt.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import map_lists, written

ORDER = 4
BLANK = 32


@dataclass(frozen=True)
class LangParams:
    most_cells: int = 16_000_000  #: of the model: n-grams of all orders times languages
    calibration_rows: int = 2_000
    reject_below: float = 0.5
    reject_nats: float = 1.5  #: cross-entropy above the winner's typical one


_KINDS: np.ndarray | None = None


def _kinds() -> np.ndarray:
    """Of each code of the basic plane: 2 a letter, 1 a mark, 0 another. Code 0xFFFF stands for letters above the plane."""
    global _KINDS
    if _KINDS is None:
        import unicodedata

        table = np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x10000)), np.uint8, 0x10000)
        table[0xFFFF] = 2
        _KINDS = table
    return _KINDS


def codes(text: str | None) -> np.ndarray:
    """The text as 16-bit codes: letters in lower case, one blank for each run of others, three blanks before and one after. Empty if no letter."""
    if not text:
        return np.empty(0, np.uint64)
    low = text.lower()
    raw = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    above = np.flatnonzero(raw >= 0xFFFF)
    if len(above):
        raw = raw.copy()
        raw[above] = [0xFFFF if low[i].isalpha() else BLANK for i in above]
    kind = _kinds()[raw]
    if not (kind == 2).any():
        return np.empty(0, np.uint64)
    raw = np.concatenate(([BLANK], np.where(kind > 0, raw, BLANK), [BLANK]))
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != BLANK) | (raw[:-1] != BLANK)
    return np.concatenate(([BLANK] * (ORDER - 2), raw[keep])).astype(np.uint64)


def grams(code: np.ndarray) -> np.ndarray:
    """Keys of the 4-grams: one for each character after the first blanks."""
    if len(code) < ORDER:
        return np.empty(0, np.uint64)
    out = code[: len(code) - ORDER + 1].copy()
    for i in range(1, ORDER):
        out = (out << np.uint64(16)) | code[i : len(code) - ORDER + 1 + i]
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def count_ngrams(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over training(lang, text), summed in each batch before the shuffle."""

    def count(batch: dict) -> dict:
        waiting: dict[str, list[np.ndarray]] = {}
        done: dict[str, list] = {}

        def settle(lang: str) -> None:
            if parts := waiting.pop(lang, None):
                done.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))

        for lang, text in zip(batch["lang"], batch["text"]):
            waiting.setdefault(lang, []).append(grams(codes(text)))
            if sum(map(len, waiting[lang][-1:])) > 1 << 20 or len(waiting[lang]) >= 256:
                settle(lang)
        for lang in list(waiting):
            settle(lang)
        out: dict = {"lang": [], "gram": [], "n": []}
        for lang, parts in done.items():
            keys, n = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            out["lang"] += [lang] * len(keys)
            out["gram"] += keys.view(np.int64).tolist()
            out["n"] += n.tolist()
        return out

    return map_lists(training.select("lang", "text"), count, "lang string, gram bigint, n bigint", rows=None).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (16 * n)) - 1)


@dataclass
class Model:
    """Sorted arrays by order: keys and their log-probabilities, contexts and their log back-off weights (a column for each language)."""

    langs: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    floor: np.ndarray | None = None
    curve: tuple[float, float] = (0.0, 1.0)
    usual: np.ndarray | None = None

    def entropies(self, code: np.ndarray) -> np.ndarray:
        """Mean negative log-probability of a character in each language."""
        wanted = grams(code)
        ordered = np.sort(wanted)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        keys, n = ordered[first], np.diff(np.append(first, len(ordered))).astype(float)
        total, carried = np.zeros(len(self.langs)), np.zeros((len(keys), len(self.langs)))
        for order in range(ORDER, 0, -1):
            at, hit = _found(self.keys[order], keys)
            if hit.any():
                total += n[hit] @ (self.logs[order][at[hit]] + carried[hit])
            keys, n, carried = keys[~hit], n[~hit], carried[~hit]
            if not len(keys):
                return -total / len(wanted)
            at, known = _found(self.contexts[order], keys >> np.uint64(16))
            carried[known] += self.weights[order][at[known]]
            keys = keys & _mask(order - 1)
        return -(total + n @ (carried + self.floor)) / len(wanted)

    def judge(self, text: str | None) -> tuple[int, float, float] | None:
        """Index of the language, its cross-entropy and the margin in nats over the whole text; None without a letter."""
        code = codes(text)
        if not len(code) or not self.langs:
            return None
        h = self.entropies(code)
        best = int(np.argmin(h))
        rest = np.delete(h, best)
        margin = (rest.min() - h[best]) * (len(code) - ORDER + 1) if len(rest) else 50.0
        return best, float(h[best]), float(margin)

    def score(self, margin: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-min(max(a + b * math.log1p(max(margin, 0.0)), -50), 50)))


Table = tuple[np.ndarray, np.ndarray, np.ndarray]  #: of one order and language: sorted keys, counts, and the total of each key's context over all n-grams


def with_totals(keys: np.ndarray, n: np.ndarray) -> Table:
    contexts, at = np.unique(keys >> np.uint64(16), return_inverse=True)
    return keys, n, np.bincount(at, n, len(contexts))[at]


def discount(once: float, twice: float) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of {language: (sorted 4-gram keys, counts)}."""
    langs, tables, discounts = sorted(counts), {}, {}
    for lang in langs:
        keys, n = counts[lang][0].astype(np.uint64), counts[lang][1].astype(float)
        for order in range(ORDER, 0, -1):  # continuation counts: distinct n-grams of the order above with this ending
            tables[order, lang] = with_totals(keys, n)
            discounts[order, lang] = discount((n == 1).sum(), (n == 2).sum())
            keys, n = _summed(keys & _mask(order - 1), np.ones(len(keys)))
    return fitted(langs, tables, discounts)


def without(tables: dict[tuple[int, str], Table], sample: dict[str, np.ndarray]) -> dict[tuple[int, str], Table]:
    """tables less the 4-grams of sample {language: keys}; n-grams that thus vanish are continuations no more."""
    out = dict(tables)
    for lang, keys in sample.items():
        less, n = np.unique(keys, return_counts=True)
        for order in range(ORDER, 0, -1):
            own, counts, totals = tables[order, lang]
            at, hit = _found(own, less)
            left, rest = counts.copy(), totals.copy()
            left[at[hit]] -= n[hit]
            contexts, place = np.unique(own >> np.uint64(16), return_inverse=True)
            rest -= np.bincount(place, counts - left, len(contexts))[place]
            keep = left > 0
            out[order, lang] = own[keep], left[keep], rest[keep]
            less, n = np.unique(own[~keep] & _mask(order - 1), return_counts=True)
    return out


def fitted(langs: list[str], tables: dict[tuple[int, str], Table], discounts: dict[tuple[int, str], float]) -> Model:
    """The model of the tables of each order and language."""
    model = Model(langs)
    alphabet = len(np.unique(np.concatenate([tables[1, x][0] for x in langs]))) + 1
    model.floor = np.full(len(langs), -math.log(alphabet))
    model.keys[0], model.logs[0] = np.zeros(1, np.uint64), model.floor[None, :]
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([tables[order, x][0] for x in langs]))
        contexts = np.unique(keys >> np.uint64(16))
        weights = np.zeros((len(contexts), len(langs)))
        mass, total = np.zeros((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
        for j, lang in enumerate(langs):
            k, n, sums = tables[order, lang]
            less = discounts[order, lang]
            at = np.searchsorted(contexts, k >> np.uint64(16))
            total[at, j] = sums
            given = np.bincount(at, n - less, len(contexts))  # the rest of a context's total goes to the order below
            seen = np.bincount(at, minlength=len(contexts)) > 0
            weights[seen, j] = np.log(np.maximum(1 - given[seen] / total[seen, j], 1e-12))
            mass[np.searchsorted(keys, k), j] = n - less
        at = np.searchsorted(contexts, keys >> np.uint64(16))
        # what the order below gives to the ending of each key
        below, carried, left = keys & _mask(order - 1), np.zeros((len(keys), len(langs))), np.arange(len(keys))
        for lower in range(order - 1, -1, -1):
            spot, hit = _found(model.keys[lower], below[left])
            carried[left[hit]] += model.logs[lower][spot[hit]]
            left = left[~hit]
            if not len(left):
                break
            spot, known = _found(model.contexts[lower], below[left] >> np.uint64(16))
            carried[left[known]] += model.weights[lower][spot[known]]
            below = below & _mask(lower - 1)
        model.keys[order], model.contexts[order], model.weights[order] = keys, contexts, weights
        model.logs[order] = np.log(mass / total[at] + np.exp(weights[at] + carried))
    return model


def calibrated(model: Model, judge: Model, sample: list[tuple[str, str]]) -> Model:
    """model with the curve of the score, fitted on pieces of 8 to 64 characters and whole texts of sample, and the usual cross-entropies, as judge sees them."""
    x, y, own = [], [], {}
    for lang, text in sample:
        for size in (8, 16, 32, 64, None):
            if found := judge.judge(text[:size] if size else text):
                x.append(math.log1p(max(found[2], 0.0)))
                y.append(judge.langs[found[0]] == lang)
                if size is None:
                    own.setdefault(lang, []).append(found[1])
    right, wrong = sum(y), len(y) - sum(y)
    target = np.where(np.array(y, bool), (right + 1) / (right + 2), 1 / (wrong + 2))
    design = np.column_stack([np.ones(len(x)), x]) if x else np.empty((0, 2))
    w = np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hessian, design.T @ (target - p) - 1e-3 * (w - [0.0, 1.0]))
    model.curve = (float(w[0]), float(max(w[1], 0.0)))
    model.usual = np.array([float(np.median(own[x])) if x in own else math.inf for x in model.langs])
    return model


def all_orders(counted: DataFrame) -> DataFrame:
    """(order, lang, gram, n, total) of counted(lang, gram, n): n is a continuation count below the highest order, total its context's sum."""
    tables, above = [counted.select(F.lit(ORDER).alias("order"), "lang", "gram", "n")], counted
    for order in range(ORDER - 1, 0, -1):
        above = above.groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(_mask(order)))).alias("gram")).agg(F.count("*").alias("n"))
        tables.append(above.select(F.lit(order).alias("order"), "lang", "gram", "n"))
    out = reduce(DataFrame.unionAll, tables)
    context = Window.partitionBy("order", "lang", F.shiftrightunsigned("gram", 16))
    return out.withColumn("total", F.sum("n").over(context))


def learn(training: DataFrame, params: LangParams = LangParams()) -> Model:
    """The model of training(doc_id, lang, text): all rows are counted, a bounded sample calibrates the score."""
    training = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    tables = written(all_orders(written(count_ngrams(training), "langid-counts")), "langid")
    size = F.floor(F.log2("n")).cast("int")
    classes = tables.groupBy("order", "lang", size.alias("size")).agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
    if not classes:
        return Model([])
    langs = sorted({r["lang"] for r in classes})
    least, discounts = {}, {}
    for order in range(1, ORDER + 1):
        here = [r for r in classes if r["order"] == order]
        fits = [x for x in range(65) if len(langs) * sum(r["k"] for r in here if r["size"] >= x) <= params.most_cells // ORDER]
        least[order] = 1 << fits[0]
        for lang in langs:
            own = [r for r in here if r["lang"] == lang]
            discounts[order, lang] = discount(sum(r["once"] for r in own), sum(r["twice"] for r in own))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("order"))
    found = tables.where(F.col("n") >= limit).toPandas().sort_values(["order", "lang"])
    kept: dict[tuple[int, str], Table] = {(order, lang): (np.empty(0, np.uint64), np.empty(0), np.empty(0)) for order in least for lang in langs}
    for (order, lang), part in found.groupby(["order", "lang"]):
        keys = part["gram"].to_numpy().view(np.uint64)
        at = np.argsort(keys)
        kept[order, lang] = keys[at], part["n"].to_numpy(float)[at], part["total"].to_numpy(float)[at]
    total = training.count()
    rows = min(params.calibration_rows, total // 20)
    # the threshold lets about twice the rows through, whatever the number of partitions; the order makes them the same in every run
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    low = training.where(place < int((1 << 40) * min(1.0, 2 * rows / max(1, total)))).orderBy(place, "doc_id", "text", "lang")
    picked = low.select("lang", "text").limit(rows).collect() if rows else []
    left_out: dict[str, list[np.ndarray]] = {}
    for r in picked:
        left_out.setdefault(r["lang"], []).append(grams(codes(r["text"])))
    rest = without(kept, {lang: np.concatenate(parts) for lang, parts in left_out.items()})
    known = [x for x in langs if len(rest[1, x][0])]
    judge = fitted(known, rest, discounts) if known else Model([])
    return calibrated(fitted(langs, kept, discounts), judge, [(r["lang"], r["text"]) for r in picked])


def predict(docs: DataFrame, model: Model, params: LangParams = LangParams()) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected for each row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: dict) -> dict:
        m = sent.value
        out: dict = {name: [] for name in ("doc_id", "lang_pred", "score", "cross_entropy", "rejected")}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            found = m.judge(text)
            row = (doc_id, "und", 0.0, None, True)
            if found:
                score = m.score(found[2])
                row = (doc_id, m.langs[found[0]], score, found[1], score < params.reject_below or found[1] > m.usual[found[0]] + params.reject_nats)
            for name, value in zip(out, row):
                out[name].append(value)
        return out

    return map_lists(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out() -> "F.Column":
    """Whether a row is kept from learning: crc32 of doc_id as text (null: empty) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, params: LangParams = LangParams()) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    model = learn(docs.where(~held_out()).select("doc_id", "lang", "text"), params)
    return predict(docs, model, params).withColumn("held_out", held_out())
