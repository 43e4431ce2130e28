"""Quality rules by distribution divergence.

Each document is held against language references: the share of its characters in classes, the
share of its words among each of the language's common words, and the share of them all together.
The distance is the Jensen-Shannon distance, the square root of the divergence in bits. References
are sums over the whole corpus, one row for each language, so the model has a fixed size. All of it
is DataFrame expressions.

Defined results: a null or empty text has no words and is rejected (too short); an empty table has no
rows; texts of any length are judged whole. A document whose lang is null is held against every
reference and takes the nearest; one whose lang has no reference is judged by the base rules alone.
The distance rules need min_words words (classes, all common words together) and min_common_words
words (each common word), below that they do not reject. Repeated rows are judged alike. Other
columns, whatever their names, are kept as they are by filter_quality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACES, clear_name, words, written

#: Frequent function words of each language, the cells of its word histogram.
COMMON_WORDS = {
    "de": "der die das und in zu den mit von ist nicht für auf ein eine im sich auch dem des".split(),
    "en": "the of and to in is that for was it with from by are be this at on or you".split(),
    "es": "de la que el en y los del las un por con no una su para lo se al es".split(),
    "fr": "le la les de des en et un une que qui est dans pour sur par pas au du avec".split(),
}
ALL_COMMON = sorted({w for ws in COMMON_WORDS.values() for w in ws})

#: Character classes: white space, the symbols of the base rules, capitals, digits, other ASCII marks, bytes beyond
#: the first of characters beyond ASCII, and the rest (letters, mostly).
CLASS_NAMES = ["space", "symbol", "upper", "digit", "mark", "wide", "other"]
PLAIN = "[^!-`{-~]+"  #: all but visible ASCII without small letters, of which a text has little
NO_SYMBOLS, NO_CAPITALS, NO_DIGITS = "[^#*$%&|<>]+", "[^A-Z]+", "[^0-9]+"


@dataclass(frozen=True)
class QualityParams:
    least_words: int = 50
    most_repeat_percent: int = 50
    char_limit: float = 0.22
    share_limit: float = 0.14
    word_limit: float = 0.3
    min_words: int = 50
    min_common_words: int = 200


def _only(column: str, outside: str) -> Column:
    return F.octet_length(F.regexp_replace(column, outside, "")).cast("bigint")


def with_counts(docs: DataFrame) -> DataFrame:
    """docs(text, lang, ...) with q_words, the counts of its character classes and of its common words.

    One regular expression goes over the text; the others go over the little that it leaves. q_common has the counts of
    the common words of the document's own language, or of ALL_COMMON if lang is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    forms = sorted({f for w in ALL_COMMON for f in (w, w[:1].upper() + w[1:])})
    out = docs.withColumn("q_words", words(F.col("text")))
    common = F.filter("q_words", lambda w: w.isin(forms))
    # each common word stands between two blanks of its own, so that removing " w " counts w
    out = out.withColumn("q_joined", F.lower(F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" "))))
    out = out.withColumn("q_rest", F.regexp_replace(text, PLAIN, "")).withColumn("q_size", F.octet_length("q_rest").cast("bigint"))
    out = out.withColumn("q_symbol", _only("q_rest", NO_SYMBOLS)).withColumn("q_upper", _only("q_rest", NO_CAPITALS)).withColumn("q_digit", _only("q_rest", NO_DIGITS))
    out = out.withColumn("q_mark", F.col("q_size") - F.col("q_symbol") - F.col("q_upper") - F.col("q_digit"))
    out = out.withColumn("q_length", F.length(text).cast("bigint")).withColumn("q_wide", F.octet_length(text) - F.col("q_length"))
    out = out.withColumn("n_words", F.size("q_words").cast("bigint"))
    out = out.withColumn("word_chars", F.aggregate("q_words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)))
    sets = F.when(F.col("lang").isNull(), _marks(ALL_COMMON))
    for lang, own in sorted(COMMON_WORDS.items()):
        sets = sets.when(F.col("lang") == lang, _marks(own))
    lost = lambda mark: F.octet_length("q_joined") - F.octet_length(F.replace("q_joined", mark, F.lit("")))
    counts = F.transform("q_marks", lambda mark: F.floor(lost(mark) / F.octet_length(mark)))
    out = out.withColumn("q_marks", sets.otherwise(F.array().cast("array<string>"))).withColumn("q_common", counts)
    out = out.withColumn("q_space", F.col("q_length") - F.col("word_chars"))
    out = out.withColumn("q_other", F.col("word_chars") - F.col("q_size"))
    return out.drop("q_joined", "q_marks", "q_rest", "q_size")


def _marks(own: list[str]) -> Column:
    return F.array(*[F.lit(f" {w} ") for w in own])


def references(counted: DataFrame, least_words: int = 50) -> dict[str, tuple[list[float], list[float]]]:
    """For each language with rows: shares of the character classes and of its common words (the rest of its words last).

    Sums over all documents of at least least_words words; one row for each of the fixed languages comes back.
    """
    most = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(f"q_{n}").alias(f"c{i}") for i, n in enumerate(CLASS_NAMES)] + [F.sum(F.get("q_common", F.lit(i))).alias(f"w{i}") for i in range(most)]
    seen = counted.where(F.col("lang").isin(sorted(COMMON_WORDS)) & (F.col("n_words") >= least_words))
    found = {}
    for row in seen.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect():
        chars = [row[f"c{i}"] for i in range(len(CLASS_NAMES))]
        own = [row[f"w{i}"] for i in range(len(COMMON_WORDS[row["lang"]]))]
        found[row["lang"]] = ([c / sum(chars) for c in chars], [c / row["n"] for c in own] + [(row["n"] - sum(own)) / row["n"]])
    return found


def _numbers(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance between an array of shares and fixed ones: the root of the divergence in bits."""

    def cell(p: Column, q: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
        return (part(p) + part(q)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(shares, _numbers(reference), cell), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def with_repeats(out: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words in three-word windows found twice or more.

    A window is a long with its hash above and its place below, so that equal windows are
    neighbours after a sort of plain longs; neighbours of equal hash are the same if their words
    are. The steps are columns of their own: a column that is used twice is computed once.
    """
    place = lambda x: f"cast({x} & (shiftleft(1L, q_bits) - 1) as int)"
    same = lambda y: f"coalesce(shiftrightunsigned(x ^ {y}, q_bits) = 0 AND slice(q_words, {place('x')} + 1, 3) = slice(q_words, {place(y)} + 1, 3), false)"
    out = out.withColumn("q_hash", F.expr("transform(q_words, w -> xxhash64(w))"))
    out = out.withColumn("q_bits", F.expr("cast(ceil(log2(size(q_hash) + 1)) as int) + 1"))
    windows = "transform(slice(q_hash, 1, greatest(size(q_hash) - 2, 0)), (x, i) -> coalesce(shiftleft(xxhash64(x, get(q_hash, i + 1), get(q_hash, i + 2)), q_bits) | cast(i as bigint), 0L))"
    out = out.withColumn("q_sorted", F.expr(f"sort_array({windows})"))
    near = " OR ".join(same(f"get(q_sorted, i {step})") for step in ("- 1", "+ 1", "- 2", "+ 2"))
    out = out.withColumn("q_places", F.expr(f"sort_array(transform(filter(q_sorted, (x, i) -> {near}), x -> x & (shiftleft(1L, q_bits) - 1)))"))
    covered = F.expr("aggregate(transform(q_places, (x, i) -> least(3L, coalesce(get(q_places, i + 1), x + 3) - x)), 0L, (a, x) -> a + x)")
    return out.withColumn("n_repeat_words", covered)


def measured(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """docs(text, lang, ...) with the counts of the base rules, base_failed and the histograms."""
    out = with_repeats(with_counts(docs))
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn("n_symbols", F.col("q_symbol")).withColumn("q_lines", lines)
    out = out.withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint"))
    failed = (F.col("n_words") < params.least_words) | (100 * F.col("n_repeat_words") > params.most_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("q_words", "q_hash", "q_bits", "q_sorted", "q_places", "q_lines")


def judged(out: DataFrame, refs: dict[str, tuple[list[float], list[float]]], params: QualityParams = QualityParams()) -> DataFrame:
    """measured() with the distances char_jsd, share_jsd and word_jsd (null without a reference) and kept."""
    n = F.col("n_words")
    chars = F.transform(F.array(*[F.col(f"q_{name}") for name in CLASS_NAMES]), lambda c: c / F.greatest(F.col("q_length") + F.col("q_wide"), F.lit(1)))
    found: dict[str, list[Column]] = {"char_jsd": [], "share_jsd": [], "word_jsd": []}
    for lang, (by_class, by_word) in sorted(refs.items()):
        at = _numbers([ALL_COMMON.index(w) for w in COMMON_WORDS[lang]])
        own = F.when(F.col("lang").isNull(), F.transform(at, lambda i: F.get("q_common", i))).otherwise(F.col("q_common"))
        shares = F.transform(own, lambda c: c / F.greatest(n, F.lit(1)))
        common = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        rest = F.greatest(1 - common, F.lit(0.0))
        values = {"char_jsd": distance(chars, by_class), "share_jsd": distance(F.array(common, rest), [1 - by_word[-1], by_word[-1]]), "word_jsd": distance(F.concat(shares, F.array(rest)), by_word)}
        for name, value in values.items():
            found[name].append(F.when(F.col("lang").isNull() | (F.col("lang") == lang), value))
    out = out.withColumns({name: F.array_min(F.array(*values)) if values else F.lit(None).cast("double") for name, values in found.items()})
    odd = (n >= params.min_words) & ((F.col("char_jsd") > params.char_limit) | (F.col("share_jsd") > params.share_limit))
    odd = odd | ((n >= params.min_common_words) & (F.col("word_jsd") > params.word_limit))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
    return out.drop(*[c for c in out.columns if c.startswith("q_")])


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_jsd", "share_jsd", "word_jsd", "base_failed", "kept"]


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id with counts, distances and verdict, a row for each row of docs(doc_id, text, lang).

    The texts are read once: the counts, a small fixed number for each row, are written to the
    shared folder, and both the references and the verdicts come from there.
    """
    counts = written(measured(docs.select("doc_id", "text", "lang"), params).drop("text"), "quality")
    return judged(counts, references(counts, params.least_words), params).select("doc_id", *RESULT)


def filter_quality(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    held = clear_name(docs, "whole_row")
    refs = references(with_counts(docs.select("text", "lang")), params.least_words)
    packed = docs.select(F.struct(*docs.columns).alias(held), "text", "lang")
    # the row number keeps the optimizer from pushing the filter down, which would compute each step of kept anew for every use of it
    out = judged(measured(packed, params), refs, params).withColumn("row_number", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("row_number") >= 0)).select(f"{held}.*")
