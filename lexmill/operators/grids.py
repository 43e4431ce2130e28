"""Paradigm grids: the forms of every lemma in cells of tense and mood by person, or of number by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of the cells. A column holds a form that has all tags of the left side of one of its
# pairs and none of the right; the first column that does counts.
GENDERS = ["masculine", "feminine", "neuter"]
NON_FINITE = ["participle", "infinitive", "infinitive-aorist", "gerund"]
PARTICLES = ["να", "θα", "ας", "μη", "μην", "δεν", "δε"]
VERB_COLUMNS = {
    "present": [("present", "past imperfect future dependent subjunctive imperative perfect pluperfect")],
    "imperfect": [("imperfect", "future subjunctive imperative")],
    "future imperfective": [("future imperfective", "perfect"), ("future imperfect", "perfect")],
    "aorist": [("aorist", "imperfect future subjunctive imperative"), ("past perfective", "imperfect future subjunctive imperative")],
    "future perfective": [("future perfective", ""), ("future", "imperfect imperfective perfect subjunctive")],
    "perfect": [("perfect", "future subjunctive imperative")],
    "pluperfect": [("pluperfect", "")],
    "future perfect": [("future perfect", "")],
    "subjunctive imperfective": [("subjunctive imperfective", "perfect"), ("dependent imperfective", "perfect")],
    "subjunctive perfective": [("subjunctive perfective", "perfect"), ("dependent perfective", "perfect")],
    "subjunctive perfect": [("subjunctive perfect", "")],
    "subjunctive": [("subjunctive", "imperfective perfective perfect"), ("dependent", "imperfective perfective perfect")],
    "imperative imperfective": [("imperative imperfective", "")],
    "imperative perfective": [("imperative perfective", "")],
    "imperative": [("imperative", "imperfective perfective")],
}
VERB_ROWS = {f"{p} {n}": [(f"{p}-person {n}", "")] for n in ("singular", "plural") for p in ("first", "second", "third")}
NOMINAL_COLUMNS = {n: [(n, "")] for n in ("singular", "plural")}
NOMINAL_ROWS = {c: [(c, "")] for c in ("nominative", "genitive", "accusative", "vocative", "dative")}


def _has(tag: str) -> Column:
    return F.array_contains("tags", tag)


def _any(tags: list[str]) -> Column:
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))


def _tags(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _place(rules: dict[str, list[tuple[str, str]]]) -> Column:
    """The place of the first rule that the tags meet, or null."""
    found = F.lit(None).cast("int")
    for i, pairs in reversed(list(enumerate(rules.values()))):
        met = F.lit(False)
        for wanted, barred in pairs:
            one = F.lit(True)
            for t in wanted.split():
                one = one & _has(t)
            met = met | (one & ~_any(barred.split()) if barred else one)
        found = F.when(met, i).otherwise(found)
    return found


def _name(rules: dict, place: str) -> Column:
    return F.element_at(_tags(list(rules)), F.col(place) + 1)


def prepared(forms: DataFrame, lemmas: DataFrame) -> DataFrame:
    """lemma_id, seq, form, source, tags, is_verb: what can stand in a grid.

    Transliterations and debris of tables go. A canonical form stands for the first cell, without the
    Latin words behind it; the lemma itself is added before all others (seq -1, empty source), since
    tables leave it out.
    """
    is_verb = F.lower(F.coalesce("pos", F.lit(""))).contains("verb")
    heads = lemmas.select("lemma_id", "lemma", is_verb.alias("is_verb"))
    lower = F.transform(F.coalesce("features", F.array().cast("array<string>")), F.lower)
    rows = forms.select("lemma_id", "seq", "form", "source", lower.alias("tags")).where("form is not null").join(heads.drop("lemma"), "lemma_id")
    rows = rows.where(~_any(["romanization", "romanized"]))

    plain = F.regexp_replace(F.btrim("form"), r"\s+", " ")
    behind = F.lower(F.regexp_extract(plain, "((?: [A-Za-z]+)+)$", 1))
    voice = F.when(F.array_contains(F.split(behind, " "), "passive"), "passive").otherwise("active")
    gender = F.slice(F.filter("tags", lambda t: t.isin(GENDERS)), 1, 1)
    first_cell = F.when(F.col("is_verb"), F.concat(_tags(["indicative", "present", "first-person", "singular"]), F.array(voice))).otherwise(F.concat(_tags(["nominative", "singular"]), gender))
    canonical = _has("canonical")
    rows = rows.select("lemma_id", "seq", F.when(canonical, F.regexp_replace(plain, "(?: [A-Za-z]+)+$", "")).otherwise(F.col("form")).alias("form"), "source", F.when(canonical, first_cell).otherwise(F.col("tags")).alias("tags"), "is_verb")
    clean = rows.where((F.length(F.btrim("form")) >= 2) & ~F.col("form").contains(",") & ~F.col("form").rlike("[A-Za-z]") & ~_has("type-b"))

    gendered = clean.groupBy("lemma_id").agg(F.bool_or(_any(GENDERS)).alias("gendered"))
    seed = F.when(F.col("is_verb"), _tags(["present", "indicative", "active", "first-person", "singular", "imperfective"])).when(F.col("gendered"), _tags(["nominative", "singular", "masculine"])).otherwise(_tags(["nominative", "singular"]))
    seeds = heads.where("lemma is not null").join(gendered, "lemma_id", "left").select("lemma_id", F.lit(-1).cast(clean.schema["seq"].dataType).alias("seq"), F.col("lemma").alias("form"), F.lit("").alias("source"), seed.alias("tags"), "is_verb")
    return clean.unionByName(seeds)


def with_aspect(rows: DataFrame) -> DataFrame:
    """Verb forms of the subjunctive and imperative without an aspect take that of the lemma's first form with
    the same text, particles left out; a subjunctive with the auxiliary of the perfect is one of the perfect."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim("form"), r"\s+", " "), f"(?iu)^(?:(?:{'|'.join(PARTICLES)}) )+", "")
    rows = rows.withColumn("bare", bare)
    aspect = F.when(_has("imperfective"), "imperfective").when(_has("perfective"), "perfective")
    known = rows.where(aspect.isNotNull()).select("lemma_id", "seq", aspect.alias("aspect"), F.posexplode(F.array("form", "bare")).alias("n", "text"))
    known = known.groupBy("lemma_id", "text").agg(F.min_by("aspect", F.struct("seq", "n", "aspect")).alias("aspect"))
    by = lambda c: known.select("lemma_id", F.col("text").alias(c), F.col("aspect").alias(f"{c}_aspect"))
    both = rows.join(by("form"), ["lemma_id", "form"], "left").join(by("bare"), ["lemma_id", "bare"], "left")
    found = F.when(_has("subjunctive") & F.col("bare").rlike("^(έχ|είχ)"), "perfect").otherwise(F.coalesce("form_aspect", "bare_aspect"))
    needs = F.col("is_verb") & aspect.isNull() & _any(["subjunctive", "imperative"]) & found.isNotNull()
    return both.withColumn("tags", F.when(needs, F.concat("tags", F.array(found))).otherwise(F.col("tags"))).select("lemma_id", "seq", "form", "source", "tags", "is_verb")


def grids(forms: DataFrame, lemmas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rest) of forms(lemma_id, seq, form, source, features) and lemmas(lemma_id, lemma, pos).

    cells: lemma_id, part (a verb's voice, another word's gender, empty without one), row, column, their
    places, text (forms in order, each once), sources, generated (every form of the cell is made by
    rule). rest: forms of no cell, non_finite set for participles and the like; none is lost. Null tags
    are no tags; forms without text or lemma go.
    """
    rows = with_aspect(prepared(forms, lemmas))
    gender = F.coalesce(*[F.when(_has(g), g) for g in GENDERS], F.lit(""))
    part = F.when(F.col("is_verb"), F.when(_has("passive"), "passive").otherwise("active")).otherwise(gender)
    either = lambda verb, other: F.when(F.col("is_verb"), verb).otherwise(other)
    placed = rows.withColumn("part", part).withColumn("column_place", either(_place(VERB_COLUMNS), _place(NOMINAL_COLUMNS))).withColumn("row_place", either(_place(VERB_ROWS), _place(NOMINAL_ROWS)))
    fits = F.col("column_place").isNotNull() & F.col("row_place").isNotNull()
    named = placed.where(fits).withColumn("row", either(_name(VERB_ROWS, "row_place"), _name(NOMINAL_ROWS, "row_place"))).withColumn("column", either(_name(VERB_COLUMNS, "column_place"), _name(NOMINAL_COLUMNS, "column_place")))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "form"))), lambda x: x["form"]))
    by_rule = F.bool_and(F.coalesce("source", F.lit("")) == "generated")
    sources = F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source"))))
    cells = named.groupBy("lemma_id", "part", "row", "column", "row_place", "column_place").agg(F.array_join(texts, " / ").alias("text"), sources.alias("sources"), by_rule.alias("generated"))
    rest = placed.where(~fits).select("lemma_id", "seq", "form", "source", F.col("tags").alias("features"), _any(NON_FINITE).alias("non_finite"))
    return cells, rest
