"""Dictionary dumps (JSON lines) to lexicon tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import fold_key_udf

#: Relation lists of an entry and the relation each stands for.
RELATIONS = {"synonyms": "synonym", "antonyms": "antonym", "hypernyms": "hypernym", "hyponyms": "hyponym", "derived": "derived", "derived_terms": "derived", "related": "related", "coordinate_terms": "related"}
#: Etymology templates by the relation that they state.
TEMPLATES = {"inh": "inherited", "inh+": "inherited", "der": "derived", "der+": "derived", "uder": "derived", "bor": "borrowed", "bor+": "borrowed", "lbor": "borrowed", "slbor": "borrowed", "cal": "calque", "calque": "calque", "clq": "calque", "cog": "cognate", "cogn": "cognate"}
#: Raw tags of descendants.
DESCENT = {"borrowed": "borrowed", "inherited": "inherited", "calque": "calque", "semi-calque": "calque", "derived": "derived", "transliteration": "borrowed"}
#: Endings that tell a verb form's voice.
PASSIVE = "ομαι όμαι εσαι έσαι εται έται όμαστε ομαστε όσαστε εστε έστε ονται ούνται ούμαι άμαι όμουν όσουν όταν όμασταν όσασταν ονταν όντουσαν όμουνα όσουνα ότανε όντανε ιέμαι ιέσαι ιέται ιόμαστε ιέστε ιούνται ιόμουν ιόσουν ιόταν ιόμουνα ιόσουνα ιότανε θηκα τηκα στηκα χτηκα φτηκα θήκαμε τήκαμε στήκαμε θηκες θηκε θήκατε θηκαν χτηκε φτηκε θεί τεί στεί χτεί φτεί θούμε θούν μένος μένη μένο".split()
ACTIVE = "ω εις ει ουμε ετε ουν α ες ε αμε ατε αν σω σεις σει ας ώ άς εί ούμε είτε ούν".split()
#: Glosses that only refer to another entry, and words that are no lookup key alone.
SKIPPED_GLOSS = r"(?i)\b(see|alternative (form|spelling) of|obsolete (form|spelling) of|synonym of|misspelling of|inflection of|genitive of|plural of|vocative of|accusative of|diminutive of|abbreviation of|initialism of|clipping of|contraction of|surname|given name)\b"
STOP_PHRASES = "of the a an to and or for in on at by with as from that this it its etc esp e.g".split()

GREEK = r"[Ͱ-Ͽἀ-῿]"
_WORDS = "array<struct<word:string>>"
_LISTS = ",".join(f"{k}:{_WORDS}" for k in RELATIONS)
ENTRY = (
    "word string, pos string, lang_code string, etymology_text string, etymology_templates array<struct<name:string,args:map<string,string>>>,"
    f"senses array<struct<glosses:array<string>,raw_glosses:array<string>,tags:array<string>,topics:array<string>,form_of:{_WORDS},examples:array<struct<text:string>>,{_LISTS}>>,"
    "forms array<struct<form:string,tags:array<string>>>, sounds array<struct<ipa:string>>,"
    "descendants array<struct<word:string,lang:string,lang_code:string,roman:string,raw_tags:array<string>,tags:array<string>>>,"
    + ",".join(f"{k} {_WORDS}" for k in RELATIONS)
    + ", _corrupt_record string"
)


def read_entries(spark: SparkSession, path: str, source: str) -> DataFrame:
    """All lines as entries; a line that is no JSON has _corrupt_record set. ord keeps the order of lines for first-arrival rules."""
    rows = spark.read.schema(ENTRY).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("source", F.lit(source)).withColumn("ord", F.monotonically_increasing_id())


def _or_empty(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def is_form_of() -> Column:
    """An entry with senses that all refer to another form."""
    each = F.forall("senses", lambda s: (F.coalesce(F.size(s["form_of"]), F.lit(0)) > 0) | F.coalesce(F.array_contains(s["tags"], "form-of"), F.lit(False)))
    return F.coalesce((F.size("senses") > 0) & each, F.lit(False))


def admitted(entries: DataFrame) -> DataFrame:
    """Entries of the language that are words of their own, with gender and the folded key."""
    own = entries.where("_corrupt_record is null and coalesce(word, '') != ''").where(F.col("lang_code").isNull() | (F.col("lang_code") == "el")).where(~is_form_of())
    forms = F.transform("forms", lambda f: F.get(F.array_intersect(f["tags"], F.array(F.lit("masculine"), F.lit("feminine"), F.lit("neuter"))), F.lit(0)))
    gender = F.get(F.filter(forms, lambda g: g.isNotNull()), F.lit(0))
    return own.withColumn("gender", gender).withColumn("normalized_lemma", fold_key_udf("word"))


def lemmas(entries: DataFrame) -> DataFrame:
    """One row for (lemma, pos), pos may be null: sources united, gender of the first arrival, ids by content order."""
    rows = entries.groupBy(F.col("word").alias("lemma"), "pos").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min_by("gender", "ord").alias("gender"), F.first("normalized_lemma").alias("normalized_lemma"))
    return rows.withColumn("id", F.row_number().over(Window.orderBy("lemma", "pos")).cast("bigint"))


def senses(entries: DataFrame) -> DataFrame:
    """word, pos, sense_index, gloss, tags (with topics, trimmed, in order), examples, source."""
    s = entries.select("word", "pos", "source", F.posexplode("senses").alias("sense_index", "s"))
    gloss = F.array_join(F.when(F.size("s.glosses") > 0, F.col("s.glosses")).otherwise(F.col("s.raw_glosses")), "; ")
    empty = F.array().cast("array<string>")
    tags = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("s.tags", empty), F.coalesce("s.topics", empty)), lambda t: F.btrim(t)), lambda t: t != ""))
    return s.select("word", "pos", "sense_index", gloss.alias("gloss"), tags.alias("tags"), F.transform("s.examples", lambda e: e["text"]).alias("examples"), "source").where("gloss != ''")


def admissible_form(form: Column, lemma: Column) -> Column:
    """Whether a form can be a form of lemma: Greek, no markup or punctuation, not a bare ending, as many words as the lemma needs."""
    short = (F.length(form) <= 3) & (F.length(lemma) - F.length(form) >= 2)
    words = lemma.contains(" ") & ~form.contains(" ")
    clean = form.rlike(GREEK) & ~form.rlike(r"[{}\[\]|_<>\\/*=]") & ~form.rlike("[«»\"'“”‘’()،,.;:!?·—–-]")
    return F.coalesce((form != "") & (form != "-") & (form != lemma) & clean & ~short & ~words, F.lit(False))


def voice(form: Column, tags: Column, pos: Column) -> Column:
    """The voice that an untagged verb form's ending tells, null if none does."""
    told = F.arrays_overlap(F.transform(tags, F.lower), F.array(F.lit("active"), F.lit("passive"), F.lit("middle")))
    last = F.element_at(F.split(F.btrim(form), r"\s+"), -1)
    ends = lambda endings: last.rlike(f"({'|'.join(endings)})$")
    found = F.when(~last.rlike(GREEK), None).when(ends(PASSIVE), "passive").when(ends(ACTIVE), "active")
    return F.when((pos == "verb") & ~F.coalesce(told, F.lit(False)), found)


def forms(entries: DataFrame) -> DataFrame:
    """word, pos, form, features, source: admissible forms, layout rows out, voices inferred, once each."""
    f = entries.select("word", "pos", "source", F.explode("forms").alias("f")).select("word", "pos", "source", F.btrim("f.form").alias("form"), F.coalesce("f.tags", F.array().cast("array<string>")).alias("tags"))
    f = f.where(~F.arrays_overlap("tags", F.array(F.lit("table-tags"), F.lit("inflection-template")))).where(admissible_form(F.col("form"), F.col("word")))
    v = voice(F.col("form"), F.col("tags"), F.col("pos"))
    features = F.when(v.isNotNull(), F.concat("tags", F.array(v))).otherwise(F.col("tags"))
    return f.select("word", "pos", "form", features.alias("features"), "source").distinct()


def relation_targets(raw: Column) -> Column:
    """The Greek terms of a relation's target: whole if it has no Latin letter, else its runs of other words."""
    runs = F.split(raw, r"(?:\s+|^)\S*[A-Za-z]\S*(?=\s|$)")
    clean = F.filter(F.transform(runs, lambda r: F.btrim(F.regexp_replace(r, r"\s+", " "), F.lit(" ,.:;·()[]"))), lambda r: (F.length(r) >= 2) & ~r.startswith("-") & ~r.endswith("-") & r.rlike(GREEK))
    return F.when(raw.rlike("[A-Za-z]"), clean).otherwise(F.array(raw))


def relations(entries: DataFrame) -> DataFrame:
    """word, pos, target, relation_type, source from the lists of entries and senses, once each; junk and self references out."""
    pick = lambda lists, kind: F.transform(F.coalesce(lists, F.array().cast(_WORDS)), lambda w: F.struct(w["word"].alias("word"), F.lit(kind).alias("kind")))
    empty = F.array().cast("array<struct<word:string,kind:string>>")
    parts = [pick(F.col(k), v) for k, v in RELATIONS.items()]
    in_senses = lambda k, v: F.transform("senses", lambda s: pick(s[k], v))
    parts += [F.coalesce(F.flatten(in_senses(k, v)), empty) for k, v in RELATIONS.items()]
    r = entries.select("word", "pos", "source", F.explode(F.concat(*parts)).alias("r")).where("r.word is not null")
    r = r.where(~F.col("r.word").rlike(r"[ \n]")).select("word", "pos", "source", F.col("r.kind").alias("relation_type"), F.explode(relation_targets(F.col("r.word"))).alias("target"))
    return r.where("target != word").distinct()


def etymons(entries: DataFrame) -> DataFrame:
    """word, pos, seq, relation, lang_code, term, source from etymology templates (cognates: arguments 1 and 2, others 2 and 3)."""
    kinds = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    t = entries.select("word", "pos", "source", F.posexplode("etymology_templates").alias("seq", "t")).withColumn("relation", F.try_element_at(kinds, F.col("t.name"))).where("relation is not null")
    arg = lambda i: F.try_element_at("t.args", F.lit(str(i)))
    cog = F.col("relation") == "cognate"
    out = t.select("word", "pos", "seq", "relation", F.when(cog, arg(1)).otherwise(arg(2)).alias("lang_code"), F.when(cog, arg(2)).otherwise(arg(3)).alias("term"), "source")
    return out.where("coalesce(term, '') != '' and coalesce(lang_code, '') != ''")


def pronunciations(entries: DataFrame) -> DataFrame:
    """word, pos, ipa, seq, source: brackets and slashes off, once each in order."""
    ipa = F.array_distinct(F.filter(F.transform("sounds", lambda s: F.btrim(s["ipa"], F.lit("/[] "))), lambda s: s != ""))
    return entries.select("word", "pos", "source", F.posexplode(ipa).alias("seq", "ipa"))


def descendants(entries: DataFrame) -> DataFrame:
    """word, pos, relation, lang_code, lang_name, term, roman, seq, source: the first known raw tag, else borrowed."""
    kinds = F.create_map(*[F.lit(x) for kv in DESCENT.items() for x in kv])
    d = entries.select("word", "pos", "source", F.posexplode("descendants").alias("seq", "d")).where("coalesce(d.word, '') != ''")
    known = F.filter(F.transform(F.coalesce("d.raw_tags", F.array().cast("array<string>")), lambda t: F.try_element_at(kinds, F.lower(t))), lambda t: t.isNotNull())
    out = d.select("word", "pos", F.coalesce(F.get(known, F.lit(0)), F.lit("borrowed")).alias("relation"), F.col("d.lang_code").alias("lang_code"), F.col("d.lang").alias("lang_name"), F.col("d.word").alias("term"), F.col("d.roman").alias("roman"), "seq", "source")
    once = F.row_number().over(Window.partitionBy("word", "pos", "source", "lang_code", "term").orderBy("seq"))
    return out.withColumn("n", once).where("n = 1").drop("n")


def gloss_phrases(gloss: Column) -> Column:
    """The English lookup phrases of a gloss, in order: no cross references, no brackets, one article off, up to three words."""
    parts = F.split(F.lower(F.regexp_replace(gloss, r"\([^)]*\)", " ")), "[;,/]")
    plain = F.transform(parts, lambda p: F.regexp_replace(F.btrim(F.regexp_replace(p, r"\s+", " "), F.lit(" .!?:\"'")), r"^(a|an|the|to)\s+", ""))
    fine = F.filter(plain, lambda p: (F.length(p) <= 40) & (F.size(F.split(p, " ")) <= 3) & p.rlike(r"^[a-z][a-z'\- ]*[a-z]$") & ~p.isin(STOP_PHRASES))
    return F.when(gloss.rlike(SKIPPED_GLOSS), F.array().cast("array<string>")).otherwise(F.array_distinct(fine))


def search_index(lemma_rows: DataFrame, form_rows: DataFrame) -> DataFrame:
    """surface, normalized_surface, lemma_id, surface_type, features, rank_weight: lemmas at 1.0 and forms at 0.7."""
    none = F.lit(None).cast("array<string>")
    own = lemma_rows.select(F.col("lemma").alias("surface"), F.col("id").alias("lemma_id"), F.lit("lemma").alias("surface_type"), none.alias("features"), F.lit(1.0).alias("rank_weight"))
    at = form_rows.join(lemma_rows.select(F.col("lemma").alias("word"), F.col("pos").alias("lemma_pos"), F.col("id").alias("lemma_id")), "word").where(F.col("pos").eqNullSafe(F.col("lemma_pos")))
    more = at.select(F.col("form").alias("surface"), "lemma_id", F.lit("form").alias("surface_type"), "features", F.lit(0.7).alias("rank_weight"))
    return own.unionByName(more).withColumn("normalized_surface", fold_key_udf("surface"))


def resolved_relations(relation_rows: DataFrame, lemma_rows: DataFrame) -> DataFrame:
    """relation_rows with target_lemma_id: the first lemma of the target's key, null if there is none."""
    first = lemma_rows.groupBy(F.col("normalized_lemma").alias("target_key")).agg(F.min("id").alias("target_lemma_id"))
    return relation_rows.withColumn("target_key", fold_key_udf("target")).join(first, "target_key", "left").drop("target_key")
