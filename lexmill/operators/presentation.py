"""What the pages show: tag buckets, labels, periods of an etymology, events of a span, marked words in a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import EDGE, fold_native

#: Periods of the language from the oldest on, with their language codes; other codes are loans.
PERIODS = {
    "pie": ["ine-pro"],
    "ancient": ["grc", "grc-dor", "grc-att", "grc-ion", "grc-aeo"],
    "koine": ["grc-koi"],
    "medieval": ["gkm", "gkm-cyp"],
    "modern": ["el"],
}
#: Events that the charts mark.
EVENTS = [
    (2001, "Ένταξη στην Ευρωζώνη", "Greece joins the eurozone"),
    (2002, "Κυκλοφορία του ευρώ", "Euro enters circulation"),
    (2004, "Ολυμπιακοί Αγώνες Αθήνας", "Athens Olympic Games"),
    (2008, "Παγκόσμια χρηματοπιστωτική κρίση", "Global financial crisis"),
    (2010, "1ο Μνημόνιο / ΔΝΤ", "First bailout memorandum (IMF/EU)"),
    (2012, "PSI — αναδιάρθρωση χρέους", "PSI sovereign-debt restructuring"),
    (2015, "Δημοψήφισμα & capital controls", "Bailout referendum & capital controls"),
    (2018, "Λήξη μνημονίων · Συμφωνία Πρεσπών", "End of bailouts · Prespa Agreement"),
    (2020, "Πανδημία COVID-19", "COVID-19 pandemic"),
    (2022, "Ενεργειακή κρίση & πληθωρισμός", "Energy crisis & inflation"),
]


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tag_buckets(tags: Column, usage: list[str], domains: list[str], grammar: list[str]) -> Column:
    """A struct of usage, domain and grammar tags in their order: trimmed, lower case, each once; other tags are hidden."""
    keys = F.array_distinct(F.filter(F.transform(F.coalesce(tags, _literal([])), lambda t: F.lower(F.btrim(t))), lambda t: t.isNotNull() & ~t.isin("", "no-gloss")))
    first = lambda wanted, *before: F.filter(keys, lambda t: t.isin(wanted) & ~t.isin([x for b in before for x in b]))
    return F.struct(first(usage).alias("usage"), first(domains, usage).alias("domain"), first(grammar, usage, domains).alias("grammar"))


def label(raw: Column, names: dict[str, str]) -> Column:
    """The name of a trimmed lower-case key, or the raw value."""
    if not names:
        return raw
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(F.btrim(raw))), raw)


def period(lang: Column) -> Column:
    """The period of a language code; loan if it has none."""
    pairs = [F.lit(x) for name, codes in PERIODS.items() for code in codes for x in (code, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lang), F.lit("loan"))


def timeline(etymons: DataFrame, key: str) -> DataFrame:
    """key, period, stage (place from the oldest on; loans last) and terms (structs in the order of seq) of etymons(key, lang_code, term, relation, seq)."""
    stage = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, name in enumerate(PERIODS) for x in (name, i)]), F.col("period")), F.lit(len(PERIODS)))
    rows = etymons.withColumn("period", period(F.col("lang_code"))).withColumn("stage", stage)
    terms = F.transform(F.array_sort(F.collect_list(F.struct("seq", "term", "relation"))), lambda x: F.struct(x["term"].alias("term"), x["relation"].alias("relation")))
    return rows.groupBy(key, "period", "stage").agg(terms.alias("terms"))


def events_between(spark: SparkSession, first: int | None, last: int | None) -> DataFrame:
    """year, el, en of the events within a span of years, whichever end comes first; none without both ends."""
    rows = [] if first is None or last is None else [e for e in EVENTS if min(first, last) <= e[0] <= max(first, last)]
    return spark.createDataFrame(rows, "year int, el string, en string")


def marked(sentence: Column, forms: Column) -> Column:
    """An array of (text, hit) pieces of a sentence, white space kept: a word is a hit if its key is among the keys forms."""
    pieces = F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(r"(\s+|\S+)"), F.lit(1))
    return F.transform(pieces, lambda w: F.struct(w.alias("text"), F.coalesce(F.array_contains(forms, fold_native(F.btrim(w, F.lit(EDGE)))) & (F.btrim(w) != ""), F.lit(False)).alias("hit")))
