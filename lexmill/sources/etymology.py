"""Chains of ancestors in prose etymologies ("word < (marker) LANGUAGE term < LANGUAGE older"), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of languages in the prose and their codes.
LANGUAGES = {
    "αρχαία ελληνική": "grc", "ελληνιστική κοινή": "grc-koi", "μεσαιωνική ελληνική": "gkm", "μεσαιωνική λατινική": "la-med", "ύστερη λατινική": "la-lat",
    "δημώδης λατινική": "la-vul", "πρωτοϊνδοευρωπαϊκή": "ine-pro", "ινδοευρωπαϊκή": "ine-pro", "πρωτοελληνική": "grk-pro", "προελληνική": "qfa-sub",
    "οθωμανική τουρκική": "ota", "κλασική συριακή": "syc", "πρωτοσλαβική": "sla-pro", "παλαιά γαλλική": "fro", "αρχαία γαλλική": "fro",
    "λατινική": "la", "λατινικά": "la", "γαλλική": "fr", "γαλλικά": "fr", "ιταλική": "it", "ιταλικά": "it", "βενετική": "vec", "βενετικά": "vec",
    "τουρκική": "tr", "τουρκικά": "tr", "αραβική": "ar", "αραβικά": "ar", "περσική": "fa", "περσικά": "fa", "εβραϊκή": "he", "εβραϊκά": "he",
    "σανσκριτική": "sa", "σανσκριτικά": "sa", "αγγλική": "en", "αγγλικά": "en", "γερμανική": "de", "γερμανικά": "de", "ισπανική": "es", "ισπανικά": "es",
    "ρωσική": "ru", "ρωσικά": "ru", "βουλγαρική": "bg", "βουλγαρικά": "bg", "αλβανική": "sq", "αλβανικά": "sq", "συριακή": "syc", "αραμαϊκή": "arc",
    "κοπτική": "cop", "αιγυπτιακή": "egy", "σλαβική": "sla",
}
#: Older stages, which pass words on without borrowing.
STAGES = "grc grc-koi gkm grk-pro qfa-sub ine-pro".split()
#: Words that may stand between a language and its term.
CONNECTORS = "ρίζα ρίζας λέξη λέξης ρήμα ρήματος θέμα θέματος όνομα ονόματος ουσιαστικό επίθετο επίρρημα μετοχή τύπος τύπο τύπου προέλευσης καταγωγής ο η το τη την του της από στο στη".split()


def chain(prose: Column) -> Column:
    """array<struct<relation, lang_code, term>> in order, the nearest ancestor first; steps without a known language are left out."""
    names = "|".join(sorted(LANGUAGES, key=len, reverse=True))
    code = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])

    def step(segment: Column) -> Column:
        marker = F.lower(F.regexp_extract(segment, r"^\s*\(([^)]*)\)", 1))
        bare = F.regexp_replace(segment, r"^\s*(\([^)]*\)\s*)?", "")
        lang = F.try_element_at(code, F.regexp_extract(bare, f"^({names})", 1))
        rest = F.regexp_replace(bare, f"(?iu)^({names})\\s*((«|\")?({'|'.join(CONNECTORS)})[»\",.;:]*\\s+){{0,3}}", "")
        term = F.regexp_extract(rest, r"^[«\"]?([*\-]?[^\s,.;:»\"()<]+)", 1)
        relation = (
            F.when(marker.rlike("μεταφραστικό|απόδοση"), "calque")
            .when(marker.rlike("κληρονομ|διαχρονικό"), "inherited")
            .when(marker.rlike("δάνειο|δάνεια"), "borrowed")
            .when(lang.isin(STAGES), "inherited")
            .otherwise("borrowed")
        )
        return F.struct(relation.alias("relation"), lang.alias("lang_code"), F.when(~term.isin(CONNECTORS), term).alias("term"))

    parts = F.split(F.coalesce(prose, F.lit("")), r"\s+<\s+")
    steps = F.transform(F.slice(parts, 2, 1000), step)
    return F.array_distinct(F.filter(steps, lambda s: s["lang_code"].isNotNull() & (F.coalesce(s["term"], F.lit("")) != "")))


def prose_etymons(entries: DataFrame) -> DataFrame:
    """word, pos, seq, relation, lang_code, term, source of entries whose etymology is prose alone."""
    own = entries.where("coalesce(size(etymology_templates), 0) < 1").select("word", "pos", "source", F.posexplode(chain(F.col("etymology_text"))).alias("seq", "e"))
    return own.select("word", "pos", "seq", "e.relation", "e.lang_code", "e.term", "source")


def chain_depths(etymons: DataFrame) -> DataFrame:
    """depth, words: how many words have a chain of each length."""
    return etymons.groupBy("word", "pos").agg(F.count("*").alias("depth")).groupBy("depth").agg(F.count("*").alias("words"))
