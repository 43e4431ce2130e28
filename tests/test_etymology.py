from pyspark.sql import functions as F

from lexmill.sources.etymology import chain

CASES = {
    "Ιανουάριος < ελληνιστική κοινή Ἰανουάριος < λατινική ianuarius < πρωτοϊνδοευρωπαϊκή *yeh₂-": [("inherited", "grc-koi", "Ἰανουάριος"), ("borrowed", "la", "ianuarius"), ("inherited", "ine-pro", "*yeh₂-")],
    "υγειά < (κληρονομημένο) μεσαιωνική ελληνική ὑγειά < αρχαία ελληνική ὑγίεια": [("inherited", "gkm", "ὑγειά"), ("inherited", "grc", "ὑγίεια")],
    "ρεαλισμός < (λόγιο δάνειο) γαλλική réal < πρωτοϊνδοευρωπαϊκή ρίζα *reh-": [("borrowed", "fr", "réal"), ("inherited", "ine-pro", "*reh-")],
    "ουρανοξύστης < (μεταφραστικό δάνειο) αγγλική skyscraper": [("calque", "en", "skyscraper")],
    "λαδί < λάδ(ι) + -ί": [],
    "Ιάνος < → λείπει η ετυμολογία": [],
    "x < αρχαία ελληνική λόγος < αρχαία ελληνική λόγος": [("inherited", "grc", "λόγος")],
    "": [],
}


def test_chains(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "t string")
    got = {r.t: [tuple(e) for e in r.c] for r in df.select("t", chain(F.col("t")).alias("c")).collect()}
    assert got == {**CASES, None: []}
