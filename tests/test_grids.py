from lexmill.operators import grids

FORMS = "lemma_id int, seq int, form string, source string, features array<string>"
LEMMAS = "lemma_id int, lemma string, pos string"


def _cells(spark, forms, lemmas):
    cells, rest = grids.grids(spark.createDataFrame(forms, FORMS), spark.createDataFrame(lemmas, LEMMAS))
    return {(r.lemma_id, r.part, r.row, r.column): (r.text, r.generated) for r in cells.collect()}, {(r.lemma_id, r.form): r.non_finite for r in rest.collect()}


def test_verbs(spark):
    forms = [
        (1, 0, "γράφω active", "el", ["canonical"]),
        (1, 1, "έγραψα", "en", ["Past", "perfective", "first-person", "singular"]),
        (1, 2, "γράψεις", "en", ["dependent", "perfective", "second-person", "singular"]),
        (1, 3, "να γράψεις", "el", ["subjunctive", "second-person", "singular"]),
        (1, 4, "να έχω γράψει", "el", ["subjunctive", "first-person", "singular"]),
        (1, 5, "γράφομαι", "generated", ["present", "passive", "first-person", "singular"]),
        (1, 6, "γραμμένος", "en", ["participle"]),
        (1, 7, "grafo", "en", ["romanization"]),
        (1, 8, "έχω, έχεις", "en", []),
        (1, 9, "θα γράψω", "el", ["future", "first-person", "singular"]),
        (1, 10, "κάτι", "el", None),
        (1, 11, None, "el", None),
        (9, 0, "χωρίς", "el", []),
    ]
    cells, rest = _cells(spark, forms, [(1, "γράφω", "verb")])
    assert cells == {
        (1, "active", "first singular", "present"): ("γράφω", False),
        (1, "active", "first singular", "aorist"): ("έγραψα", False),
        (1, "active", "second singular", "subjunctive perfective"): ("γράψεις / να γράψεις", False),
        (1, "active", "first singular", "subjunctive perfect"): ("να έχω γράψει", False),
        (1, "active", "first singular", "future perfective"): ("θα γράψω", False),
        (1, "passive", "first singular", "present"): ("γράφομαι", True),
    }
    assert rest == {(1, "γραμμένος"): True, (1, "κάτι"): False}


def test_nominals(spark):
    forms = [
        (1, 0, "ανθρώπου", "generated", ["genitive", "singular"]),
        (1, 1, "ανθρώπου", "generated", ["genitive", "singular"]),
        (2, 0, "καλή", "en", ["nominative", "singular", "feminine"]),
        (2, 1, "καλοί", None, ["nominative", "plural", "masculine"]),
    ]
    cells, rest = _cells(spark, forms, [(1, "άνθρωπος", "noun"), (2, "καλός", None), (3, "μόνος", "adj")])
    assert cells == {
        (1, "", "nominative", "singular"): ("άνθρωπος", False),
        (1, "", "genitive", "singular"): ("ανθρώπου", True),
        (2, "masculine", "nominative", "singular"): ("καλός", False),
        (2, "feminine", "nominative", "singular"): ("καλή", False),
        (2, "masculine", "nominative", "plural"): ("καλοί", False),
        (3, "", "nominative", "singular"): ("μόνος", False),
    }
    assert rest == {}
    assert _cells(spark, [], []) == ({}, {})
