import pytest

from lexmill.functions import morphology as m


def test_syllables_and_stress():
    assert len(m.nuclei("άνθρωπος")) == 3 and len(m.nuclei("παιδί")) == 2 and len(m.nuclei("γάιδαρος")) == 4 and len(m.nuclei("προϊόν")) == 3
    assert [m.stress(w) for w in ("άνθρωπος", "λόγος", "καλός", "φως", "προϊόν")] == [3, 2, 1, None, 1]
    assert m.with_stress("ανθρωπου", 2) == "ανθρώπου" and m.with_stress("φως", 1) == "φως" and m.with_stress("παιδιού", 2) == "παιδίου"


@pytest.mark.parametrize(
    ("word", "pos", "gender", "cell", "form"),
    [
        ("άνθρωπος", "noun", "masculine", ["accusative", "plural"], "άνθρωπους"),
        ("λαός", "noun", "masculine", ["genitive", "plural"], "λαών"),
        ("χώρα", "noun", "feminine", ["genitive", "singular"], "χώρας"),
        ("όνομα", "noun", "neuter", ["genitive", "singular"], "ονόματος"),
        ("όνομα", "noun", "neuter", ["genitive", "plural"], "ονομάτων"),
        ("σπίτι", "noun", "neuter", ["genitive", "singular"], "σπιτιού"),
        ("παιδί", "noun", "neuter", ["nominative", "plural"], "παιδιά"),
        ("καλός", "adj", None, ["nominative", "singular", "feminine"], "καλή"),
        ("ωραίος", "adj", None, ["nominative", "singular", "feminine"], "ωραία"),
        ("γράφω", "verb", None, ["present", "indicative", "active", "first-person", "plural"], "γράφουμε"),
    ],
)
def test_forms(word, pos, gender, cell, form):
    assert {tuple(t): f for f, t in m.generate(word, pos, gender)}[tuple(cell)] == form


@pytest.mark.parametrize(
    ("word", "pos", "gender"),
    [("δύο λέξεις", "noun", "feminine"), ("abc", "noun", "neuter"), ("γάιδαρος", "noun", "masculine"), ("ἄνθρωπος", "noun", "masculine"), ("ανθρωπος", "noun", "masculine"), ("λόγος", "noun", None), ("λόγος", "noun", "neuter"), ("αγαπώ", "verb", None), ("αγαπάω", "verb", None), ("", "noun", "neuter"), (None, None, None)],
)
def test_refusals(word, pos, gender):
    assert m.generate(word, pos, gender) == []


def test_uncertain_cells_are_left_out():
    cells = {tuple(t) for _, t in m.generate("άνθρωπος", "noun", "masculine")}
    assert ("genitive", "singular") not in cells and len(cells) == 6


def test_backfill(spark):
    lemmas = spark.createDataFrame([(1, "λαός", "noun", "masculine"), (2, "λόγος", "noun", None)], "id bigint, lemma string, pos string, gender string")
    stored = spark.createDataFrame([(1, "λαών", ["genitive", "plural"]), (1, "λαέ", ["vocative", "singular"])], "lemma_id bigint, form string, features array<string>")
    got = {(r.cell, r.form) for r in m.backfill(lemmas, stored).collect()}
    assert len(got) == 6 and ("genitive/plural", "λαών") not in got and ("genitive/singular", "λαού") in got
    assert m.agreement(lemmas, stored).first()[:] == ("noun", 2, 2, 1.0)
