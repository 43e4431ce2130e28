"""Modern Greek stress and regular paradigms: forms that a headword's ending and gender fix, and nothing else.

A headword whose class or stress is not certain gets no forms: several words, Latin letters, old (polytonic) accents,
a polysyllable without stress, a stressed vowel that would fuse with the next when the stress moves, a gender that is
unknown or does not fit the ending, contracted verbs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

TONOS, DIALYTIKA = "́", "̈"
OLD_MARKS = frozenset("̀̓̔͂ͅ")
VOWELS = frozenset("αεηιουω")
#: Pairs of vowels that are one sound.
PAIRS = frozenset("αι ει οι υι ου αυ ευ ηυ".split())
CASES = ("nominative", "genitive", "accusative", "vocative")
PERSONS = ("first-person", "second-person", "third-person")


def _letters(word: str) -> list[tuple[str, str]]:
    """(base letter, marks) of a word."""
    out: list[tuple[str, str]] = []
    for c in unicodedata.normalize("NFD", word):
        if unicodedata.category(c) == "Mn" and out:
            out[-1] = (out[-1][0], out[-1][1] + c)
        else:
            out.append((c, ""))
    return out


def nuclei(word: str) -> list[tuple[int, int]]:
    """Places (first, last letter) of the syllables' vowels."""
    letters, found, i = _letters(word), [], 0
    while i < len(letters):
        base, marks = letters[i][0].lower(), letters[i][1]
        if base not in VOWELS:
            i += 1
            continue
        pair = i + 1 < len(letters) and base + letters[i + 1][0].lower() in PAIRS and TONOS not in marks and DIALYTIKA not in letters[i + 1][1]
        found.append((i, i + pair))
        i += 1 + pair
    return found


def stress(word: str) -> int | None:
    """The stressed syllable counted from the end (1 is the last); None if no vowel has a stress mark."""
    letters, places = _letters(word), nuclei(word)
    for n, (a, b) in enumerate(reversed(places), 1):
        if any(TONOS in letters[i][1] for i in range(a, b + 1)):
            return n
    return None


def with_stress(word: str, syllable: int) -> str:
    """word stressed on that syllable from the end (or its first); a word of one syllable has no mark."""
    bare = unicodedata.normalize("NFC", "".join(c + m.replace(TONOS, "") for c, m in _letters(word)))
    letters, places = _letters(bare), nuclei(bare)
    if len(places) < 2:
        return bare
    _, last = places[-min(syllable, len(places))]
    return unicodedata.normalize("NFC", "".join(c + m + (TONOS if i == last else "") for i, (c, m) in enumerate(letters)))


def fuses(word: str) -> bool:
    """Whether a stressed vowel stands before one that it would form one sound with if the stress moved."""
    letters = _letters(word)
    return any(TONOS in m and a.lower() + b.lower() in PAIRS and DIALYTIKA not in n for (a, m), (b, n) in zip(letters, letters[1:]))


def is_old(word: str) -> bool:
    return any(OLD_MARKS & set(m) for _, m in _letters(word))


#: Endings by case, singular then plural; "-" is a cell that the headword does not fix.
#: A ending may carry where its stress goes: "=" as in the headword's syllable, "1" to "3" that syllable from the end,
#: "3<" the headword's syllable, or the third from the end if that is nearer to it.
NOUNS = {
    ("ος", "masculine", False): ["ος=", "-", "ο=", "ε=", "οι=", "-", "ους=", "οι="],
    ("ος", "masculine", True): ["ος1", "ου1", "ο1", "ε1", "οι1", "ων1", "ους1", "οι1"],
    ("α", "feminine", False): ["α=", "ας=", "α=", "α=", "ες=", "-", "ες=", "ες="],
    ("α", "feminine", True): ["α1", "ας1", "α1", "α1", "ες1", "-", "ες1", "ες1"],
    ("η", "feminine", False): ["η=", "ης=", "η=", "η=", "-", "-", "-", "-"],
    ("η", "feminine", True): ["η1", "ης1", "η1", "η1", "-", "-", "-", "-"],
    ("μα", "neuter", False): ["μα=", "ματος3<", "μα=", "μα=", "ματα3<", "ματων2", "ματα3<", "ματα3<"],
    ("ο", "neuter", False): ["ο=", "-", "ο=", "ο=", "α=", "-", "α=", "α="],
    ("ο", "neuter", True): ["ο1", "ου1", "ο1", "ο1", "α1", "ων1", "α1", "α1"],
    ("ι", "neuter", False): ["ι=", "ιου1", "ι=", "ι=", "ια=", "ιων1", "ια=", "ια="],
    ("ι", "neuter", True): ["ι1", "ιου1", "ι1", "ι1", "ια1", "ιων1", "ια1", "ια1"],
}
ADJECTIVE = {
    "masculine": ["ος", "ου", "ο", "ε", "οι", "ων", "ους", "οι"],
    "feminine": ["η", "ης", "η", "η", "ες", "ων", "ες", "ες"],
    "neuter": ["ο", "ου", "ο", "ο", "α", "ων", "α", "α"],
}
PRESENT = ["ω", "εις", "ει", "ουμε", "ετε", "ουν"]


def _placed(stem: str, ending: str, place: str, from_start: int) -> str:
    raw = stem + ending
    if place.isdigit():
        return with_stress(raw, int(place))
    from_end = len(nuclei(raw)) - from_start
    return with_stress(raw, min(from_end, 3) if place == "3<" else from_end)


def generate(lemma: str | None, pos: str | None, gender: str | None) -> list[tuple[str, list[str]]]:
    """(form, tags) of a headword's regular paradigm, empty if it is not certain."""
    if not lemma or not lemma.isalpha() or any("a" <= c.lower() <= "z" for c in lemma) or fuses(lemma) or is_old(lemma):
        return []
    syllables, at = len(nuclei(lemma)), stress(lemma)
    if not syllables or syllables > 1 and at is None:
        return []
    last, start = at == 1, syllables - (at or 1)
    plain = "".join(c + m.replace(TONOS, "") for c, m in _letters(lemma))
    plain = unicodedata.normalize("NFC", plain)
    cells = [(c, n) for n in ("singular", "plural") for c in CASES]
    if pos == "noun" and gender:
        for (ending, kind, oxytone), table in NOUNS.items():
            longer = ending == "α" and plain.endswith("μα") and gender == "neuter"
            if plain.endswith(ending) and kind == gender and oxytone == last and not longer:
                stem = plain[: -len(ending)]
                rules = [(cell, t.rstrip("=123<"), t[len(t.rstrip("=123<")) :]) for cell, t in zip(cells, table) if t != "-"]
                return [(_placed(stem, e, place, start), list(cell)) for cell, e, place in rules]
        return []
    if pos == "adj" and plain.endswith("ος"):
        stem, out = plain[:-2], []
        for kind, endings in ADJECTIVE.items():
            for cell, e in zip(cells, endings):
                if kind == "feminine" and e[0] == "η" and stem[-1:] in {"α", "ε", "ι", "ο", "υ"}:
                    e = "α" + e[1:]
                out.append((_placed(stem, e, "1" if last else "=", start), [*cell, kind]))
        return out
    if pos == "verb" and plain.endswith("ω") and not last and not plain.endswith("αω"):
        people = [(p, n) for n in ("singular", "plural") for p in PERSONS]
        return [(_placed(plain[:-1], e, "=", start), ["present", "indicative", "active", *cell]) for cell, e in zip(people, PRESENT)]
    return []


@udtf(returnType="form string, features array<string>")
class Paradigm:
    """Rows of generate() for SQL and lateral joins."""

    def eval(self, lemma: str, pos: str, gender: str) -> Iterator[tuple[str, list[str]]]:
        yield from generate(lemma, pos, gender)


def paradigms(lemmas: DataFrame) -> DataFrame:
    """lemma_id, form, features of lemmas(id, lemma, pos, gender)."""
    spark = lemmas.sparkSession
    spark.udtf.register("lexmill_paradigm", Paradigm)
    return spark.sql("SELECT l.id AS lemma_id, p.form, p.features FROM {lemmas} l, LATERAL lexmill_paradigm(l.lemma, l.pos, l.gender) p", lemmas=lemmas)


def cell_key(features):
    """A form's cell as text: case, number and gender, or person and number of the present active; null if it is neither."""
    pick = lambda names: F.get(F.array_intersect(features, F.array(*[F.lit(x) for x in names])), F.lit(0))
    case, number, gender, person = pick(CASES), pick(("singular", "plural")), pick(("masculine", "feminine", "neuter")), pick(PERSONS)
    other = F.arrays_overlap(features, F.array(*[F.lit(x) for x in ("past", "imperfect", "aorist", "subjunctive", "imperative", "passive", "future")]))
    verb = F.when(person.isNotNull() & number.isNotNull() & ~other, F.concat_ws("/", F.lit("V"), person, number))
    return F.coalesce(F.when(case.isNotNull() & number.isNotNull(), F.concat_ws("/", case, number, gender)), verb)


def backfill(lemmas: DataFrame, stored: DataFrame) -> DataFrame:
    """Generated forms of cells for which stored(lemma_id, form, features) has none from any source; never a replacement."""
    made = paradigms(lemmas).withColumn("cell", cell_key(F.col("features"))).where("cell is not null")
    have = stored.select("lemma_id", cell_key(F.col("features")).alias("cell")).where("cell is not null").distinct()
    return made.join(have, ["lemma_id", "cell"], "left_anti").withColumn("source", F.lit("generated"))


def agreement(lemmas: DataFrame, stored: DataFrame) -> DataFrame:
    """pos, cells, agree, precision of generated forms against stored ones of the same cell, the headword's own form left out."""
    made = paradigms(lemmas).withColumn("cell", cell_key(F.col("features"))).where("cell is not null")
    have = stored.withColumn("cell", cell_key(F.col("features"))).where("cell is not null").groupBy("lemma_id", "cell").agg(F.collect_set("form").alias("forms"))
    both = made.join(have, ["lemma_id", "cell"]).join(lemmas.select(F.col("id").alias("lemma_id"), "lemma", "pos"), "lemma_id").where("form != lemma")
    return both.groupBy("pos").agg(F.count("*").alias("cells"), F.count_if(F.array_contains("forms", F.col("form"))).alias("agree")).withColumn("precision", F.col("agree") / F.col("cells"))
