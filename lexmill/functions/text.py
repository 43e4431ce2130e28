"""Keys and tokens. Native expressions where they can be, an Arrow UDF where Unicode needs it."""

from __future__ import annotations

import re
import unicodedata
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Accented Greek small letters (one code point each) and their plain letters.
ACCENTED, PLAIN = "άέήίόύώϊϋΐΰ", "αεηιουωιυιυ"
#: Fixed value: the punctuation that goes from the edges of a token.
EDGE = "«»\"'“”‘’()[]{}.,:;·…!?-–—/\\|<>*•%&@#~_=+"
#: Fixed value: the same for an English key.
ENGLISH_EDGE = " .,;:!?\"'()[]"


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def fold_native(text: Column) -> Column:
    """The search key of text in single-code-point Greek or plain letters: lower case, accents and final sigma folded."""
    return squeeze(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED + "ς", PLAIN + "σ"))


def fold_key(text: str | None) -> str:
    """The search key of any text: NFC, lower case, no combining marks, final sigma folded, blanks squeezed."""
    low = unicodedata.normalize("NFC", text or "").lower()
    bare = "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")
    return " ".join(unicodedata.normalize("NFC", bare).replace("ς", "σ").split())


def accent_key(text: str | None) -> str:
    """The analysis key: as fold_key, accents kept."""
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text or "").lower().replace("ς", "σ")).split())


@pandas_udf(StringType())
def fold_key_udf(text):
    return text.astype(object).map(lambda t: fold_key(t) if isinstance(t, str) else "")


@pandas_udf(StringType())
def accent_key_udf(text):
    return text.astype(object).map(lambda t: accent_key(t) if isinstance(t, str) else "")


def tokens(text: Column) -> Column:
    """Words of a text: split at white space, edge punctuation off, lower case, final sigma folded, accents kept, empty ones out."""
    pieces = F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ")), r"[ \t\n\r\x0b\x0c]+")
    return F.filter(F.transform(pieces, lambda w: F.btrim(w, F.lit(EDGE))), lambda w: w != "")


def search_tokens(text: Column) -> Column:
    """tokens() without accents: the words as search keys (for letters of one code point)."""
    return F.transform(tokens(text), lambda w: F.translate(w, ACCENTED, PLAIN))


def english_key(text: Column) -> Column:
    """The key of an English query: lower case, blanks squeezed, punctuation off its edges."""
    return F.btrim(squeeze(F.lower(F.coalesce(text, F.lit("")))), F.lit(ENGLISH_EDGE))


@pandas_udf(StringType())
def unescape_udf(text):
    """Character references decoded; null stays null."""
    import html

    return text.astype(object).map(lambda t: html.unescape(t) if isinstance(t, str) else None)


#: Greek readings of Latin spellings, most likely first; pairs are tried before single letters.
GREEKLISH_PAIRS = {
    "th": ["θ"], "ch": ["χ"], "ps": ["ψ"], "ks": ["ξ"], "ou": ["ου"],
    "ai": ["αι", "ε", "αη"], "ei": ["ει", "ι", "η", "εη"], "oi": ["οι", "ι", "ωη", "οη", "ωι"],
    "gg": ["γγ"], "gk": ["γκ"], "mp": ["μπ"], "nt": ["ντ"], "ts": ["τσ"], "tz": ["τζ"],
}
GREEKLISH_LETTERS = {
    "a": ["α"], "b": ["β"], "g": ["γ"], "d": ["δ"], "e": ["ε", "αι"], "z": ["ζ"], "h": ["η", "ι"],
    "i": ["ι", "η", "υ"], "k": ["κ"], "l": ["λ"], "m": ["μ"], "n": ["ν"], "x": ["ξ"], "o": ["ο", "ω"],
    "p": ["π"], "r": ["ρ"], "s": ["σ"], "t": ["τ"], "y": ["υ", "ι"], "u": ["υ", "ου"], "f": ["φ"],
    "w": ["ω", "ο"], "c": ["κ"], "j": ["ι"],
}
UNIT = re.compile("|".join(GREEKLISH_PAIRS) + "|.", re.DOTALL)


def readings(text: str) -> list[list[str]]:
    """For each unit of a Latin spelling its Greek readings."""
    return [GREEKLISH_PAIRS.get(u) or GREEKLISH_LETTERS.get(u, [u]) for u in UNIT.findall(text.lower())]


def transliterated(text: str) -> str:
    """The most likely Greek reading of a Latin spelling."""
    return "".join(r[0] for r in readings(text))


def greeklish_candidates(text: str, most: int = 64) -> list[str]:
    """Greek readings of a Latin spelling, the most likely first, at most `most`: those that differ late come early."""
    found: dict[str, None] = {}
    for combination in product(*readings(text)):
        found.setdefault("".join(combination))
        if len(found) >= most:
            break
    return list(found)
