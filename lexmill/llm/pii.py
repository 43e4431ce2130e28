"""Personal data: fixed forms, and terms that reveal them by co-occurrence.

Fixed forms are leftmost non-overlapping matches of each kind; a match that fails its extra
condition is dropped without retries. Every found value is a protected entity. All words of a
document outside fixed forms are its terms; the documents that have a term and an entity are set
against the documents that have the term at all, copies counted on both sides. A term discloses an
entity when log2 of P(entity | term) is within disclosure_bits of certainty and enough documents
support it; then every occurrence of it in any document is a span of kind "term". Redaction
generalises: every span gives way to the name of its kind.

What is gathered grows with the documents that hold entities, and is counted in shuffles. Only
bitmaps of fixed size are sent to all tasks, to leave out early what an exact count or join leaves
out after them. A term that is in too many of the documents with entities is in too many of all: it
is left out, exactly, before all documents are counted.

Defined results: null and empty texts have no spans and stay as they are, and an empty table has no
rows; texts of any length, with numbers of any length in them, are scanned whole; repeated rows are
repeated; overlapping spans are redacted as one, under the first one's name; other columns stay
(redact) or are ignored (pii_spans), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import bitmap, clear_name, map_lists, written

KINDS = ["email", "ip", "card", "phone", "term"]
#: The base forms. An email's local part is found backwards from its "@".
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
BITS = 1 << 20  #: cells of the bitmap of entities
TERM_BITS, TERM_CELLS = 23, 4  #: of the bitmaps of terms: cells (log2), cells for each term
SALTS = 32  #: parts among which the occurrences of one term are joined


@dataclass(frozen=True)
class PiiParams:
    least_contexts: int = 3  #: documents that must have a term with an entity
    disclosure_bits: float = 1.0  #: log2(1 / P(entity | term)) must not be above this


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def term_hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big", signed=True)


def outside(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words that do not touch a base span."""
    starts, ends = [], []
    for _, start, end in sorted(base, key=lambda s: s[1]):
        starts.append(start)
        ends.append(max(end, ends[-1] if ends else 0))
    found = []
    for m in WORD.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            found.append((m.group().lower(), m.start(), m.end()))
    return found


def terms_of(text: str, base: list[tuple[str, int, int]]) -> set[str]:
    return {w for w, _, _ in outside(text, base)} if base else {w.lower() for w in set(WORD.findall(text))}


SCHEMA = "doc_id bigint, key bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<struct<rank:int,start:bigint,end:bigint>>, entities array<bigint>, terms array<bigint>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of id and text, the same for repeated rows), base counts, digest and spans, entities, and terms if there are entities."""

    def scan(batch: dict) -> dict:
        out = {name: [] for name in ("doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "terms")}
        for doc_id, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
            base = base_spans(text or "")
            kinds = Counter(kind for kind, _, _ in base)
            out["doc_id"].append(doc_id)
            out["key"].append(key)
            for kind in KINDS[:4]:
                out[f"n_{kind}"].append(kinds[kind])
            out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
            out["base"].append([{"rank": KINDS.index(k), "start": s, "end": e} for k, s, e in base])
            out["entities"].append([term_hash(x) for x in sorted({f"{k}:{text[s:e].lower()}" for k, s, e in base})])
            out["terms"].append([term_hash(x) for x in sorted(terms_of(text, base))] if base else [])
        return out

    return map_lists(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text"), scan, SCHEMA)


def entity_pairs(found: DataFrame, least: int) -> DataFrame:
    """(entity, term, together) for what at least least documents have together; a document counts once, and so does each copy.

    Entities of fewer documents, which are most, have no such pair. A bitmap leaves them out before
    the pairs are made; those it lets through fall to the count.
    """
    often = found.select(F.explode("entities").alias("entity")).groupBy("entity").count().where(F.col("count") >= least)
    cells = bitmap(often.select(F.pmod("entity", F.lit(BITS))), BITS.bit_length() - 1)
    sent = found.sparkSession.sparkContext.broadcast(cells)

    def keep(batch: dict) -> dict:
        bits = sent.value
        left = [[e for e in es if bits[e % BITS >> 3] >> (e & 7) & 1] for es in batch["entities"]]
        some = [i for i, es in enumerate(left) if es]
        return {"entities": [left[i] for i in some], "terms": [batch["terms"][i] for i in some]}

    repeated = map_lists(found.where(F.size("entities") > 0).select("entities", "terms"), keep, "entities array<bigint>, terms array<bigint>")
    pairs = repeated.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    return pairs.groupBy("entity", "term").agg(F.count("*").alias("together")).where(F.col("together") >= least)


def certain(params: PiiParams) -> Column:
    """Of columns documents and together: is P(entity | term) within disclosure_bits of certainty?"""
    return F.log2(F.col("documents") / F.col("together")) <= params.disclosure_bits


def open_terms(pairs: DataFrame, found: DataFrame, params: PiiParams) -> DataFrame:
    """(term): the terms of pairs that may disclose, by the documents with entities alone.

    All documents with a term are no fewer than those in found, so a term that fails here fails for
    good. Words that stand beside some entity only by being common go here, before each part of the
    table would give a count of each of them.
    """
    within = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("documents"))
    most = pairs.groupBy("term").agg(F.max("together").alias("together"))
    return most.join(within, "term").where(certain(params)).select("term")


def cells_of(h: int) -> list[int]:
    """The cells of a term in a bitmap of terms."""
    return [(h >> 15 * i) % (1 << TERM_BITS) for i in range(TERM_CELLS)]


def term_bitmap(terms: DataFrame) -> bytes:
    """The bitmap of terms(term)."""
    cell = [F.pmod(F.shiftright("term", 15 * i), F.lit(1 << TERM_BITS)) for i in range(TERM_CELLS)]
    return bitmap(terms.select(F.explode(F.array(*cell))), TERM_BITS)


class Hashes(dict):
    """word -> its hash, or None for a word that is not in a bitmap of terms."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> int | None:
        h = term_hash(word)
        self[word] = h if all(self.bits[c >> 3] >> (c & 7) & 1 for c in cells_of(h)) else None
        return self[word]


def term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents): in how many documents each of terms is; words outside the bitmap of terms are left out early."""
    cells = term_bitmap(terms)
    if not any(cells):
        return terms.select("term", F.lit(0).cast("bigint").alias("documents"))
    sent = docs.sparkSession.sparkContext.broadcast(cells)

    def count(batch: dict) -> dict:
        hashed, counts = Hashes(sent.value), Counter()
        for text in batch["text"]:
            some = {w for w in terms_of(text or "", []) if hashed[w] is not None}
            if some and (base := base_spans(text)):
                some &= terms_of(text, base)
            counts.update(hashed[w] for w in some)
        return {"term": list(counts), "documents": list(counts.values())}

    counted = map_lists(docs.select("text"), count, "term bigint, documents bigint", rows=None, summed=True)
    return counted.groupBy("term").agg(F.sum("documents").alias("documents")).join(terms, "term", "left_semi")


def occurrences(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """(key, start, end): where the terms of telling(term) stand in docs, outside base spans, once for repeated rows."""
    sent = docs.sparkSession.sparkContext.broadcast(term_bitmap(telling))

    def find(batch: dict) -> dict:
        hashed, out = Hashes(sent.value), {"key": [], "term": [], "spans": []}
        for key, text in zip(batch["key"], batch["text"]):
            text, spans = text or "", {}
            if all(hashed[w.lower()] is None for w in set(WORD.findall(text))):
                continue
            for w, start, end in outside(text, base_spans(text)):
                if (h := hashed[w]) is not None:
                    spans.setdefault(h, []).append({"start": start, "end": end})
            for h, places in spans.items():
                for name, value in zip(out, (key, h, places)):
                    out[name].append(value)
        return out

    placed = map_lists(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text"), find, "key bigint, term bigint, spans array<struct<start:bigint,end:bigint>>")
    salted = telling.select("term", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    exact = placed.withColumn("salt", F.pmod("key", F.lit(SALTS))).join(salted, ["term", "salt"], "left_semi")
    return exact.select("key", F.explode("spans").alias("s")).select("key", "s.start", "s.end").distinct()


def disclosures(docs: DataFrame, found: DataFrame, params: PiiParams) -> DataFrame:
    """(key, terms): the term spans of the documents that have any."""
    pairs = written(entity_pairs(found, params.least_contexts), "pii-pairs")
    documents = term_documents(docs, written(open_terms(pairs, found, params), "pii-terms"))
    telling = pairs.join(documents, "term").where(certain(params))
    spans = occurrences(docs, written(telling.select("term").distinct(), "pii-telling"))
    span = F.struct(F.lit(KINDS.index("term")).alias("rank"), "start", "end")
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def pii_spans(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, base counts, base_sha256, n_term, spans and found (structs): a row for each document."""
    found = written(scanned(docs), "pii")
    out = found.drop("entities", "terms").join(disclosures(docs, found, params), "key", "left").drop("key")
    both = F.concat("base", F.coalesce("terms", F.array().cast("array<struct<rank:int,start:bigint,end:bigint>>")))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform("found", lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")))
    n_term = F.size("found") - F.size("base")
    out = out.withColumn("found", F.array_sort(both)).withColumn("n_term", n_term.cast("bigint"))
    return out.withColumn("spans", F.array_join(text, ",")).drop("base", "terms")


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not text or not spans:
        return text
    parts, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            parts += [text[last:start], f"<{kind.upper()}>"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with its own columns, every span in text generalised to the name of its kind (and n_chars, if there, the new length)."""
    key, terms = clear_name(docs, "row_key"), clear_name(docs, "row_terms")
    found = written(scanned(docs).where(F.size("entities") > 0), "pii")
    more = disclosures(docs, found, params).select(F.col("key").alias(key), F.transform("terms", lambda s: F.array(s["start"], s["end"])).alias(terms))
    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(more, key, "left")

    @F.pandas_udf("string")
    def clean(text, spans):
        import pandas as pd

        return pd.Series([redacted(t, base_spans(t or "") + [("term", int(a), int(b)) for a, b in ([] if s is None else s)]) for t, s in zip(text, spans)], dtype=object)

    out = joined.withColumn("text", clean("text", terms))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
