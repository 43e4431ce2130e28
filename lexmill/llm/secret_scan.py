"""Secret scans: three kinds of fixed form, and a battery of randomness tests for the rest.

Fixed forms are leftmost non-overlapping matches of each kind; a match that fails its extra
condition is dropped and the search goes on after it. A span is the whole match, in code points.

Any other run of 20 or more key-like characters is a candidate. Its encoding is inferred from
its characters. Three tests hold it against uniform draws from that alphabet: chi-squared over
groups of the alphabet, Wald-Wolfowitz runs above and below the alphabet's middle, and serial
correlation of neighbours; a candidate that one of them rejects at REJECT, or that shows no
encoding, is not random and has the p-value 1. For the others, p is how likely ordinary text of the
same length gets as uniform a chi-squared over character classes and letters (which grows with the
length, so that longer candidates are told from text more surely). Benjamini-Hochberg over the
p-values of all candidates of the corpus, those of p-value 1 included, sets the threshold; only a
histogram of fixed size comes to the driver.

Defined results: null and empty texts have no spans and an empty table no rows; texts and tokens of
any length are scanned whole, in time that grows with their length; repeated rows are repeated;
candidates that overlap a base span are left to it. Only doc_id and text are read, whatever other
columns are called.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_lists, written

KINDS = ["assign", "access", "hex", "random"]
#: The base forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: "[0-9a-f]+" matches whole runs only, so a run of 24 and more can be asked for at once.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINT = re.compile(r"passw|secret|token|api", re.IGNORECASE | re.ASCII)
#: Whole runs; a hex match lies within one.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
#: Share of a text's letters and digits: what ordinary words look like to the tests.
TEXT_LOWER, TEXT_UPPER, TEXT_DIGIT, TEXT_MARK = 0.93, 0.04, 0.02, 0.01
REJECT = 0.001
BINS = 2000  #: of -log10(p), a tenth wide


@dataclass(frozen=True)
class SecretParams:
    false_share: float = 1e-4  #: of discoveries, by Benjamini-Hochberg


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed forms."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for run in CANDIDATE.finditer(text) for m in HEX.finditer(text, *run.span())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    return _tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) if df > 0 else 1.0


HEX_LOW, HEX_UP = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def alphabet(token: str) -> tuple[str, str] | None:
    """Name and characters of the smallest encoding that has all of the token's characters and shows both letters and digits or cases."""
    used = set(token)
    for name, chars in (("hex", HEX_LOW), ("hex", HEX_UP), ("base32", BASE32)):
        if used <= set(chars) and any(c.isdigit() for c in used) and any(c.isalpha() for c in used):
            return name, chars
    marks = used - set(BASE64)
    if len(marks) <= 2 and (marks <= set("+/") or marks <= set("-_")):
        classes = sum((any(c.islower() for c in used), any(c.isupper() for c in used), any(c.isdigit() for c in used)))
        if classes >= 2:
            return "base64", BASE64 + "".join(sorted(marks))
    return None


def battery(token: str, chars: str) -> float:
    """The smallest p-value of the token as uniform draws from chars."""
    n, k = len(token), len(chars)
    place = {c: i for i, c in enumerate(chars)}
    at = [place[c] for c in token]
    groups = min(8, max(2, n // 5))
    counts = Counter(i * groups // k for i in at)
    size = Counter(i * groups // k for i in range(k))
    chi = sum((counts[g] - n * size[g] / k) ** 2 / (n * size[g] / k) for g in range(groups))
    most = max(Counter(token).values())  # the same character over and over is not random
    log_most = math.log(k) + math.lgamma(n + 1) - math.lgamma(most + 1) - math.lgamma(n - most + 1) - most * math.log(k)
    up = [2 * i >= k for i in at]
    a, b = sum(up), n - sum(up)
    p_runs = 1.0
    if a and b:
        mean, runs = 2 * a * b / n + 1, 1 + sum(x != y for x, y in zip(up, up[1:]))
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(var)) if var > 0 else 1.0
    mean = sum(at) / n
    square = sum((i - mean) ** 2 for i in at)
    serial = sum((i - mean) * (j - mean) for i, j in zip(at, at[1:])) / square if square else 1.0
    p_serial = 2 * _tail(abs(serial + 1 / n) * math.sqrt(n))
    # an average count beyond 16 draws a character makes the bound on the largest count useless: chi-squared has the say
    p_most = math.exp(min(0.0, log_most)) if most > n / k + 1 else 1.0
    return min(_chi_tail(chi, groups - 1), p_runs, p_serial, p_most)


def text_shares(chars: str, one_case: bool) -> list[float]:
    """The share of each character of chars in ordinary text."""
    marks = max(1, sum(not c.isalnum() for c in chars))

    def share(c: str) -> float:
        if c.isdigit():
            return TEXT_DIGIT / 10
        if not c.isalpha():
            return TEXT_MARK / marks
        return (TEXT_LOWER + TEXT_UPPER) / 26 if one_case else (TEXT_LOWER if c.islower() else TEXT_UPPER) / 26

    found = [share(c) for c in chars]
    return [x / sum(found) for x in found]


def text_p(token: str, chars: str) -> float:
    """How likely ordinary text of the same length is as uniform over chars as the token: the lower tail of a chi-squared over classes.

    Classes are capitals, small letters, digits and marks. Under text shares q in place of uniform u
    the statistic sum((observed - n u)**2 / (n u)) is about normal, with a mean that grows with n.
    """
    one_case = not (any(c.islower() for c in token) and any(c.isupper() for c in token))
    kind = lambda c: "d" if c.isdigit() else "m" if not c.isalpha() else "a" if one_case or c.islower() else "A"
    n, q, u = len(token), Counter(), Counter()
    for c, share in zip(chars, text_shares(chars, one_case)):
        q[kind(c)] += share
        u[kind(c)] += 1 / len(chars)
    seen = Counter(map(kind, token))
    chi = sum((seen[g] - n * u[g]) ** 2 / (n * u[g]) for g in u)
    over = {g: (q[g] - u[g]) / u[g] for g in u}
    mean = sum(q[g] * (1 - q[g]) / u[g] for g in u) + n * sum(q[g] * over[g] for g in u) - n * sum(u[g] * over[g] for g in u)
    first = sum(q[g] * over[g] for g in u)
    var = 4 * n * (sum(q[g] * over[g] ** 2 for g in u) - first**2) + 2 * (len(u) - 1)
    return max(_tail((mean - chi) / math.sqrt(var)), 1e-190)


def candidates(text: str, base: list[tuple[int, str, int]]) -> tuple[list[tuple[int, str, int, float]], int]:
    """(start, "random", end, p) of runs that pass the battery, and the number of all runs; those that overlap a base span are not counted."""
    found, tested, at, reach = [], 0, 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach > m.start():
            continue
        tested += 1
        token = m.group().rstrip("=")
        if token.isalpha() and (token.islower() or token.isupper() or token.istitle()):
            continue
        if (coded := alphabet(token)) and battery(token, coded[1]) >= REJECT:
            found.append((m.start(), "random", m.end(), text_p(token, coded[1])))
    return found, tested


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, *_ in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_tested bigint, base_sha256 string, found array<struct<start:bigint,rank:int,kind:string,end:bigint,p:double>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and digest, and found: base spans (p null) and candidates."""

    def scan(batch: dict) -> dict:
        out = {name: [] for name in ("doc_id", "n_assign", "n_access", "n_hex", "n_tested", "base_sha256", "found")}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            base = base_spans(text or "")
            kinds = Counter(kind for _, kind, _ in base)
            out["doc_id"].append(doc_id)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(kinds[kind])
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            random, tested = candidates(text or "", base)
            out["n_tested"].append(tested)
            spans = [(*s, None) for s in base] + random
            out["found"].append([{"start": s, "rank": KINDS.index(k), "kind": k, "end": e, "p": p} for s, k, e, p in spans])
        return out

    return map_lists(docs.select("doc_id", "text"), scan, SCHEMA)


def fdr_threshold(found: DataFrame, false_share: float) -> float:
    """The largest p that Benjamini-Hochberg lets pass, from a histogram of BINS cells over all n_tested candidates."""
    p = found.select(F.explode("found").alias("s")).where("s.p is not null").select(F.least(F.floor(-10 * F.log10("s.p")), F.lit(BINS - 1)).alias("bin"))
    counts = {r["bin"]: r["count"] for r in p.groupBy("bin").count().collect()}
    total, seen, best = found.agg(F.sum("n_tested")).head()[0] or 0, 0, 0.0
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if 10 ** (-b / 10) <= false_share * seen / total:
            best = 10 ** (-b / 10)
    return best


def secret_scan(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_tested, base_sha256, n_random, spans, and found as structs: a row for each document."""
    found = written(scanned(docs), "secrets")
    most = fdr_threshold(found, params.false_share)
    kept = F.array_sort(F.filter("found", lambda s: s["p"].isNull() | (s["p"] <= most)))
    out = found.withColumn("found", kept)
    text = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    n_random = F.size(F.filter("found", lambda s: s["p"].isNotNull())).cast("bigint")
    return out.withColumn("n_random", n_random).withColumn("spans", F.array_join(text, ","))
