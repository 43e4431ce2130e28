"""Operators on documents against brute force, and on what is odd: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def test_quality_counts(docs, rows):
    from lexmill.llm.quality import quality_rules

    got = quality_rules(docs).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for doc_id, text, *_ in rows:
        w = WORD.findall(text or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_divergence_rejects_odd_distributions(spark):
    from lexmill.llm.quality import quality_rules

    good = "the dog of the house and a cat in the garden with that bird was on it for you to see this and be at rest from now on by are "
    words = [" ".join(f"{w}{i}{j}" if len(w) > 3 else w for j, w in enumerate(good.split() * 4)) for i in range(30)]
    odd = [w.upper().replace(" ", "!! ") for w in words[:1]] + [" ".join(f"q{i}" for i in range(200))]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(words + odd)], "doc_id bigint, text string, lang string")).collect()}
    assert [got[30].kept, got[31].kept] == [False, False] and got[30].char_jsd > got[0].char_jsd
    assert all(got[i].kept for i in range(30) if not got[i].base_failed)


def test_quality_rejects_numbers_and_texts_without_common_words(spark):
    import random

    from lexmill.llm.quality import quality_rules

    rng = random.Random(5)
    common = "the of and to in is that for it with from by are be this at on or you".split()
    prose = lambda share, other: " ".join(rng.choice(common) if rng.random() < share else other() for _ in range(300))
    word = lambda: "".join(rng.choice("aeiounrstl") for _ in range(rng.randint(3, 9)))
    number = lambda: str(rng.randint(10, 10**6))
    good = [(i, prose(0.3, word), "en") for i in range(60)]
    bad = [(100, prose(0.0, word), "en"), (101, prose(0.3, number), "en"), (102, " ".join(["the", "of"] * 3 + [word() for _ in range(4)] * 1) + " " + prose(0.95, word), "en"), (103, prose(0.3, lambda: word() + "!?.;"), "en")]
    long_ = [(200, " ".join(f"{word()} {common[i % len(common)]} {word()}" for i in range(60_000)), "en"), (201, "x" * 500_000, "en"), (202, "", None)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(*r, "clash") for r in good + bad + long_], "doc_id bigint, text string, lang string, q_words string")).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i, *_ in bad)
    assert got[200].n_words == 180_000 and not got[201].kept and not got[202].kept
    w = long_[0][1].split()
    tri = Counter(zip(w, w[1:], w[2:]))
    assert got[200].n_repeat_words == len({j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_filter_quality_keeps_columns(docs, empty):
    from lexmill.llm.quality import filter_quality

    kept = filter_quality(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert filter_quality(empty).count() == 0


def test_near_duplicates_are_the_brute_force_components(docs, rows):
    from lexmill.llm.jaccard import near_duplicates

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    low = {i: i for i, _ in sets}
    for _ in sets:
        for a, x in sets:
            for b, y in sets:
                if (a == b or x and y and 100 * len(x & y) >= 80 * len(x | y)) and low[b] < low[a]:
                    low[a] = low[b]
    got = near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == Counter((i, len(s), low[i]) for i, s in sets)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert len({low[i] for i in (7, 8, 11)}) == 1


def test_large_group_of_near_copies(spark):
    """A hot group: many edited copies of one text, some linked to the source only, and a passage that others share."""
    import random

    from lexmill.llm.jaccard import JaccardParams, near_duplicates, shingles

    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(160):
        t = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            t[rng.randrange(150)] = f"e{i}x{rng.randrange(10**6)}"
        texts.append(t)
    texts += [[f"z{i}q{j}" for j in range(100)] + base[:60] for i in range(40)]
    sets = [set(shingles(" ".join(t)).tolist()) for t in texts]
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if 100 * shared >= 80 * (len(x) + len(sets[j]) - shared) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, JaccardParams(frequent=10)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    exact = {r.doc_id: r.component_id for r in near_duplicates(df, JaccardParams(frequent=10, miss=0)).collect()}
    assert exact == got


def test_prefixes_hold_the_first_shared_token():
    from lexmill.llm.jaccard import JaccardParams, prefix_lengths

    p = JaccardParams()
    for n in range(1, 60):
        probe, index = prefix_lengths(n, 0, p)
        assert probe == n - math.ceil(0.8 * n - 1e-9) + 1 and 1 <= index <= probe
    assert prefix_lengths(1000, 1000, p)[0] < 40 and prefix_lengths(1000, 1000, JaccardParams(miss=0))[0] == 201


def test_keep_one(docs, empty):
    from lexmill.llm.jaccard import keep_one, near_duplicates

    kept = keep_one(docs)
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert kept.columns == docs.columns and max(ids.values()) == 1
    assert 7 in ids and 11 not in ids and None in ids and 1 in ids
    assert near_duplicates(empty).count() == 0
    assert keep_one(empty).count() == 0


def test_language(spark, docs, empty):
    from lexmill.llm.langid import identify, learn

    got = identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == ("en" if i % 3 else "fr") for i in range(14, 44))
    assert identify(empty).count() == 0
    none = identify(spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")).collect()
    assert [r.lang_pred for r in none] == ["und"]
    model = learn(docs)
    assert model.langs == ["en", "fr"] and model.judge("12 34 --") is None and model.judge("a")


def test_kneser_ney_sums_to_one():
    import numpy as np

    from lexmill.llm.langid import codes, grams, kneser_ney

    texts = {"x": "abab abba baab", "y": "bbb aab"}
    counts = {k: np.unique(grams(codes(t)), return_counts=True) for k, t in texts.items()}
    model = kneser_ney(counts)
    for start in ("ab ", "b a", "zzz"):
        context = np.array([ord(c) for c in start], np.uint64)
        total = np.zeros(2)
        for c in " ab":
            total += np.exp(-model.entropies(np.append(context, np.uint64(ord(c)))))
        unseen = np.exp(-model.entropies(np.append(context, np.uint64(ord("q")))))
        assert np.allclose(total + unseen, 1, atol=0.02)


def test_language_model_is_the_same_however_rows_are_dealt_and_where_it_is_cut(spark):
    import random

    import numpy as np

    from lexmill.llm.langid import LangParams, codes, grams, kneser_ney, learn, predict

    rng = random.Random(12)
    letters = {"x": "abcdefgh", "y": "efghijkl", "z": "aeiounrst"}
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 60)))
    rows = [(i, text(letters[k]), k, "clash") for i in range(240) for k in [rng.choice("xyz")]] + [(999, "é" * 100_000, "x", "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    model, again = learn(df), learn(df.repartition(7))
    assert model.curve == again.curve and all((model.logs[o] == again.logs[o]).all() and (model.keys[o] == again.keys[o]).all() for o in range(1, 5))
    # the brute force: counts of all rows, by hand
    counts = {k: np.unique(np.concatenate([grams(codes(t)) for _, t, lang, _ in rows if lang == k]), return_counts=True) for k in "xyz"}
    plain = kneser_ney(counts)
    assert all(np.allclose(plain.logs[o], model.logs[o]) and np.allclose(plain.weights[o], model.weights[o]) for o in range(1, 5))
    # cut to a tenth, it still is a distribution and mostly right
    small = learn(df, LangParams(most_cells=4_000))
    assert sum(len(small.keys[o]) for o in range(1, 5)) * 3 <= 4_000 < sum(len(model.keys[o]) for o in range(1, 5)) * 3
    for start in ("ab ", "efg", "zzz"):
        context = np.array([ord(c) for c in start], np.uint64)
        seen = np.unique(small.keys[1]).tolist()
        total = sum(np.exp(-small.entropies(np.append(context, np.uint64(c)))) for c in [*seen, ord("q")])
        assert np.allclose(total, 1, atol=1e-6)
    right = lambda m: sum(r.lang_pred == x[2] for r, x in zip(sorted(predict(df, m).collect(), key=lambda r: r.doc_id), rows))
    assert right(model) > 0.97 * len(rows) and right(small) > 0.9 * len(rows)


def test_mixture(docs, rows, empty):
    from lexmill.llm.mixing import mix, mixture

    got = mixture(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        left, w = sum(sizes.values()) - sum(full.values()), sum(weight[s] for s in order if s not in full)
        share = {s: left * weight[s] / w for s in order if s not in full}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3.0 * sizes[s] for s in over}
    want = full | share
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == pytest.approx(want[s], rel=0.1) for s in order if want[s] > 500)
    key = lambda rs: Counter((r.doc_id, r.size, r.taken) for r in rs)
    assert key(mixture(docs.repartition(7)).collect()) == key(got)
    assert mixture(empty).count() == 0
    mixed = mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mix_rates_are_the_entropy_balance(spark):
    """Rates against a plain solver: exp(lam * size), cut at 3, with the lam of each source by bisection."""
    import random

    from lexmill.llm.mixing import mixture

    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 41, 200])), "abc"[i * i % 7 % 3]) for i in range(900)]
    got = mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for source in "abc":
        own = [r for r in got if r.source == source]
        target, low, high = own[0].target, -60.0, math.log(3)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(min(3, math.exp(min(mid * r.size, 5))) * r.size for r in own) > target else (mid, high)
        full = target >= 3 * own[0].source_size
        assert all(r.rate == pytest.approx(3 if full else min(3, math.exp(low * r.size)), rel=1e-6) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 1
        for size in {r.size for r in own}:  # copies of one size differ by one at most, and sum up to the rate
            copies = [r.copies for r in own if r.size == size]
            rate = next(r.rate for r in own if r.size == size)
            assert max(copies) - min(copies) <= 1 and abs(sum(copies) - rate * len(copies)) <= 1 + 200 / size


def test_secrets(spark, docs, rows, empty):
    from lexmill.llm.secret_scan import ASSIGN, secret_scan

    key = "kQ9z7LmPx2VbN8sRtY4wHcJ6fD1gAe3U"
    more = [(100, f"Password: 'secret99' AKIA{'B2' * 10} {'0f' * 13} api-key=short {key}"), (101, "TOKEN=token=abcdefgh AKIA123 " + "a" * 23), (102, "thequickbrownfoxjumpsoverthelazydog " * 3)]
    got = {r.doc_id: r for r in secret_scan(spark.createDataFrame(more, "doc_id bigint, text string")).collect()}
    assert (got[100].n_assign, got[100].n_access, got[100].n_hex, got[100].n_random) == (1, 1, 1, 1)
    at = more[0][1].index(key)
    assert f"random:{at}:{at + len(key)}" in got[100].spans
    m = ASSIGN.search(more[1][1])
    assert got[101].base_sha256 == hashlib.sha256(f"assign:{m.start()}:{m.end()}".encode()).hexdigest()
    assert got[102].spans == "" and got[102].n_random == 0
    assert secret_scan(docs).count() == len(rows) and secret_scan(empty).count() == 0


def test_randomness_battery():
    import random

    from lexmill.llm.secret_scan import BASE64, battery, text_p

    rng = random.Random(2)
    keys = ["".join(rng.choice(BASE64) for _ in range(32)) for _ in range(300)]
    assert sum(battery(k, BASE64) >= 0.001 for k in keys) > 290 and sorted(text_p(k, BASE64) for k in keys)[285] < 1e-6
    assert battery("a" * 32, BASE64) < 0.001 and battery("aB" * 16, BASE64) < 0.001
    assert text_p(keys[0], BASE64) < text_p(keys[0][:20], BASE64)


def test_secret_spans_match_plain_regexes():
    import random

    from lexmill.llm.secret_scan import KINDS, base_spans

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    access, hexa = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")

    def plain(t):
        out = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        out += [(m.start(), "access", m.end()) for m in access.finditer(t) if len(m[0]) >= 20]
        out += [(m.start(), "hex", m.end()) for m in hexa.finditer(t) if len(m[0]) >= 24]
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))

    rng = random.Random(7)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "\u017fecret", "to\u212aen", '"', "'", " ", ":", "=", "AKIA", "A1B2C3D4", "0a1b2c3d4e5f", "é", "x.y/z", "G", "-", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(8000)]
    assert all(base_spans(t) == plain(t) for t in texts)


def test_secrets_in_very_long_tokens_and_fdr_over_all_candidates(spark):
    import random

    from lexmill.llm.secret_scan import BASE64, HEX_UP, secret_scan

    rng = random.Random(3)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    rows = [(0, draw(BASE64, 60_000)), (1, draw(HEX_UP, 12_000)), (2, "g" * 1_000_000), (3, "aB1" * 100_000), (4, "token: " * 50_000), (5, None), (6, ""), (6, "")]
    words = " ".join("SomeVeryLongIdentifierName" + draw("abcdefg", 6) for _ in range(400))
    rows += [(10, words), (11, f"key {draw(BASE64, 24)} here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r for r in secret_scan(df).collect()}
    assert got[0].spans == "random:0:60000" and got[1].spans == "random:0:12000" and got[10].n_random == 0 and got[10].n_tested == 400
    assert all(got[i].spans == "" for i in (2, 3, 4, 5, 6)) and len(got) == 9


def test_pii_spans_match_plain_regexes():
    import random

    from lexmill.llm.pii import base_spans, luhn

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def plain(t):
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15]

    rng = random.Random(3)
    texts = ["".join(rng.choice("aB1.@-+ (%_9é") for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    texts += ["4111 1111-1111 1111 x 4111111111111112", "+49 (30) 1234-5678", "a@b.c_x@d.com", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4"]
    assert all(base_spans(t) == plain(t) for t in texts)


def test_pii_in_very_long_texts(spark):
    from lexmill.llm.pii import base_spans, pii_spans, redact

    zeros = "1.2.3." + "0" * 5000 + "1"
    assert base_spans(zeros) == [("ip", 0, len(zeros))] and base_spans("1.2.3." + "9" * 5000) == []
    n = 200_000
    hostile = ["1" * n, "1." * n, "+1" + " " * n, "a@" * n, "a" * n + "@", "+1 " * n, "é" * n, "4 " * n, zeros]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*hostile, "mail a@b.example now", None, ""])], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r for r in pii_spans(df).collect()}
    assert len(got) == 12 and got[8].n_ip == got[9].n_email == 1 and got[10].spans == got[11].spans == ""
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[9] == "mail <EMAIL> now" and clean[8] == "<IP>" and clean[10] is None and clean[6] == hostile[6]


def test_pii_terms_and_redaction(spark, docs, rows, empty):
    from lexmill.llm.pii import pii_spans, redact

    told = [(200 + i, f"note {w} Zorbalina wrote to zed@corp.example about {w}{w} today") for i, w in enumerate(["rain", "snow", "wind", "hail", "fog"])]
    plain = [(300 + i, f"about today they wrote a note to everyone number {i}") for i in range(20)]
    df = spark.createDataFrame(told + plain, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii_spans(df).collect()}
    start = told[0][1].index("Zorbalina")
    assert f"term:{start}:{start + 9}" in got[200].spans and all(got[i].spans == "" for i, _ in plain)
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert "Zorbalina" not in clean[200] and "zed@" not in clean[200] and "<EMAIL>" in clean[200] and clean[300] == plain[0][1]
    out = redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and pii_spans(docs).count() == len(rows)
    assert redact(empty).count() == 0 and pii_spans(empty).count() == 0


def test_pii_terms_of_copied_documents(spark):
    """A term beside one entity only is certain of it, however often its documents are copied."""
    from lexmill.llm.pii import pii_spans

    texts = [f"note {w} Zorbalina wrote to zed@corp.example about {w}{w}" for w in ("rain", "snow", "wind")] + ["here Quendolin has ann@corp.example to reach"]
    rows = [(10 * c + i, t) for i, t in enumerate(texts) for c in range(4)]
    rows += [(100 + i, f"they wrote a note here about what has come to reach number {i}") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows[:16]:
        start = t.index("Zorbalina" if "Zorbalina" in t else "Quendolin")
        assert f"term:{start}:{start + 9}" in got[i]
    assert all(got[i] == "" for i, _ in rows[16:])


def test_pii_terms_go_wherever_they_stand(spark):
    from lexmill.llm.pii import pii_spans, redact

    fill = " ".join(f"filler{'abcdefghij'[i % 10]} to" for i in range(40))
    rows = [(i, f"zed@corp.example {w} {fill} note by ZORBALINA, {fill} again Zorbalina") for i, w in enumerate(["rain", "snow", "wind"])]
    rows += [(10, f"{fill} and here zorbalina without an address"), (11, "Zorbalina@home.example wrote")]
    rows += [(20 + i, f"{fill} note by others again number {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii_spans(df).collect()}
    for i, t in rows[:4]:
        assert got[i].spans.split(",")[i < 3 :] == [f"term:{m.start()}:{m.end()}" for m in re.finditer("zorbalina", t, re.I)]
    assert got[11].spans == "email:0:22" and all(got[i].n_term == 0 for i, _ in rows[5:])
    assert not any("zorbalina" in r.text.lower() for r in redact(df).collect())


def test_pii_counts_grow_with_the_table(spark, monkeypatch):
    """Words that stand beside entities only by being common are not counted batch by batch; the terms found are those of a plain count."""
    import math
    import random
    from collections import Counter, defaultdict

    from lexmill.llm import pii

    made, real = [], pii.map_lists

    def counting(df, func, schema, **kw):
        out = real(df, func, schema, **kw)
        if schema == "term bigint, documents bigint":
            made.append(out.count())
        return out

    def letters(i):
        return "".join("abcdefghij"[int(c)] for c in f"{i:04d}")

    def rows_of(parts):
        rng, pool = random.Random(parts), [f"w{letters(i)}" for i in range(30 * parts)]
        out = []
        for g in range(12 * parts):  # words of the pool stand three times beside an entity of three copies, and a name does
            text = f"{' '.join(rng.sample(pool, 30))} name{letters(g)} user{g}@corp.example"
            out += [text] * 3
        return out + [" ".join(rng.choices(pool, k=120)) for _ in range(48 * parts)]

    def plain(texts):
        has, together = Counter(), defaultdict(Counter)
        for t in texts:
            base = pii.base_spans(t)
            terms = pii.terms_of(t, base)
            has.update(terms)
            for e in {t[s:end] for _, s, end in base}:
                together[e].update(terms)
        return {t for c in together.values() for t, n in c.items() if n >= 3 and math.log2(has[t] / n) <= 1}

    monkeypatch.setattr(pii, "map_lists", counting)
    for parts in (2, 10):
        texts = rows_of(parts)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(parts).localCheckpoint()
        got = {r.doc_id: r.spans for r in pii.pii_spans(df).collect()}
        telling = plain(texts)
        assert {f"name{letters(g)}" for g in range(12 * parts)} <= telling
        for i, t in enumerate(texts):
            terms = [f"term:{s}:{e}" for w, s, e in pii.outside(t, pii.base_spans(t)) if w in telling]
            assert [x for x in got[i].split(",") if x.startswith("term")] == terms
    assert 0 < made[1] <= 12 * made[0]


def test_sentencepiece_is_the_library_id_for_id(docs, rows, empty):
    import random

    import sentencepiece

    from lexmill.llm.spm import Vocabulary, decode, encode

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as f:
        own = Vocabulary(f.read())
    rng = random.Random(5)
    texts = ["".join(rng.choice("aàe th\nïn_.0é中 文😀x<>s/\t한") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * n for n in range(70)] + ["a" + " " * n + "b" for n in range(50)] + ["the quick brown fox " * 50]
    ids, same = own.encode(texts)
    assert [list(x) for x in ids] == library.encode(texts) and all(same)
    assert [own.decode(x) for x in ids] == texts
    encoded = encode(docs)
    assert Counter((r.doc_id, r.text) for r in decode(encoded).collect()) == Counter((r[0], r[1] or "") for r in rows)
    assert encoded.where("not round_trip or n_tokens != size(ids)").count() == 0 and encode(empty).count() == 0
    assert own.decode(own.encode(["a▁b"])[0][0]) == "a b"


def test_round_trip_is_of_the_text_itself(spark):
    import sentencepiece

    from lexmill.llm.spm import Vocabulary, encode

    texts = ["a▁b", "▁", " a  b ", "a\x00b\n\nc", "ab" * 4000 + "é中" * 500, "#" * 90 + "x" * 200, "kQ9z7LmPx2VbN8sRtY4wHcJ6fD1gAe3U" * 9]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as f:
        data = f.read()
    assert [list(x) for x in Vocabulary(data).encode(texts)[0]] == library.encode(texts)
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(9, None, None)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in encode(df).collect()}
    assert [got[i].round_trip for i in range(7)] == [False, False] + [True] * 5 and (got[9].ids, got[9].round_trip) == ([], True)
