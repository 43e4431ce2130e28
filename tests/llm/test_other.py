"""Pages, vectors, conversations and the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np


def test_pages(spark):
    from lexmill.llm.html_extract import extract

    long_ = " ".join(f"Word{i}" for i in range(400))
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <header class="site-header"><a href="/">Logo</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies</p></div>
    <article><h1>A &amp; B</h1><p><b>First &eacute;&#233;.<br><p>{long_}</p><div class="ad">Buy now</div><ul><li>x<li>y</ul></article>
    <div class="comments"><div class="comment"><p>Nice text, thanks a lot</p></div></div>
    <aside><p>Related things</p></aside><form><label>Mail</label><input></form><footer>&copy; me</footer></body>"""
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "plain words"), (5, "u", "<p>a<div>" * 3000), (1, "u", page)]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == f"A & B\nFirst éé.\n{long_}\nx\ny"
    assert by[2].text == by[3].text == "" and all(r.n_chars == len(r.text) for r in got)


def test_no_kept_element_under_a_dropped_one():
    from lexmill.llm.html_extract import MAIN_MARK, Page, decode, features, model, training_page

    rng, right, n = random.Random(123), 0, 80
    for _ in range(n):
        page = Page(training_page(rng))
        kept = decode(page, model().log_odds(features(page)))
        assert all(kept[p] for p, k in zip(page.parents, kept) if k and p >= 0)
        main = np.array([MAIN_MARK in a for a in page.attrs])
        for i in range(len(main) - 1, 0, -1):
            main[page.parents[i]] |= main[i]
        right += page.text(kept) == page.text(main)
    assert right >= 0.85 * n


def test_decoding_is_the_best_consistent_labelling():
    from itertools import product

    from lexmill.llm.html_extract import Page, decode

    page = Page("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    n = len(page.tags)
    rng = np.random.default_rng(1)
    for _ in range(30):
        odds = rng.normal(size=n) * 2
        score = lambda kept: sum(-np.logaddexp(0, -o if k else o) for o, k in list(zip(odds, kept))[1:])
        fits = [k for k in product([False, True], repeat=n) if k[0] and all(not k[i] or k[page.parents[i]] for i in range(1, n))]
        assert np.isclose(score(decode(page, odds)), max(map(score, fits)))


def test_pages_of_other_layouts_and_odd_tables(spark):
    from lexmill.llm.html_extract import Page, extract, main_texts, model

    body = "word other text. " * 40
    page = f"<body><nav><a href=/>x</a></nav><article><header><h1>Head line here</h1></header><p>{body}</p></article><section id='responses'><p>nice article thanks</p></section></body>"
    assert main_texts([page], model()) == [f"Head line here\n{body.strip()}"]
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    got = extract(spark.createDataFrame([(1, "u", f"<article><p>{body}&#65;&#{'9' * 5000};&#00000000000066;</p></article>", "clash", "clash")], schema)).collect()
    assert got[0].text == f"{body}A\ufffdB" and extract(spark.createDataFrame([], schema)).count() == 0
    assert Page("<p>a<table><tr><td>b<td>c<tr><td>d</table></section><b>e</i></b>").tags == ["#root", "p", "table", "tr", "td", "td", "tr", "td", "b"]


def test_hostile_pages_take_time_in_proportion():
    import time

    from lexmill.llm.html_extract import main_texts, model

    trees, n = model(), 60_000
    hostile = ['<a "' * n, "<a x" * n, '<a x=">"' * n, "<div>" * n + "</section>" * n, "<b>" * n + "</i>" * n, "<p>" + "<b>" * n + "<hr>" * n, "<li><ul>" + "<b>" * n + "<li></li>" * n, "<script>" + "</script " * n, "<p>&#" + "9" * 10 * n]
    for page in hostile:
        began = time.process_time()
        main_texts([page], trees)
        assert time.process_time() - began < 30, page[:20]


def _exact(vectors, queries, k):
    out = {}
    for q, x in queries.items():
        scores = sorted((-float(np.dot(x, v)), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_neighbours(spark):
    from lexmill.llm.neighbours import ForestParams, search

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = {i: (centres[i % 12] + 0.2 * rng.normal(size=16)).tolist() for i in range(600)}
    for i in range(300, 420):
        vectors[i] = vectors[300]  # a hot vector
    bad = [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [1.0, None]), (1100, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([*vectors.items(), *bad, (7, vectors[7])], "id bigint, v array<double>")
    params = ForestParams(k=20, trees=8, leaf_rows=64, candidates=800, route_bits=6)
    got = defaultdict(list)
    for r in search(df, df.where("id % 20 = 0"), params).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = _exact(vectors, {i: v for i, v in vectors.items() if i % 20 == 0}, 20)
    assert set(got) == set(want) and all([r for r, *_ in g] == list(range(1, 21)) for g in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    hot = [i for _, i, _ in got[300] if 300 <= i < 420]
    assert hot and hot == list(range(301, 301 + len(hot)))
    assert all(abs(s - np.dot(vectors[q], vectors[i])) < 1e-9 for q, g in got.items() for _, i, s in g)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id bigint, v array<double>")
    assert [tuple(r) for r in search(few, few.where("id = 0")).collect()] == [(0, 1, 1, 2.0)]
    assert search(few.where("id > 5"), few).count() == 0


def test_neighbours_without_clusters_keep_their_recall(spark):
    """Far more rows than candidates, and no direction in common."""
    from lexmill.llm.neighbours import ForestParams, search

    x = np.random.default_rng(8).standard_normal((4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = defaultdict(set)
    for r in search(df, df.where("id % 20 = 0"), ForestParams(k=10, trees=6, leaf_rows=256, candidates=500, route_bits=8)).collect():
        got[r.query_id].add(r.vec_id)
    right = 0
    for i in range(0, len(x), 20):
        scores = x @ x[i]
        scores[i] = -np.inf
        right += len(got[i] & set(np.argsort(-scores)[:10].tolist()))
    assert right >= 0.9 * 10 * 200


def test_chat_windows(spark):
    from lexmill.llm.chat import CONTROLS, ChatParams, chat_windows, read_back

    rng = random.Random(6)
    odd = [*CONTROLS, "\\", "\\\\", "<\\|", "<|turn|>", "<|text|>x<|end|>", "\n", "é😀", "word "]
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 40)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", None, "<|end|>\\"])
            rows.append((conv, turn, role, None if rng.random() < 0.05 else "".join(rng.choice(odd) for _ in range(rng.randint(0, 60)))))
    rows += [(50, 1, "assistant", "same")] * 2 + [(None, None, "user", "x"), (51, 0, "assistant", "long " * 20000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, span string")
    spans = chat_windows(df, ChatParams(budget=64, reserve=16)).cache()
    got = {r.conv_id: r for r in read_back(spans).collect()}
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(turns)
    for c, all_ in turns.items():
        all_.sort()
        said, lost = "".join(f"{r}\n{x}\n" for _, r, x in all_), "".join(x for _, r, x in all_ if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(all_), sha(said), len(lost), sha(lost))
    # the budget holds for whole windows, what they repeat included, but where one turn alone is over it
    cost = lambda x: -(-len(x.encode()) // 4) + 4
    for r in spans.collect():
        inside = [x[len("<|turn|>") :].split("<|text|>", 1) for x in r.formatted.split("<|end|>")[:-1]]
        plain = [re.sub(r"(?s)\\(.)", r"\1", x) for _, x in inside]
        assert r.tokens == sum(map(cost, plain)) and len(inside) > r.n_repeated
        alone = len(inside) - (inside[0][0] == "system") == 1
        assert r.tokens <= 64 or alone or inside[0][0] == "system" and cost(plain[0]) > 32
    later = spans.where("span > 0 and conv_id % 2 = 1 and conv_id < 50").collect()
    assert later and all(r.formatted.startswith("<|turn|>system") and 1 <= r.n_repeated <= 3 for r in later)
    assert read_back(chat_windows(df.where("false"))).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from lexmill.llm.langid import held_out  # noqa: F401

    rng = random.Random(8)
    words = "the of and to in is that it for with was on as by this be at from house river green small dog walked".split() + [f"word{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(120) + (" write to a@b.example now" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(10)] + [(200, "short", "en", "s0", 0), (201, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "redact_pii", "mix_sources", "encode_text"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({r.doc_id for r in docs.collect()})
    assert 200 not in kept[0] and 201 not in kept[0] and kept[0] >= set(range(60)) and not kept[1] & set(range(100, 110)) and kept[1] == kept[2]
    assert docs.where("text like '%@b.example%'").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row_key string, whole_row string, rank int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rng = random.Random(2)
    words = "the of and to in is that it for with house river green small dog walked slowly".split() + [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(90), rng.choice(["en", None, "xx"]), rng.choice(["a", None]), 0, "x", "x", "x", 1) for i in range(40)]
    rows += [rows[0], (None, text(80), "en", "a", 0, "x", "x", "x", 1), (50, None, None, None, None, None, None, None, None), (51, "", "en", "a", 0, "x", "x", "x", 1), (52, text(20_000), "en", "a", 0, "x", "x", "x", 1)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        docs.write.parquet(f"{tmp_path}/odd/{i}")
        docs = spark.read.parquet(f"{tmp_path}/odd/{i}")
    ids = [r.doc_id for r in docs.collect()]
    assert sorted(x for x in ids if x is not None) == [*range(40), 52] and ids.count(None) == 1
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert out.where("not round_trip").count() == 0 and out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]


def test_small_arrow_batches(spark, tmp_path, monkeypatch):
    """All Python of the pipeline's stages runs in small batches, after which the session's own size holds again."""
    import corpus_pipeline
    from lexmill.llm import common, jaccard, pii

    sizes, real = [], common.written

    def seen(df, label):
        sizes.append(spark.conf.get(common.BATCH, None))
        return real(df, label)

    for module in (jaccard, pii, corpus_pipeline):
        monkeypatch.setattr(module, "written", seen)
    docs = spark.createDataFrame([(i, f"word{i} and some more words to bob{i}@corp.example here", "en", "a", 0) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("ngram_jaccard", "redact_pii", "encode_text"):
            sizes.clear()
            out = stage(spark, docs, "")
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert sizes and set(sizes) == {str(common.SMALL_BATCH)} and "Arrow" not in plan and "Python" not in plan
            assert out.count() == 40 and spark.conf.get(common.BATCH, None) is None

    one = spark.range(5000).coalesce(1)
    with common.small_batches(spark):
        most = one.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id bigint").count()
        parity = common.map_lists(one, lambda b: {"k": [i % 2 for i in b["id"]], "n": [1] * len(b["id"])}, "k bigint, n bigint", rows=None, summed=True)
        assert most == 5 and sorted(map(tuple, parity.collect())) == [(0, 2500), (1, 2500)]
    spark.conf.set(common.BATCH, "70")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(common.BATCH) == "70"
        assert spark.conf.get(common.BATCH) == "70"
    finally:
        spark.conf.unset(common.BATCH)
