"""Text keys, statistics, sources, dictionary, drift, streaming and the build records."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_fold_keys(spark):
    from lexmill.functions.text import accent_key, fold_key, fold_key_udf, fold_native, greeklish_candidates

    assert fold_key("άνθρωπος") == fold_key("ανθρωποσ") == fold_key("  ΆΝΘΡΩΠΟΣ ") and fold_key("προϊόν") == "προιον" and fold_key("ἄνθρωπος") == fold_key("άνθρωπος")
    assert fold_key(None) == "" and accent_key("ΛΌΓΟΣ") == "λόγοσ"
    df = spark.createDataFrame([("Λόγος  ΦΩΣ",), (None,), (" προϊόν ",)], "t string").select(fold_native(F.col("t")).alias("a"), fold_key_udf("t").alias("b"))
    assert all(r.a == r.b for r in df.collect())
    found = greeklish_candidates("logos")
    assert "λογοσ" in {fold_key(x) for x in found} and len(greeklish_candidates("ioioioioio")) <= 64
    assert all(x.startswith("θ") for x in greeklish_candidates("thalassa")) and greeklish_candidates("") == [""]


def test_statistics(spark):
    from lexmill.functions import stats

    assert stats.theil_sen([0, 1, 2, 3], [3, 5, 7, 9]) == 2 and stats.theil_sen([0, 1, 2, 3, 4], [3, 5, 7, 9, 999]) == 2
    up, flat = stats.mann_kendall([float(i) for i in range(12)]), stats.mann_kendall([1.0] * 12)
    assert up["tau"] == 1 and up["p"] < 0.05 and flat["p"] == 1 and stats.mann_kendall([1, 2])["p"] == 1
    assert stats.pettitt([0.1] * 8 + [0.5] * 8)[0] == 7 and stats.pettitt([0.1] * 8 + [0.5] * 8)[1] < 0.05 and stats.pettitt([1, 2, 3]) == (None, 1.0)
    assert stats.pool_budget({2016: 300, 2017: 300, 2018: 300, 2019: 1000, 2020: 1000}, 500) == dict.fromkeys(range(2016, 2021), 100)
    assert stats.pool_budget({2010: 5, 2011: 300, 2012: 300, 2013: 0}, 300) == {2010: 5, 2011: 148, 2012: 147, 2013: 0}
    rng = random.Random(1)
    low, high = stats.bca_interval(0.0, [rng.gauss(0, 1) for _ in range(2000)], [rng.gauss(0, 1) for _ in range(50)])
    assert -2.4 < low < -1.5 and 1.5 < high < 2.4 and math.isnan(stats.bca_interval(0, [], [])[0])
    row = spark.range(1).select(*[stats.erfc(F.lit(x)).alias(f"e{i}") for i, x in enumerate((0.0, 0.5, 2.0))], stats.g2(*[F.lit(float(x)) for x in (10, 10, 1000, 1000)]).alias("g"), stats.g2_p(F.lit(10.83)).alias("p"), stats.log_ratio(*[F.lit(float(x)) for x in (200, 100, 1000, 1000)]).alias("r")).first()
    assert all(abs(row[f"e{i}"] - math.erfc(x)) < 2e-7 for i, x in enumerate((0.0, 0.5, 2.0)))
    assert row.g == pytest.approx(0) and row.p == pytest.approx(0.001, abs=1e-4) and row.r == pytest.approx(1)
    ps = [0.001, 0.008, 0.02, 0.04, 0.2, 0.5, 0.9]
    q = [r.q_value for r in stats.with_bh(spark.createDataFrame([(p, i) for i, p in enumerate(ps)], "p double, i int"), "p", ["i"]).orderBy("p").collect()]
    assert q == sorted(q) and q[0] == pytest.approx(0.007) and q[-1] > 0.05


def test_abstention(spark):
    from lexmill.operators.calibration import decide

    rows = spark.createDataFrame([([0.7, 0.2, 0.1],), ([0.45, 0.44, 0.11],), ([0.6, 0.4, 0.0],)], "p array<double>")
    assert [r[0] for r in rows.select(decide(F.col("p"), ["a", "b", "c"], {}, 0.1)).collect()] == ["a", None, "a"]
    assert [r[0] for r in rows.select(decide(F.col("p"), ["a", "b", "c"], {"a": 0.8}, 0.1)).collect()] == [None, None, None]


def test_sources(spark, tmp_path):
    from lexmill.sources import corpora

    (tmp_path / "s.txt").write_text("1\tΜία πρόταση.\nχωρίς αριθμό\n\n3\t  \n")
    (tmp_path / "w.txt").write_text("1\tνερό\t12\n2\tκακό\tx\n3\n")
    (tmp_path / "c.txt").write_text("a\tb\t3\t4.5\na\tc\t3\tx\na\tb\t1\n")
    (tmp_path / "f.txt").write_text("και 100\nνα 0\nlone\n")
    (tmp_path / "p.csv").write_text('speech,sitting_date\n"γεια, ""σου""\nόλοι",12/03/1999\n,2001\nx,none\n')
    assert [r[0] for r in corpora.sentences(spark, str(tmp_path / "s.txt")).collect()] == ["Μία πρόταση.", "χωρίς αριθμό"]
    assert [tuple(r) for r in corpora.words(spark, str(tmp_path / "w.txt")).collect()] == [("1", "νερό", 12)]
    assert [tuple(r) for r in corpora.cooccurrences(spark, str(tmp_path / "c.txt")).collect()] == [("a", "b", 3, 4.5)]
    assert [tuple(r) for r in corpora.frequency_list(spark, str(tmp_path / "f.txt")).collect()] == [("και", 100)]
    assert [tuple(r) for r in corpora.speeches(spark, str(tmp_path / "p.csv")).collect()] == [('γεια, "σου"\nόλοι', 1999)]
    with pytest.raises(ValueError):
        corpora.speeches(spark, str(tmp_path / "p.csv"), text="nothing")
    folders = spark.createDataFrame([("/d/ell_news_2020_1M",), ("/d/ell_wikipedia_2016_300K",), ("/d/ell_other_1890_1M",), ("/d/plain",)], "path string")
    named = [tuple(r) for r in folders.select(corpora.corpus_of(F.col("path")), corpora.year_of(F.col("path"))).collect()]
    assert named == [("news", 2020), ("wiki", 2016), ("other", None), (None, None)]
    with pytest.raises(ValueError):
        corpora.one_corpus(folders)
    out = str(tmp_path / "out")
    for rows in ([("a", 1), ("b", 2)], [("b", 3)], [("b", 3)]):
        corpora.replace_partition(spark.createDataFrame(rows, "source string, n int"), out, ["source"])
    assert sorted((r.source, r.n) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3)]


ENTRIES = [
    {"word": "άνθρωπος", "pos": "noun", "lang_code": "el", "senses": [{"glosses": ["human being"], "tags": ["m"], "topics": ["biology"]}], "forms": [{"form": "masculine", "tags": ["table-tags"]}, {"form": "άνθρωπος", "tags": ["masculine"]}, {"form": "ανθρώπων", "tags": ["genitive", "plural"]}, {"form": "«", "tags": []}, {"form": "ος", "tags": []}], "sounds": [{"ipa": "/ˈan.θro.pos/"}, {"ipa": "[ˈan.θro.pos]"}], "etymology_templates": [{"name": "inh", "args": {"1": "el", "2": "grc", "3": "ἄνθρωπος"}}, {"name": "cog", "args": {"1": "xx", "2": "word"}}]},
    {"word": "λόγος", "pos": "noun", "senses": [{"raw_glosses": ["speech"], "synonyms": [{"word": "λαλιά"}]}], "synonyms": [{"word": "ομιλία"}, {"word": "λόγος"}, {"word": "see also κουβέντα"}], "related": [{"word": "άνθρωπος"}], "descendants": [{"word": "logos", "lang": "English", "lang_code": "en", "raw_tags": ["inherited"]}, {"word": "logos", "lang_code": "en"}]},
    {"word": "γράφω", "pos": "verb", "lang_code": "el", "senses": [{"glosses": ["to write; note (down)"]}], "forms": [{"form": "έγραψες"}, {"form": "γράφομαι"}, {"form": "έχω γραφτεί"}, {"form": "γράφεις", "tags": ["active"]}]},
    {"word": "ανθρώπων", "pos": "noun", "lang_code": "el", "senses": [{"glosses": ["genitive plural"], "form_of": [{"word": "άνθρωπος"}]}]},
    {"word": "skip-me", "pos": "noun", "lang_code": "en", "senses": [{"glosses": ["x"]}]},
]


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    from lexmill.sources import dictionary

    path = tmp_path_factory.mktemp("dict") / "d.jsonl"
    path.write_text("\n".join(json.dumps(e) for e in ENTRIES) + "\n{broken\n\n")
    raw = dictionary.read_entries(spark, str(path), "el-dump").cache()
    assert raw.where("_corrupt_record is not null").count() == 1
    return dictionary.admitted(raw).cache()


def test_dictionary(spark, entries):
    from lexmill.sources import dictionary as d

    lemmas = d.lemmas(entries).cache()
    assert [(r.lemma, r.gender) for r in lemmas.orderBy("lemma").collect()] == [("άνθρωπος", "masculine"), ("γράφω", None), ("λόγος", None)]
    forms = {(r.form, tuple(r.features)) for r in d.forms(entries).collect()}
    assert forms == {("ανθρώπων", ("genitive", "plural")), ("έγραψες", ("active",)), ("γράφομαι", ("passive",)), ("έχω γραφτεί", ("passive",)), ("γράφεις", ("active",))}
    related = {(r.word, r.target, r.relation_type) for r in d.relations(entries).collect()}
    assert related == {("λόγος", "ομιλία", "synonym"), ("λόγος", "λαλιά", "synonym"), ("λόγος", "κουβέντα", "synonym"), ("λόγος", "άνθρωπος", "related")}
    found = {r.target: r.target_lemma_id for r in d.resolved_relations(d.relations(entries), lemmas).collect()}
    assert found["ομιλία"] is None and found["άνθρωπος"] is not None
    assert [(r.relation, r.lang_code, r.term) for r in d.etymons(entries).orderBy("seq").collect()] == [("inherited", "grc", "ἄνθρωπος"), ("cognate", "xx", "word")]
    assert [r.ipa for r in d.pronunciations(entries).collect()] == ["ˈan.θro.pos"]
    assert [(r.relation, r.term) for r in d.descendants(entries).collect()] == [("inherited", "logos")]
    assert {r.gloss: r.tags for r in d.senses(entries).collect()} == {"human being": ["m", "biology"], "speech": [], "to write; note (down)": []}
    index = d.search_index(lemmas, d.forms(entries))
    assert index.where("normalized_surface = 'ανθρωπων'").select("surface_type", "rank_weight").first()[:] == ("form", 0.7) and index.count() == 8


def test_gloss_phrases(spark):
    from lexmill.sources.dictionary import gloss_phrases

    cases = {"eagle; kite (toy)": ["eagle", "kite"], "to book a seat": ["book a seat"], "plural of βιβλίο": [], "of; the": [], "one two three four": [], "βιβλίο": []}
    got = spark.createDataFrame([(g,) for g in cases], "g string").select("g", gloss_phrases(F.col("g")).alias("p")).collect()
    assert {r.g: r.p for r in got} == cases


def test_alignment(spark):
    from lexmill.operators.drift import aligned_drift, bootstrap_weights, residuals

    rng = np.random.default_rng(2)
    a = rng.normal(size=(100, 12))
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    assert residuals(a, a @ q, np.arange(100)).max() < 1e-6
    b = a @ q
    b[80:] = rng.normal(size=(20, 12))
    far = residuals(a, b, np.arange(100))
    assert far[:80].mean() < 0.02 and far[80:].mean() > 0.5
    rows = [("c", y, f"t{i:03}", m[i].tolist(), 50) for y, m in ((2001, a), (2009, b)) for i in range(100)]
    got = {(r.year, r.token): r.drift for r in aligned_drift(spark.createDataFrame(rows, "corpus string, year int, token string, vector array<double>, count bigint"), 2001).collect()}
    assert len(got) == 200 and got[2001, "t000"] == 0 and max(got[2009, f"t{i:03}"] for i in range(80)) < 0.02
    weights = bootstrap_weights(spark.range(2000), 3)
    assert abs(weights.agg(F.sum("weight")).first()[0] / 6000 - 1) < 0.05 and weights.exceptAll(bootstrap_weights(spark.range(2000), 3)).count() == 0


def test_query_log_stream(spark, tmp_path):
    from lexmill.streaming import query_log

    (tmp_path / "in").mkdir()
    index = spark.createDataFrame([("λογοσ",)], "normalized_surface string")
    for day, keys in (("01", ["λογοσ", "xx"]), ("02", ["xx"])):
        (tmp_path / "in" / f"{day}.json").write_text("\n".join(json.dumps({"query": k, "normalized": k, "ts": f"2024-01-{day}T10:00:00"}) for k in keys))
        log = query_log.resolved(query_log.read_log(spark, str(tmp_path / "in")), index)
        query_log.append(log, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 3 and rows.where("not resolved").count() == 2
    gaps = query_log.windowed_gaps(query_log.resolved(query_log.read_log(spark, str(tmp_path / "in")), index))
    sink = gaps.writeStream.format("memory").queryName("gaps").outputMode("complete").trigger(availableNow=True).start()
    sink.awaitTermination()
    assert spark.table("gaps").where("normalized = 'xx'").agg(F.sum("hits")).first()[0] == 2


def test_manifest(spark):
    from lexmill.operators import manifest

    import datetime

    at = lambda d: datetime.datetime(2024, 1, d)
    builds = spark.createDataFrame([("a", 1, "x", at(1), {"lemmas": 1}), ("a", 2, "y", at(2), {"lemmas": 2}), ("b", 2, "y", at(1), {"forms": 1})], manifest.BUILD)
    assert sorted((r.component, r.version) for r in manifest.latest(builds).collect()) == [("a", 2), ("b", 2)]
    frequency = spark.createDataFrame([(1, 8.615)], "lemma_id int, zipf double")
    drift = spark.createDataFrame([(0.1, None)], "drift_ci_lo double, drift_score_boot double")
    got = {r.check: r.failed for r in manifest.checks(builds, frequency, drift, ["lemmas", "forms", "senses"]).collect()}
    assert got == {"schema_version": False, "manifest_coverage": True, "zipf_scale": True, "drift_columns": True}


def test_neighbours_of_many_blocks_are_those_of_all_pairs(spark, monkeypatch):
    from lexmill.operators import vectors

    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[50:90] = v[0]  # ties, settled by id
    v[290:] = np.eye(16, dtype=np.float32)[:10] / 8
    v[299, :9] = 1 / 16  # its product with the nine before it is 1/128: 0.007813 in SQL, half away from zero
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(vectors, "LEAST", 16)
    monkeypatch.setattr(vectors, "BLOCKS", 1000)
    s = vectors.half_away(v.astype(float) @ v.astype(float).T)
    assert s[299, 290] == 0.007813 and vectors.half_away(np.array([-0.0000005, 0.0000015])).tolist() == [-0.000001, 0.000002]
    for given in (rows, rows.where("vec_id >= 290")):
        ids = [r.vec_id for r in given.select("vec_id").collect()]
        got = {}
        for r in vectors.exact_neighbours(rows, given, 5).orderBy("place").collect():
            got.setdefault(r.vec_id, []).append((r.neighbor, r.score))
        assert got == {i: sorted(((j, s[i, j]) for j in ids if j != i), key=lambda x: (-x[1], x[0]))[:5] for i in range(300)}


def test_a_block_of_queries_meets_more_rows_than_a_product():
    from lexmill.operators.vectors import Best, half_away

    rng = np.random.default_rng(4)
    q, v = rng.standard_normal((600, 8)), rng.standard_normal((5000, 8))
    best = Best(np.arange(600), q, 8)
    for part in np.split(np.arange(5000), [100, 2600]):
        best.add(part, v[part])
    s = half_away(q @ v.T)
    s[np.arange(600), np.arange(600)] = -np.inf
    assert np.array_equal(best.row.reshape(600, 8), np.lexsort((np.tile(np.arange(5000), (600, 1)), -s))[:, :8])


def _joined(frame):
    """The most rows that a join of an executed plan gave."""

    def walk(p):
        kind = p.getClass().getSimpleName()
        inner = p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan() if kind.endswith("QueryStageExec") else None
        below = [inner] if inner is not None else [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().get("numOutputRows") if "Join" in kind else None
        return max([own.get().value() if own is not None and own.isDefined() else 0, *map(walk, below)])

    return walk(frame._jdf.queryExecution().executedPlan())


def test_families_form_few_pairs(spark):
    from lexmill.operators import lexicon

    rng = random.Random(5)
    members = [(g, i) for g in range(120) for i in rng.sample(range(400), rng.choice((1, 2, 3, 14, 30, 60, 61, 62)))] + [(7, None), (None, 3), (None, 4)]
    got = lexicon.families(spark.createDataFrame(members, "g int, i int"), "g", "i", 60, 12)
    groups = {}
    for g, i in members:
        if g is not None:
            groups.setdefault(g, set()).add(i)
    kin, formed = {}, 0
    for held in groups.values():
        if 1 <= len(held) - 1 <= 60:
            formed += len(held) * (len(held) - 1)
            for a in held - {None}:
                for b in held - {None, a}:
                    kin.setdefault(a, {}).setdefault(b, []).append(len(held) - 1)
    want = {(a, b, n) for a, all_ in kin.items() for n, b in sorted((min(x), b) for b, x in all_.items())[:12]}
    assert {tuple(r) for r in got.collect()} == want
    assert 0 < _joined(got) < formed / 4


def test_q_values_are_found_in_ranges_of_p(spark):
    from lexmill.functions import stats

    rng = random.Random(7)
    ps = [0.0] * 5 + [1.0] * 4 + [round(rng.random() ** 6, rng.choice((3, 12))) for _ in range(400)]
    got = stats.with_bh(spark.createDataFrame([(p, i) for i, p in enumerate(ps)], "p double, i int"), "p", ["i"])
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    want, low = {}, 1.0
    for k in range(len(ps), 0, -1):
        low = min(low, ps[order[k - 1]] * len(ps) / k)
        want[order[k - 1]] = low
    assert {r.i: r.q_value for r in got.collect()} == want
    # a frame from each row to the last is read anew for every row
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_long_line_without_an_end_is_read_once(spark):
    import time

    from lexmill.operators import contexts

    docs = spark.createDataFrame([("en", "One two three four five six."), ("en", "x" * 200_000 + "\nAlso a line of quite some words."), ("en", "No end here, but many words anyway")], "lang string, text string").cache()
    docs.count()
    began = time.perf_counter()
    assert [r.sentence for r in contexts.examples(docs, "lang", 5).orderBy("place").collect()] == ["Also a line of quite some words.", "One two three four five six."]
    assert time.perf_counter() - began < 10


def test_exact_quantiles(spark):
    from lexmill.functions import stats

    rng = random.Random(6)
    values = {"many": [rng.choice((rng.random(), rng.random() * 1e6, -3.0)) for _ in range(3001)], "ties": [1.0] * 500 + [2.0] * 500, "one": [4.5], "two": [1.0, 2.0], None: [0.0, 10.0, 20.0]}
    rows = spark.createDataFrame([(k, x) for k, v in values.items() for x in v] + [("many", None), ("empty", None)], "k string, x double")
    got = stats.exact_quantiles(rows, "k", "x", [0.5, 0.025, 0.975], F.count("*").alias("n"))
    found = {r.k: (r.n, r.p) for r in got.collect()}
    assert found.pop("empty") == (1, None) and found["many"][0] == 3002
    assert {k: [round(x, 9) for x in p] for k, (_, p) in found.items()} == {k: [round(float(x), 9) for x in np.quantile(v, [0.5, 0.025, 0.975])] for k, v in values.items()}


@pytest.mark.parametrize("name", ["snr_bands", "percentile_ci"])
def test_quantiles_of_a_group_are_not_held_in_one_task(spark, name):
    from lexmill.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert " median(" not in plan and " percentile(" not in plan and "percentile_approx(" in plan


def test_training_of_a_large_slice_is_dealt_to_partitions(spark, monkeypatch):
    import pyspark.ml.feature as feature

    from lexmill.operators import drift

    asked, plain = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, rows: asked.append(self.getNumPartitions()) or plain(self, rows))
    lines = spark.createDataFrame([([f"w{(i + j) % 30}" for j in range(10)],) for i in range(60)], "tokens array<string>")
    train = lambda: {r.token: r["count"] for r in drift.train(lines, size=4, min_count=1, epochs=1).collect()}
    small = train()
    monkeypatch.setattr(drift, "WORDS", 200, raising=False)
    assert train() == small == {f"w{i}": 20 for i in range(30)} and asked == [1, 3]
