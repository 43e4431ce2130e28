"""Look-up, discovery lists, merges, presentation and slices on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import fold_key, fold_native

LEMMAS = [(1, "γη", "noun"), (2, "ζωή", "noun"), (3, "αετός", "noun"), (4, "Αετός", "name"), (5, "λόγος", "noun"), (6, "και", "conj"), (7, "τρέχω", "verb")]


@pytest.fixture(scope="module")
def store(spark):
    lemmas = spark.createDataFrame([(i, w, fold_key(w), p, None, "name" if p == "name" else "content") for i, w, p in LEMMAS], "id bigint, lemma string, normalized_lemma string, pos string, gender string, lemma_class string")
    index = spark.createDataFrame([(i, fold_key(w), w, ["lemma"], 1.0) for i, w, _ in LEMMAS] + [(5, fold_key("λόγου"), "λόγου", ["genitive"], 0.7)], "lemma_id bigint, normalized string, surface string, features array<string>, weight double")
    ranks = spark.createDataFrame([(1, 40), (2, 20), (3, 900), (5, 10)], "lemma_id bigint, rank bigint")
    senses = spark.createDataFrame([(3, 0, "eagle", "en-wiktionary", ["a"]), (3, 1, "kite; eagle", "en-wiktionary", ["Biology"]), (5, 0, "word; reason", "en-wiktionary", ["linguistics", "x"]), (2, 0, "ζωή", "el-wiktionary", [])], "lemma_id bigint, sense_index int, gloss string, source string, tags array<string>")
    return lemmas, index, ranks, senses


def test_a_query_is_looked_up_in_three_passes(spark, store):
    from lexmill.operators import lookup

    lemmas, index, ranks, senses = store
    glosses = lookup.gloss_index(senses, F.transform(F.split("gloss", ";"), lambda x: F.btrim(x)))
    assert {(r.en_term, r.lemma_id, r.weight) for r in glosses.collect()} == {("eagle", 3, 1.0), ("kite", 3, 1.0), ("word", 5, 1.0), ("reason", 5, 0.5)}
    find = lambda q, limit=10: [(r["pass"], r.lemma) for r in lookup.look_up(q, index, glosses, ranks, lemmas, senses, limit).orderBy("pass", "order_key").collect()]
    assert find("αετός") == [(0, "αετός"), (0, "Αετός")] and find("Αετός") == [(0, "Αετός"), (0, "αετός")] and find("αετος")[0] == (0, "αετός")
    assert find("λόγου") == [(0, "λόγος")] and find("logos") == [(1, "λόγος")] and find("zoi") == [(1, "ζωή")] and find("gi") == [(1, "γη")]
    assert find(" Eagle. ") == [(2, "αετός")] and find("nothing here") == []
    for bad in ("", "x" * 121):
        with pytest.raises(ValueError):
            find(bad)
    with pytest.raises(ValueError):
        find("a", 51)
    terms = spark.createDataFrame([("eagle",), ("word",), ("none",)], "en_term string")
    assert {(r.en_term, r.lemma_id) for r in lookup.translated(terms, glosses, ranks, 3).collect()} == {("eagle", 3), ("word", 5)}


def test_latin_readings():
    from lexmill.functions.text import english_key, greeklish_candidates, transliterated  # noqa: F401

    assert transliterated("logos") == "λογοσ" and transliterated("thalassa") == "θαλασσα" and transliterated("Psyxi") == "ψυξι" and transliterated("") == ""
    assert greeklish_candidates("zoi")[0] == transliterated("zoi") and "ζωη" in greeklish_candidates("zoi") and "χαρα" in greeklish_candidates("chara")


def test_counts_of_tokens_are_credited_once_to_each_lemma(spark):
    from lexmill.operators import lookup

    index = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("x", 2), ("y", 3)], "normalized string, lemma_id int")
    counts = spark.createDataFrame([("c", 2001, "x", 1000), ("c", 2001, "other", 1000), ("c", 2002, "y", 0)], "corpus string, year int, token string, count bigint")
    assert {(r.lemma_id, r["count"]) for r in lookup.token_lemmas(counts.where("year = 2001"), index).collect()} == {(1, 1000), (2, 1000)}
    got = {(r.year, r.lemma_id): (r["count"], r.per_million) for r in lookup.lemma_series(counts, index).collect()}
    assert got == {(2001, 1): (1000, 500000.0), (2001, 2): (1000, 500000.0), (2002, 3): (0, 0.0)}


def test_collocates_of_lemmas(spark):
    from lexmill.operators import lookup

    pairs = spark.createDataFrame([("νόμος", "δίκαιο", 5.0), ("Δίκαιο", "νόμος", 9.0), ("νόμος", "νόμου", 8.0), ("νόμος", "και", 7.0), ("νόμος", "ab", 6.0), ("νόμος", "κάτι", 1.0)], "w1 string, w2 string, significance double")
    index = spark.createDataFrame([("νομοσ", 1), ("νομου", 1), ("δικαιο", 2)], "normalized string, lemma_id int")
    got = {(r.lemma_id, r.place): (r.collocate, r.significance, r.collocate_id) for r in lookup.lemma_collocations(pairs, index, fold_native, ["και"]).collect()}
    assert got == {(1, 1): ("Δίκαιο", 9.0, 2), (1, 2): ("κάτι", 1.0, None), (2, 1): ("νόμος", 9.0, 1)}


def test_discovery(spark, store):
    from lexmill.operators import discovery

    lemmas, _, _, senses = store
    assert {r.id for r in discovery.content(lemmas).collect()} == {3, 5, 7}
    none = spark.createDataFrame([], "lemma_id bigint, domain string, source string, score double")
    assert {(r.lemma_id, r.domain, r.source) for r in discovery.lemma_domains(none, senses).collect()} == {(3, "biology", "wiktionary-tag"), (5, "linguistics", "wiktionary-tag")}
    predicted = spark.createDataFrame([(1, "law", "classifier", 0.9), (1, "law", "wiktionary-tag", 1.0), (2, "law", "classifier", 0.5), (3, "cooking", "classifier", 0.9), (4, "music", "classifier", 0.6)], none.schema)
    domains = discovery.lemma_domains(predicted, senses)
    assert {(r.lemma_id, r.domain, r.source) for r in domains.collect()} == {(1, "law", "wiktionary-tag"), (4, "music", "classifier")}
    movers = spark.createDataFrame([(1, "a", 0.5), (4, "b", 0.9), (9, "c", 1.0)], "lemma_id bigint, key string, score double")
    assert {(r.domain, r.field_place, r.place) for r in discovery.by_field(movers, domains).collect()} == {("music", 1, 1), ("law", 2, 1)}
    series = spark.createDataFrame([(x, 2000 + t, 10.0 + (t if x == "up" else -t if x == "down" else t % 2)) for x in ("up", "down", "flat") for t in range(10)] + [("few", 2000 + t, 10.0 * t) for t in range(4)], "lemma string, year int, per_million double")
    got = {r.lemma: (r.side, r.significant) for r in discovery.trends(series, "lemma").collect()}
    assert got == {"up": ("rising", True), "down": ("falling", True)}
    with pytest.raises(ValueError):
        discovery.trends(series, "lemma", least_r2=2)
    drift = spark.createDataFrame([(3, 0.9, 2.5, 2001, 2002), (5, 0.1, None, 2001, 2002), (6, 0.95, 3.0, 2001, 2002), (7, 0.5, 1.0, 2001, 2002)], "lemma_id bigint, drift_score double, change_point_score double, first_year int, last_year int")
    ts = spark.createDataFrame([(i, y, 5.0 if i != 7 else 0.1) for i in (3, 5, 6, 7) for y in (2001, 2002)], "lemma_id bigint, year int, per_million double")
    assert {(r.list, r.place, r.lemma_id) for r in discovery.interesting(drift, ts, lemmas).collect()} == {("drift", 1, 3), ("drift", 2, 5), ("change", 1, 3), ("stable", 1, 5), ("stable", 2, 3)}


def test_merges_by_source(spark):
    from lexmill.operators import merges

    schema = "lemma_id int, ipa string, source string, seq int"
    stored = spark.createDataFrame([(1, "a", "en-wiktionary", 0), (2, "b", "el-wiktionary", 0), (3, "c", "en-wiktionary", 0), (4, "d", "en-wiktionary", 0)], schema)
    new = spark.createDataFrame([(1, "x", "el-wiktionary", 0), (1, "x", "el-wiktionary", 1), (2, "y", "en-wiktionary", 0), (3, "z", "en-wiktionary", 0), (5, "w", "en-wiktionary", 0)], schema)
    after = merges.merged_pronunciations(stored, new)
    assert {(r.lemma_id, r.ipa, r.seq) for r in after.collect()} == {(1, "x", 0), (2, "b", 0), (3, "z", 0), (4, "d", 0), (5, "w", 0)}
    assert merges.would_change(stored, after, ["lemma_id"]).collect()[0].asDict() == {"added": 1, "removed": 0, "changed": 2, "same": 2}
    up = merges.updated(stored, spark.createDataFrame([(1, None, 7), (99, "q", 7)], "lemma_id int, ipa string, seq int"), ["lemma_id"], ["ipa", "seq"])
    assert {(r.lemma_id, r.ipa, r.seq) for r in up.collect()} == {(1, None, 7), (2, "b", 0), (3, "c", 0), (4, "d", 0)}
    tables = merges.targeted({"a": stored, "b": stored}, {"a": new}, "a", merges.merged_pronunciations)
    assert tables["b"] is stored and tables["a"].count() == 5
    with pytest.raises(ValueError):
        merges.targeted({"a": stored}, {}, "a", merges.merged_pronunciations)
    assert merges.split_sources(spark.createDataFrame([("a, b,,",)], "sources string")).head()[0] == ["a", "b"]


def test_wordnet(spark):
    from lexmill.operators import merges

    members = spark.createDataFrame([("s1", "λόγος", "n"), ("s1", "ομιλία", "n"), ("s2", "πράξη", "n"), ("s1", "λόγος", "n")], "synset string, lemma string, pos string")
    rels = spark.createDataFrame([("s1", "hypernym", "s2"), ("s1", "other", "s2")], "src string, rel string, tgt string")
    lemmas = spark.createDataFrame([(1, "λογοσ", "noun"), (2, "πραξη", "noun"), (3, "ομιλια", "verb")], "id int, normalized_lemma string, pos string")
    got = {tuple(r) for r in merges.wordnet_relations(members, rels, lemmas, {"hypernym": "hypernym"}, fold_native).collect()}
    assert got == {(1, "synonym", "ομιλία", None), (1, "hypernym", "πράξη", 2)}


def test_presentation(spark):
    from lexmill.operators import presentation as p

    row = spark.createDataFrame([([" Formal ", "law", "plural", "formal", "no-gloss", None, "transitive"], "Λόγος για τον λόγο, (λόγου)!")], "tags array<string>, s string")
    got = row.select(p.tag_buckets(F.col("tags"), ["formal"], ["law"], ["transitive"]).alias("t"), p.marked(F.col("s"), F.array(F.lit("λογοσ"), F.lit("λογου"))).alias("m"), p.label(F.lit(" LAW "), {"law": "νόμος"}).alias("l"), p.label(F.lit("zz"), {"law": "x"}).alias("r")).head()
    assert (got.t.usage, got.t.domain, got.t.grammar, got.l, got.r) == (["formal"], ["law"], ["transitive"], "νόμος", "zz")
    assert "".join(x.text for x in got.m) == "Λόγος για τον λόγο, (λόγου)!" and [x.text for x in got.m if x.hit] == ["Λόγος", "(λόγου)!"]
    ety = spark.createDataFrame([(1, "grc-att", "a", "inherited", 1), (1, "la", "b", "borrowed", 2), (1, "grc", "c", "inherited", 0)], "id int, lang_code string, term string, relation string, seq int")
    assert [(r.period, r.stage, [t.term for t in r.terms]) for r in p.timeline(ety, "id").orderBy("stage").collect()] == [("ancient", 1, ["c", "a"]), ("loan", 5, ["b"])]
    assert [r.year for r in p.events_between(spark, 2010, 2004).orderBy("year").collect()] == [2004, 2008, 2010] and p.events_between(spark, None, 2010).count() == 0


def test_slices_of_a_corpus(spark):
    from lexmill.operators import diachronic as d

    slices = spark.createDataFrame([("p", 2000, 100), ("p", 2001, 30), ("p", 2002, 50), ("n", 2000, 9), ("n", 2001, 100)], "corpus string, year int, vocabulary int")
    kept = d.dense(slices)
    assert {(r.corpus, r.year) for r in kept.collect()} == {("p", 2000), ("p", 2002), ("n", 2000), ("n", 2001)}
    assert [tuple(r) for r in d.skipped(slices, kept).collect()] == [("p", 2001)]
    assert {tuple(r) for r in d.span(kept).collect()} == {("p", 2000, 2002), ("n", 2000, 2001)}
    pools = spark.createDataFrame([("n", 2011, [2011, 2013]), ("n", 2013, [2013, 2011, 2011]), ("n", 2014, [2014])], "corpus string, year int, members array<int>")
    assert {r.year for r in d.distinct_pools(pools).collect()} == {2011, 2014}
    lines = spark.createDataFrame([(y, f"{y} line {i}") for y, n in ((2010, 5), (2011, 300), (2012, 300)) for i in range(n)], "year int, line string")
    pooled = d.pooled_lines(lines, {2011: [2010, 2011, 2012]}, 300)
    assert {r.year: r["count"] for r in pooled.groupBy("year").count().collect()} == {2010: 5, 2011: 148, 2012: 147}
    split = d.halves(lines.union(lines)).groupBy("half").count().collect()
    assert {r.half for r in split} == {0, 1} and sum(r["count"] for r in split) == 1210 and min(r["count"] for r in split) > 500
    near = spark.createDataFrame([("p", 1, 2000, "a"), ("p", 1, 2005, "b"), ("p", 1, 2009, "c"), ("p", 2, 2003, "z")], "corpus string, lemma_id int, year int, neighbour string")
    assert {(r.lemma_id, r.era, r.neighbour) for r in d.then_and_now(near).collect()} == {(1, "then", "a"), (1, "now", "c"), (2, "then", "z")}
    series = spark.createDataFrame([("p", 1, 2001, 2.0), ("p", 1, 2000, 1.0), ("p", 2, 2000, 1.0)], "corpus string, lemma_id int, year int, per_million double")
    drift = spark.createDataFrame([("p", 1, 0.4)], "corpus string, lemma_id int, drift_score double")
    got = d.word_history([1, 2], series, drift, series, near).collect()
    assert len(got) == 1 and [x.year for x in got[0].series] == [2000, 2001] and [x.era for x in got[0].neighbours] == ["then", "now"]
    assert d.word_history([], series, drift, series, near).count() == 0


def test_era_neighbours(spark):
    from lexmill.operators.diachronic import era_neighbours

    rows = [(2000, "word", [1.0, 0.0], 90), (2000, "near", [0.9, 0.1], 90), (2000, "ab", [1.0, 0.0], 90), (2000, "rare", [1.0, 0.01], 10), (2000, "and", [1.0, 0.0], 90), (2000, "nears", [0.8, 0.2], 90), (2000, "far", [0.0, 1.0], 90)]
    vectors = spark.createDataFrame(rows, "year int, token string, vector array<double>, count int")
    resolve = spark.createDataFrame([("near", 2), ("nears", 2), ("far", 3), ("rare", 4), ("word", 1)], "token string, lemma_id int")
    got = era_neighbours(vectors, [2000], spark.createDataFrame([(1, "word")], "lemma_id int, token string"), resolve, ["and"])
    assert [(r.place, r.neighbour, r.neighbour_id) for r in got.orderBy("place").collect()] == [(1, "near", 2), (2, "far", 3)]


def test_more_statistics():
    from lexmill.functions import stats

    assert stats.steepest_step([(2000, 0), (2001, 0.20), (2002, 0.22), (2003, 0.24), (2004, 0.70)]) [0] == 2004
    assert stats.steepest_step([(2000, 0), (2001, 0.5), (2002, 0.4), (2003, 0.3), (2004, 0.2)]) == (None, 0.0) and stats.steepest_step([(1, 0), (2, 1)]) == (None, None)
    at, p = stats.pettitt_permuted([0.1] * 8 + [0.5] * 8)
    assert at == 7 and p < 0.05 and stats.pettitt_permuted([1, 2, 3]) == (None, 1.0) and stats.pettitt_permuted([0.1, 0.1, 0.9, 0.1, 0.1, 0.1, 0.1, 0.1])[1] > 0.05
    assert round(stats.mean_year({2016: 300, 2017: 300, 2018: 300, 2019: 1000, 2020: 1000}), 2) == 2018.72 and math.isnan(stats.mean_year({}))
    assert stats.cache_key("trends", "p", 20, 0.2500001) == stats.cache_key("trends", "p", 20, 0.25) == "trends:p:20:0.250"


def test_far_tails_and_intervals(spark):
    from lexmill.functions import stats

    rows = spark.createDataFrame([(x,) for x in (0.0, 0.3, 1.0, 3.0, 6.0, 20.0)], "x double").select("x", stats.erfc(F.col("x")).alias("e")).collect()
    assert all(abs(r.e / math.erfc(r.x) - 1) < 2e-7 for r in rows)
    row = spark.createDataFrame([(200.0, 100.0, 1000.0, 1000.0), (2000.0, 1000.0, 10000.0, 10000.0)], "a double, b double, c double, d double").select(stats.log_ratio_spread(*map(F.col, "abcd")).alias("s")).collect()
    assert row[0].s == pytest.approx(1.96 * math.sqrt(1 / 200 + 1 / 100 - 2 / 1000) / math.log(2)) and row[1].s < row[0].s


def test_ranks_without_a_sorted_task(spark):
    from lexmill.operators.frequency import with_rank

    rows = [(w, len(w) % 3 + 1) for w in {f"{a}{b}{c}" for a in "abé" for b in "xyz" for c in ("", "q", "qq", "ω")}]
    got = {r.token: r.rank for r in with_rank(spark.createDataFrame(rows, "token string, count int")).collect()}
    assert got == {w: i + 1 for i, (w, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0].encode())))}


def test_bootstrap_significance(spark):
    import random

    from lexmill.operators import drift

    rng = random.Random(3)
    real = [(i, t, m + rng.gauss(0, 0.02)) for i in range(10) for t, m in (("moved", 0.5), ("still", 0.1))] + [(0, "rare", 0.4)]
    control = [(i, t, 0.1 + rng.gauss(0, 0.02)) for i in range(10) for t in ("moved", "still")]
    schema = "replicate int, token string, drift double"
    observed = spark.createDataFrame([("moved", 0.5)], "token string, drift double")
    got = {r.token: r for r in drift.significance(spark.createDataFrame(real, schema), spark.createDataFrame(control, schema), observed, 10).collect()}
    assert set(got) == {"moved", "still"} and got["moved"].significant and not got["still"].significant and got["moved"].low <= got["moved"].drift <= got["moved"].high
    noise = spark.createDataFrame([(f"t{i}", 0.05 + 0.001 * i) for i in range(20)], "token string, drift double")
    bands = drift.signal(noise.withColumn("drift", F.col("drift") * 2), noise, noise.select("token", F.lit(30).alias("count")), [5, 20, 50]).collect()
    assert [(r.band, r.n) for r in bands] == [(20, 20)] and bands[0].snr == pytest.approx(2.0)
    assert drift.false_positives([[1, 1, 1], [1, 9, 1]], lambda s: 1 if max(s) > 5 else None) == 0.5


def test_bootstrap_drift_runs(spark):
    from lexmill.operators import drift

    words = [[f"w{(i + j) % 12}" for j in range(8)] for i in range(120)]
    first = spark.createDataFrame([(w,) for w in words], "tokens array<string>")
    real, control = drift.bootstrap_drift(first, first, 2, size=8, min_count=1, epochs=1)
    assert {r.replicate for r in real.select("replicate").distinct().collect()} == {0, 1} and control.count() > 0


def test_folders_and_slice_files(spark, tmp_path):
    from lexmill.sources import corpora

    for name, file in (("ell_news_2011_1M", "x-sentences.txt"), ("ell_news_2009_1M", "x-sentences.txt"), ("ell_wikipedia_2016_30K", "y-sentences.txt"), ("ell_news_2012_1M", "x-words.txt"), ("notes", "x-sentences.txt")):
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_text("1\tx\n1\ty\n2\n")
    found = corpora.folders(spark, str(tmp_path))
    assert {(r.corpus, r.year) for r in found.collect()} == {("news", 2011), ("news", 2009), ("wiki", 2016)}
    assert {(r.corpus, tuple(r.years)) for r in corpora.available(found).collect()} == {("news", (2009, 2011)), ("wiki", (2016,))}
    assert corpora.folders(spark, str(tmp_path), "ell_news").count() == corpora.folders(spark, str(tmp_path), "news").count() == 2
    ids = corpora.word_ids(corpora.numbered(spark, f"{tmp_path}/ell_news_2012_1M/x-words.txt"))
    assert [tuple(r) for r in ids.collect()] == [("1", "y")]
    (tmp_path / "s" / "news").mkdir(parents=True)
    (tmp_path / "s" / "news" / "2011.txt").write_text("a b\n\nc\n")
    assert sorted((r.corpus, r.year, tuple(r.tokens)) for r in corpora.slices(spark, f"{tmp_path}/s").collect()) == [("news", 2011, ("a", "b")), ("news", 2011, ("c",))]


def test_store_checks(spark):
    from lexmill.operators import manifest

    predicted = spark.createDataFrame([(1, "classifier", 0.4), (2, "wiktionary-tag", 5.0)], "lemma_id int, source string, score double")
    lemmas = spark.createDataFrame([("νόμος", "νομοσ", "noun", ["νόμος", "νομός"]), ("ποτέ", "ποτε", "adv", ["ποτέ"])], "lemma string, normalized_lemma string, pos string, forms array<string>")
    found = manifest.store_checks(predicted, lemmas)
    assert {r.check: (r.failed, r.detail) for r in found.collect()} == {"classifier_floor": (False, "0"), "lemma_identity": (True, "νομός")}
    builds = spark.createDataFrame([("a", 1, "c", None, None)], manifest.BUILD)
    state = manifest.status(found, builds).head()
    assert (state.ok, state.failed, state.components) == (False, ["lemma_identity"], ["a"])
    assert manifest.fingerprint(lemmas).head() == manifest.fingerprint(lemmas.orderBy("lemma").repartition(3)).head() != manifest.fingerprint(predicted).head()


def test_resolve_with_part_of_speech(spark):
    from lexmill.operators.lexicon import two_tier_resolve

    index = spark.createDataFrame([("νόμος", "νομοσ", "noun", 1), ("νομός", "νομοσ", "noun", 2), ("πότε", "ποτε", "adv", 3), ("ποτε", "ποτε", None, 4)], "surface string, key string, pos string, id int")
    wanted = spark.createDataFrame([("νόμος", "νομοσ", "noun"), ("νομος", "νομοσ", "noun"), ("ποτέ", "ποτε", "adv"), ("ποτέ", "ποτε", None), ("πότε", "ποτε", "verb")], "surface string, key string, pos string")
    got = {(r.surface, r.pos): r.id for r in two_tier_resolve(wanted, index, ["pos"]).collect()}
    assert got == {("νόμος", "noun"): 1, ("νομος", "noun"): None, ("ποτέ", "adv"): 3, ("ποτέ", None): 4, ("πότε", "verb"): None}
