from pyspark.sql import functions as F

from lexmill.operators import store


def _lemmas(spark):
    rows = [(1, "νόμος", "νομοσ", "noun", "masculine"), (2, "νομός", "νομοσ", "noun", "masculine"), (3, "Άννα", "αννα", "name", None), (4, "Μαρία", "μαρια", None, None)]
    return spark.createDataFrame(rows, "id bigint, lemma string, normalized_lemma string, pos string, gender string")


def test_word(spark):
    senses = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "lemma_id bigint, sense_index int, gloss string")
    frequency = spark.createDataFrame([(2, 10, 4.0, 4)], "lemma_id bigint, rank int, zipf double, band int")
    got = store.word(_lemmas(spark), "νομοσ", frequency, {"senses": (senses, ["sense_index"])}).orderBy("place").collect()
    assert [(r.id, r.entries_total, r.entries_truncated) for r in got] == [(2, 2, False), (1, 2, False)]
    assert [s.gloss for s in got[1].senses] == ["a", "b"]
    none = store.word(_lemmas(spark), "αννα", frequency, {"senses": (senses, ["sense_index"])}).first()
    assert none.senses == []


def test_search_stops_at_the_last_content_row(spark):
    senses = spark.createDataFrame([(1, 0, "law"), (3, 0, "given name"), (4, 0, "given name")], "lemma_id bigint, sense_index int, gloss string")
    lemmas = store.lemma_classes(senses, ["given name"], _lemmas(spark)).cache()
    assert {r.id: r.lemma_class for r in lemmas.collect()} == {1: "content", 2: "content", 3: "name", 4: "name"}
    assert store.stats(lemmas).first()[:] == (2, 2, 4)
    hits = [(1, 1, (0, 5)), (1, 3, (0, 6)), (1, 2, (1, 7)), (2, 1, (0, 0)), (2, 4, (0, 1))]
    passes = spark.createDataFrame([(p, i, k, "s", ["x", "y"] if i == 1 else []) for p, i, k in hits], "pass int, lemma_id bigint, order_key struct<a:int,b:int>, surface string, features array<string>")
    got = {r.lemma_id: r for r in store.search(passes, lemmas, senses, 2).collect()}
    assert set(got) == {1, 3, 2} and got[1].features == "x, y" and got[2].features is None and got[1].snippet == "law"


def test_graph_and_snapshot(spark, tmp_path):
    edges = spark.createDataFrame([(1, 10, "synonym", "2", 2, 1.0, 0), (1, 11, "synonym", "άλλο", None, 1.0, 0)], "source bigint, edge_id bigint, type string, target string, target_id bigint, weight double, type_rank int")
    etymons = spark.createDataFrame([(1, 0, "grc", "νόμος")], "lemma_id bigint, seq int, lang_code string, term string")
    nodes, links = store.graph(1, _lemmas(spark), edges, etymons)
    assert {(r.id, r.resolved) for r in nodes.collect()} == {("1", True), ("2", True), ("άλλο", False), ("grc:νόμος", False)} and links.count() == 3
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "source_name string, license string")
    new = spark.createDataFrame([("b", "z")], "source_name string, license string")
    assert sorted(map(tuple, store.attributions(old, new).collect())) == [("a", "x"), ("b", "z")]
    for value in (1, 2):
        kept = store.snapshot(spark.range(1).select(F.lit(value).alias("v")), str(tmp_path), "trends", "v1")
    assert kept.first().v == 1


def test_retention_and_report(spark, tmp_path):
    import os
    import time

    one = spark.range(1)
    for i, (key, sig) in enumerate((("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"))):
        store.snapshot(one, str(tmp_path / "kept"), key, sig)
        os.utime(tmp_path / "kept" / f"key={key}" / f"sig={sig}", (time.time() + 10 * i,) * 2)
    assert store.trim_snapshots(spark, str(tmp_path / "kept"), 2) == 2
    assert sorted(str(p.relative_to(tmp_path / "kept")) for p in (tmp_path / "kept").glob("*/*")) == ["key=b/sig=1", "key=c/sig=1"]
    assert store.trim_snapshots(spark, str(tmp_path / "none"), 2) == 0
    assert store.snapshot_key("trends", corpus="x", r2=0.2500001, limit=20) == store.snapshot_key("trends", limit=20, r2=0.25, corpus="x") == "trends-corpus~x-limit~20-r2~0.250"
    for n in (3, 2):
        store.write_report({"rows": spark.range(n)}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "rows")).count() == 2


def test_pooled_vectors(spark):
    from lexmill.operators import drift

    lines = spark.createDataFrame([([f"w{(i + j) % 5}" for j in range(6)], i % 2) for i in range(30)], "tokens array<string>, year int")
    got = drift.pooled_vectors(lines, size=6, epochs=1).collect()
    assert {(r.token, r["count"]) for r in got} == {(f"w{i}", 36) for i in range(5)} and all(len(r.vector) == 6 for r in got)
