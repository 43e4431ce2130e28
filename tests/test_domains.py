import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import domains


def test_gold_labels(spark):
    senses = spark.createDataFrame([(1, ["feminine", "medicine", "plural"]), (2, ["law", "medicine"]), (3, None), (4, [])], "lemma_id bigint, tags array<string>")
    gold = domains.gold(senses, ["medicine", "law"])
    assert sorted(map(tuple, gold.collect())) == [(1, "medicine"), (2, "law"), (2, "medicine")]
    assert [tuple(r) for r in domains.single_label(gold).collect()] == [(1, "medicine")]


def test_classifier_learns_and_abstains(spark):
    rng = np.random.default_rng(1)
    centres = {"a": 0, "b": 1, "c": 2}
    rows = [(i, d, (np.eye(4)[centres[d]] * 3 + rng.normal(size=4) * 0.5).tolist()) for i, d in enumerate(rng.choice(list(centres), 240, p=[0.6, 0.3, 0.1]).tolist())]
    rows += [(1000, "a", [1.0, 1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, domain string, v array<double>")
    out = domains.classify(df, "domain", "v").cache()
    told = out.where("predicted is not null")
    assert told.count() > 220 and told.where("predicted = truth").count() > 0.97 * told.count()
    assert 0.15 < out.agg(F.avg(F.col("held_out").cast("int"))).first()[0] < 0.25
    names, scored = domains.probabilities(df, df, "domain", "v")
    fitted = scored.select(domains.calibrated(scored, names, "domain").alias("q")).collect()
    assert all(sum(r.q) == pytest.approx(1) for r in fitted)
    assert domains.class_limits(scored.withColumn("domain", F.lit("other")), names, "domain") == dict.fromkeys(names, 1.01)


def test_search_merges_and_graph(spark):
    from lexmill.operators import lexicon

    index = spark.createDataFrame([("νόμος", "νομοσ", 1), ("νομός", "νομοσ", 2), ("άνθρωπος", "ανθρωποσ", 3)], "surface string, key string, id bigint")
    wanted = spark.createDataFrame([("νόμος", "νομοσ"), ("νομος", "νομοσ"), ("ανθρωπος", "ανθρωποσ")], "surface string, key string")
    assert {r.surface: r.id for r in lexicon.two_tier_resolve(wanted, index).collect()} == {"νόμος": 1, "νομος": None, "ανθρωπος": 3}
    rows = spark.createDataFrame([("a", None, "en"), ("a", None, "el"), ("a", "noun", "el")], "lemma string, pos string, source string")
    assert sorted((r.pos or "", r.sources) for r in lexicon.upsert_sources(rows, ["lemma", "pos"]).collect()) == [("", "el,en"), ("noun", "el")]
    steps = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "id bigint, seq int, node string")
    assert sorted((r.from_node, r.to_node) for r in lexicon.lineage(steps, "id", "seq", F.col("node"), 20).collect()) == [("1", "x"), ("x", "y")]
