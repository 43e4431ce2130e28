"""The discovery lists: what may be shown, fields of lemmas, movers by field, trends, the overview of what is interesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.stats import with_bh
from lexmill.operators import trends as series_trends
from lexmill.operators.lexicon import first_by

#: Keys that are no news, the content parts of speech and the subject fields.
STOP = (
    "και κι που πως για δεν δε θα να αλλα ομως ενω οτι οταν οπως οσο γιατι επειδη ωστε αρα λοιπον "
    "ειναι ηταν εχει εχουν ειχε καθε καποιος καποια καποιο αυτος αυτη αυτο αυτοι αυτες αυτα εκεινος τους της "
    "των τον την στο στη στον στην στις στους στα απο προς κατα μετα πριν χωρις παρα μεσα εξω πανω "
    "κατω διοτι μηπως ισως πολυ παρα μονο ηδη ακομα ακομη τοτε τωρα εδω εκει οπου καθως παν χαριν"
).split()
CONTENT = ["noun", "adj", "verb"]
FIELDS = "medicine law politics economics computing technology military religion philosophy music sports physics chemistry biology mathematics history linguistics nautical".split()
DOMAIN_GATE, LEAST_LETTERS, LEAST_YEARS = 0.55, 4, 5
GOLD, GUESS = "wiktionary-tag", "classifier"


def may_be_shown(lemma: Column, key: Column) -> Column:
    """Neither a function word nor a name: the key is no stop word and the lemma has no capital in front."""
    return ~key.isin(STOP) & ~F.substring(lemma, 1, 1).rlike(r"^\p{Lu}")


def content(lemmas: DataFrame) -> DataFrame:
    """lemmas(id, lemma, normalized_lemma, pos) of the content classes, of a least length, that may be shown."""
    long_enough = F.length("normalized_lemma") >= LEAST_LETTERS
    return lemmas.where(F.col("pos").isin(CONTENT) & long_enough & may_be_shown(F.col("lemma"), F.col("normalized_lemma")))


def lemma_domains(predicted: DataFrame, senses: DataFrame) -> DataFrame:
    """(lemma_id, domain, source, score) of the fields: gold tags always, the classifier's from the gate on, gold over a guess.

    Without any prediction at all, the tags (array) of senses(lemma_id, tags) that are fields serve.
    """
    fine = predicted.where(F.col("domain").isin(FIELDS) & ((F.col("source") != GUESS) | (F.coalesce("score", F.lit(0.0)) >= DOMAIN_GATE)))
    best = first_by(fine, ["lemma_id", "domain"], F.desc(F.col("source") == GOLD), F.desc("score")).select("lemma_id", "domain", "source", "score")
    own = F.array_distinct(F.array_intersect(F.transform("tags", lambda t: F.lower(t)), F.array(*[F.lit(f) for f in FIELDS])))
    tagged = senses.select("lemma_id", F.explode(own).alias("domain")).distinct().select("lemma_id", "domain", F.lit(GOLD).alias("source"), F.lit(1.0).alias("score"))
    some = predicted.limit(1).agg(F.count("*").alias("n"))
    return best.unionByName(tagged.join(F.broadcast(some), F.col("n") == 0).drop("n"))  # one row


def by_field(movers: DataFrame, domains: DataFrame, per_field: int = 8) -> DataFrame:
    """domain, field_place, place and the movers(lemma_id, key, score, ...) of each field: its best, one for each key; fields by their best mover."""
    joined = first_by(movers.join(domains.select("lemma_id", "domain"), "lemma_id"), ["domain", "key"], F.desc("score"), "lemma_id")
    inside = Window.partitionBy("domain")
    ranked = joined.withColumn("place", F.row_number().over(inside.orderBy(F.desc("score"), "key"))).withColumn("best", F.max("score").over(inside)).where(F.col("place") <= per_field)
    fields = ranked.groupBy("domain").agg(F.max("best").alias("best"))
    order = fields.select("domain", F.dense_rank().over(Window.orderBy(F.desc("best"), "domain")).alias("field_place"))  # a row for each field
    return ranked.drop("best").join(F.broadcast(order), "domain")


def trends(series: DataFrame, key: str, least_mean: float = 1.0, least_r2: float = 0.25, limit: int = 20, alpha: float = 0.05) -> DataFrame:
    """side, key, theil_sen, p_value, q_value and the fit of the steepest rising and falling series(key, year, per_million).

    Only series of at least half the corpus' years, and five, with the mean and R2 wanted are tested;
    the false discovery rate is over those. The gated series alone are fitted.
    """
    if not 0 <= least_r2 <= 1 or not 1 <= limit <= 200:
        raise ValueError("least_r2 is 0 to 1, limit 1 to 200")
    years = series.agg(F.greatest(F.lit(LEAST_YEARS), F.floor(F.count_distinct("year") * 0.5)).alias("least_years"))
    gated = series_trends.ols_gate(series, key, LEAST_YEARS, least_mean, least_r2).join(F.broadcast(years), F.col("n") >= F.col("least_years")).drop("least_years")  # one row
    mine = series.join(gated.select(key), key, "left_semi")
    tested = gated.join(series_trends.mann_kendall(mine, key).select(key, "tau", "p_value"), key).join(series_trends.pairwise(mine, key).select(key, "theil_sen"), key)
    fdr = with_bh(tested, "p_value", [key]).withColumn("significant", F.col("q_value") <= alpha)
    side = lambda name, order, sign: fdr.where(sign).orderBy(order, key).limit(limit).withColumn("side", F.lit(name))
    return side("rising", F.desc("theil_sen"), F.col("theil_sen") > 0).unionByName(side("falling", F.asc("theil_sen"), F.col("theil_sen") < 0))


def overview(series: DataFrame, drift: DataFrame) -> DataFrame:
    """corpus with its years, lemmas, rows and measured drifts, for each corpus of series(corpus, year, lemma_id) and drift(corpus, lemma_id)."""
    a = series.groupBy("corpus").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("lemma_id").alias("n_lemmas"), F.count("*").alias("n_rows"))
    b = drift.groupBy("corpus").agg(F.count("*").alias("n_drift"))
    return a.join(b, "corpus", "full").withColumn("n_drift", F.coalesce("n_drift", F.lit(0)))


def interesting(drift: DataFrame, series: DataFrame, lemmas: DataFrame, limit: int = 25, least: float = 1.0) -> DataFrame:
    """list, place and the lemmas of three lists: the largest drift, the clearest change points and the most stable, of what may be shown and is frequent enough in its anchor years.

    drift(lemma_id, drift_score, change_point_score, first_year, last_year), series(lemma_id, year, per_million).
    """
    at = lambda year: series.where(F.col("per_million") >= least).select("lemma_id", F.col("year").alias(year))
    gated = drift.join(at("first_year"), ["lemma_id", "first_year"]).join(at("last_year"), ["lemma_id", "last_year"])
    named = gated.join(content(lemmas).select(F.col("id").alias("lemma_id"), "lemma", "normalized_lemma"), "lemma_id")
    once = first_by(named, ["normalized_lemma"], F.desc("drift_score"), "lemma_id")

    def ranked(name: str, rows: DataFrame, *order: Column) -> DataFrame:
        top = rows.orderBy(*order, "lemma_id").limit(limit)
        place = F.row_number().over(Window.orderBy(*order, "lemma_id"))
        return top.select(F.lit(name).alias("list"), place.alias("place"), "lemma_id", "lemma", "drift_score", "change_point_score")

    sudden = once.where("change_point_score is not null")
    return ranked("drift", once, F.desc("drift_score")).unionByName(ranked("change", sudden, F.desc("change_point_score"))).unionByName(ranked("stable", once, F.asc("drift_score")))
