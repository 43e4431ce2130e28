"""Named queries over the driver tables, and the SQL each is checked against.

The operators are written for lexicon and corpus tables; here they run on stand-ins: languages and
sources of documents are corpora, parts are lemmas, ship years are years, order and customer keys
are graph nodes, events are the query log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import morphology, stats
from lexmill.operators import calibration, contexts, discovery, domains, drift, frequency, lexicon, lookup, manifest, merges, trends, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_EDGE = tx.EDGE.replace("'", "''")
_WS = r"[ \t\n\r\x0b\x0c]+"
_TOKENS = f"list_filter(list_transform(regexp_split_to_array(replace(lower(coalesce(text, '')), 'ς', 'σ'), '{_WS}'), lambda w: trim(w, '{_EDGE}')), lambda w: w <> '')"
_EXPLODED = f"SELECT doc_id, lang, source, unnest({_TOKENS}) AS token FROM documents"

# --- frequency ---


@query(f"""WITH t AS (SELECT token, count(*) AS c FROM ({_EXPLODED}) GROUP BY token), s AS (SELECT token, c, sum(c) OVER () AS total FROM t),
k AS (SELECT token, c, round(log10(c) - log10(total) + 9, 3) AS z FROM s WHERE c <= 0.005 * total)
SELECT token, CAST(c AS BIGINT) AS count, z AS zipf, CAST(CASE WHEN z >= 5 THEN 5 WHEN z >= 4 THEN 4 WHEN z >= 3 THEN 3 WHEN z >= 2 THEN 2 ELSE 1 END AS INT) AS band, CAST(row_number() OVER (ORDER BY c DESC, token) AS INT) AS rank FROM k""")
def token_frequency_zipf(spark, sf):
    return frequency.ranked_zipf(frequency.token_counts(_t(spark, sf, "documents"))).select("token", "count", "zipf", "band", "rank")


@query(f"""WITH t AS (SELECT token, count(*) AS c FROM ({_EXPLODED}) GROUP BY token), s AS (SELECT token, c, sum(c) OVER () AS total FROM t)
SELECT token, CAST(c AS BIGINT) AS count, round(c / total, 8) AS share FROM s WHERE c > 0.005 * total""")
def frequency_share_cap(spark, sf):
    counts = frequency.with_total(frequency.token_counts(_t(spark, sf, "documents")))
    return counts.where(F.col("count") > frequency.SHARE_CAP * F.col("total")).select("token", "count", F.round(F.col("count") / F.col("total"), 8).alias("share"))


_SERIES = """SELECT corpus, lemma, year, CAST(c AS BIGINT) AS count, round(c / CASE WHEN total = 0 THEN 1 ELSE total END * 1e6, 3) AS per_million FROM (
SELECT p_brand AS corpus, p_type AS lemma, CAST(year(l_shipdate) AS INT) AS year, count(*) AS c, sum(count(*)) OVER (PARTITION BY p_brand, year(l_shipdate)) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, year(l_shipdate))"""
_BY_NAME = "SELECT p_name AS lemma, CAST(year(l_shipdate) AS INT) AS year, count(*) AS c, round(count(*) / sum(count(*)) OVER (PARTITION BY year(l_shipdate)) * 1e6, 3) AS per_million FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name, year(l_shipdate)"


def _facts(spark, sf):
    return _t(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


def _series(spark, sf, lemma="p_name"):
    return frequency.yearly_series(_facts(spark, sf).withColumn("all", F.lit("all")), "all", lemma, F.year("l_shipdate"), F.lit(1)).drop("corpus")


@query(_SERIES)
def frequency_timeseries(spark, sf):
    return frequency.yearly_series(_facts(spark, sf), "p_brand", "p_type", F.year("l_shipdate"), F.lit(1))


@query(f"""WITH s AS ({_SERIES}) SELECT corpus, year, CAST(sum(count) AS BIGINT) AS tokens, count(DISTINCT lemma) AS types, min(year) OVER (PARTITION BY corpus) AS first_year, max(year) OVER (PARTITION BY corpus) AS last_year, count(*) OVER (PARTITION BY corpus) AS n_slices FROM s GROUP BY corpus, year""")
def corpus_overview(spark, sf):
    points = frequency_timeseries(spark, sf).groupBy("corpus", "year").agg(F.sum("count").alias("tokens"), F.count_distinct("lemma").alias("types"))
    w = Window.partitionBy("corpus")
    return points.select("corpus", "year", "tokens", "types", F.min("year").over(w).alias("first_year"), F.max("year").over(w).alias("last_year"), F.count("*").over(w).alias("n_slices"))


# --- trends ---

_OLS = f"""WITH s AS ({_BY_NAME}), g AS (SELECT lemma, count(*) AS n, avg(per_million) AS m, sum(year) AS sx, sum(per_million) AS sy, sum(year * year::DOUBLE) AS sx2, sum(per_million * per_million) AS sy2, sum(year * per_million) AS sxy0 FROM s GROUP BY lemma),
f AS (SELECT lemma, n, m, sx2 - sx * sx::DOUBLE / n AS sxx, sy2 - sy * sy / n AS syy, sxy0 - sx * sy / n AS sxy FROM g)
SELECT lemma, n, round(round(m, 8), 4) AS avg_pm, round(round(sxy / sxx, 7), 4) AS slope_ols, round(sxy * sxy / (sxx * syy), 6) AS r2 FROM f WHERE n >= 5 AND m >= 1 AND sxx > 1e-9 AND syy > 1e-9 AND sxy * sxy / (sxx * syy) >= 0.25"""


@query(_OLS)
def trend_ols_gate(spark, sf):
    return trends.ols_gate(_series(spark, sf), "lemma", 5, 1.0, 0.25)


_PAIRS = f"""WITH s AS ({_BY_NAME}) SELECT a.lemma, round(median((b.per_million - a.per_million) / (b.year - a.year)), 4) AS theil_sen, CAST(sum(sign(b.per_million - a.per_million)) AS BIGINT) AS mk_s FROM s a JOIN s b ON a.lemma = b.lemma AND a.year < b.year GROUP BY a.lemma"""


@query(_PAIRS)
def theil_sen_mann_kendall(spark, sf):
    return trends.pairwise(_series(spark, sf), "lemma")


@query()
def mann_kendall_hamed_rao(spark, sf):
    return trends.mann_kendall(_series(spark, sf), "lemma")


@query()
def trends_bh(spark, sf):
    series = _series(spark, sf)
    return discovery.trends(series, "lemma")


_DAYS = "SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2"


@query(f"""WITH s AS ({_DAYS}), v AS (SELECT a.event_type, a.day, sum(sign(a.n - b.n)) AS v FROM s a JOIN s b ON a.event_type = b.event_type GROUP BY 1, 2),
u AS (SELECT event_type, day, abs(sum(v) OVER (PARTITION BY event_type ORDER BY day)) AS u, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY day) AS place FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY u DESC, place) AS best FROM u WHERE n >= 4 AND place < n)
SELECT event_type, n, CAST(u AS BIGINT) AS k, day AS change_at, round(least(1.0, 2 * exp(-6 * u * u / (n ** 3 + n ** 2))), 6) AS p_value FROM b WHERE best = 1""")
def pettitt_change_point(spark, sf):
    days = _t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return trends.pettitt_change(days, "event_type", "day", "n")


_MOVES = f"""WITH s AS ({_BY_NAME}), d AS (SELECT lemma, min(year) AS first_year, max(year) AS last_year, round(max(per_million) - min(per_million), 3) AS score FROM s GROUP BY lemma)"""


@query(f"""{_MOVES} SELECT d.lemma, d.score, d.first_year, d.last_year FROM d JOIN s a ON a.lemma = d.lemma AND a.year = d.first_year AND a.per_million >= 1000 JOIN s b ON b.lemma = d.lemma AND b.year = d.last_year AND b.per_million >= 1000 ORDER BY d.score DESC, d.lemma LIMIT 30""")
def movers_freq_gated(spark, sf):
    series = _series(spark, sf)
    drift = series.groupBy("lemma").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.round(F.max("per_million") - F.min("per_million"), 3).alias("score"))
    return trends.movers(drift, series, "lemma", 1000.0, 30)


@query("""WITH m AS (SELECT p_type, p_name, max(p_retailprice) AS score FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_name) AS place, max(score) OVER (PARTITION BY p_type) AS best FROM m)
SELECT p_type AS field, p_name AS lemma, score, CAST(place AS INT) AS place, CAST(dense_rank() OVER (ORDER BY best DESC, p_type) AS INT) AS field_place FROM r WHERE place <= 8""")
def by_field_topk(spark, sf):
    part = _t(spark, sf, "part")
    movers = part.select(F.col("p_partkey").alias("lemma_id"), F.col("p_name").alias("key"), F.col("p_retailprice").alias("score"))
    found = discovery.by_field(movers, part.select(F.col("p_partkey").alias("lemma_id"), F.col("p_type").alias("domain")), 8)
    return found.select(F.col("domain").alias("field"), F.col("key").alias("lemma"), "score", "place", "field_place")


@query("""WITH p AS (SELECT o_custkey AS id, o_orderkey, o_orderpriority AS rel, CASE WHEN o_orderstatus = 'F' THEN 'el-wiktionary' ELSE 'en-wiktionary' END AS source, o_orderkey % 2 AS later FROM orders),
held AS (SELECT DISTINCT id FROM p WHERE source = 'el-wiktionary'), best AS (SELECT DISTINCT id FROM p WHERE later = 1 AND source = 'el-wiktionary'),
fill AS (SELECT * FROM p WHERE later = 1 AND source <> 'el-wiktionary' AND id NOT IN (SELECT id FROM held))
SELECT id, o_orderkey, rel, source FROM p WHERE later = 0 AND id NOT IN (SELECT id FROM best) AND NOT (source <> 'el-wiktionary' AND id IN (SELECT id FROM fill)) UNION ALL SELECT id, o_orderkey, rel, source FROM p WHERE later = 1 AND source = 'el-wiktionary' UNION ALL SELECT id, o_orderkey, rel, source FROM fill""")
def merge_by_source(spark, sf):
    source = F.when(F.col("o_orderstatus") == "F", "el-wiktionary").otherwise("en-wiktionary")
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderpriority").alias("rel"), source.alias("source"), (F.col("o_orderkey") % 2).alias("later"))
    side = lambda later: rows.where(F.col("later") == later).drop("later")
    return merges.merged_by_source(side(0), side(1), "id").select("id", "o_orderkey", "rel", "source")


@query("""SELECT term AS en_term, lemma_id, max(weight) AS weight, 'en' AS source FROM (SELECT p_partkey AS lemma_id, p_name AS term, CAST(1 AS DOUBLE) AS weight FROM part UNION ALL SELECT p_partkey, p_type, 0.5 FROM part) GROUP BY 1, 2""")
def gloss_index(spark, sf):
    senses = _t(spark, sf, "part").select(F.col("p_partkey").alias("lemma_id"), F.col("p_size").alias("sense_index"), F.col("p_name").alias("gloss"), F.lit("en").alias("source"), "p_type")
    return lookup.gloss_index(senses, F.array("gloss", "p_type"))


@query(f"""WITH c AS (SELECT lang AS corpus, 2000 + doc_id % 3 AS year, token, count(*) AS n FROM (SELECT lang, doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY 1, 2, 3), t AS (SELECT corpus, year, sum(n) AS total FROM c GROUP BY 1, 2),
i AS (SELECT DISTINCT lower(p_name) AS token, p_size AS lemma_id FROM part UNION SELECT * FROM (VALUES ('the', 1), ('the', 2), ('de', 3), ('der', 4), ('und', 4)))
SELECT corpus, CAST(year AS INT) AS year, CAST(lemma_id AS INT) AS lemma_id, CAST(sum(n) AS BIGINT) AS count, round(sum(n) / total * 1e6, 3) AS per_million FROM c JOIN i USING (token) JOIN t USING (corpus, year) GROUP BY 1, 2, 3, total""")
def lemma_series(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("year", (2000 + F.col("doc_id") % 3).cast("int")).withColumnRenamed("lang", "corpus")
    index = _t(spark, sf, "part").select(F.lower("p_name").alias("normalized"), F.col("p_size").alias("lemma_id"))
    more = spark.createDataFrame([("the", 1), ("the", 2), ("de", 3), ("der", 4), ("und", 4)], "normalized string, lemma_id int")
    return lookup.lemma_series(frequency.token_counts(docs, ["corpus", "year"]), index.unionByName(more))


@query("""WITH p AS (SELECT l_partkey % 300 AS w1, l_suppkey AS w2, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT w1 AS lemma_id, w2 AS c, max(s) AS s FROM (SELECT w1, w2, s FROM p UNION ALL SELECT w2, w1, s FROM p) WHERE w1 <> w2 GROUP BY 1, 2),
f AS (SELECT *, c // 2 AS target FROM b), g AS (SELECT lemma_id // 2 AS lemma_id, target, c, max(s) AS s FROM f GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY lemma_id, target ORDER BY s DESC, CAST(c + 1000 AS VARCHAR)) AS k FROM g WHERE lemma_id <> target),
r AS (SELECT *, row_number() OVER (PARTITION BY lemma_id ORDER BY s DESC, CAST(c + 1000 AS VARCHAR)) AS place FROM o WHERE k = 1)
SELECT lemma_id, CAST(place AS INT) AS place, CAST(c + 1000 AS VARCHAR) AS collocate, s AS significance, target AS collocate_id FROM r WHERE place <= 12""")
def collocations_by_lemma(spark, sf):
    word = lambda c: (c + 1000).cast("string")
    lines = _t(spark, sf, "lineitem").select((F.col("l_partkey") % 300).alias("a"), F.col("l_suppkey").alias("b"), "l_extendedprice")
    pairs = lines.groupBy(word(F.col("a")).alias("w1"), word(F.col("b")).alias("w2")).agg(F.max("l_extendedprice").alias("significance"))
    ids = lines.select(F.col("a").alias("id")).union(lines.select("b")).distinct()  # every key that occurs has its lemma
    index = ids.select(word(F.col("id")).alias("normalized"), F.floor(F.col("id") / 2).alias("lemma_id"))
    return lookup.lemma_collocations(pairs, index, lambda c: c, ["none"])


# --- keyness ---

_ERFC = "t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"
_KEY = f"""WITH n AS (SELECT token, CAST(count(*) FILTER (lang = 'en') AS DOUBLE) AS a, CAST(count(*) FILTER (lang = 'fr') AS DOUBLE) AS b FROM ({_EXPLODED}) WHERE lang IN ('en', 'fr') GROUP BY token),
w AS (SELECT *, sum(a) OVER () AS c, sum(b) OVER () AS d FROM n), e AS (SELECT *, (a + b) / (c + d) AS s FROM w WHERE a + b >= 20),
g AS (SELECT token, a, b, round(2 * (CASE WHEN a > 0 THEN a * ln(a / (c * s)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / (d * s)) ELSE 0 END), 6) AS g2,
round(CASE WHEN a > 0 AND b > 0 THEN log2((a / c) / (b / d)) ELSE 0 END, 6) AS log_ratio, round(CASE WHEN a > 0 AND b > 0 THEN 1.96 * sqrt(1 / a + 1 / b - 1 / c - 1 / d) / ln(2.0) ELSE 0 END, 6) AS ci FROM e),
x AS (SELECT *, sqrt(greatest(g2, 0) / 2) AS x FROM g), t AS (SELECT *, 1 / (1 + x / 2) AS t FROM x), p AS (SELECT *, round({_ERFC}, 12) AS p_value FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, token) AS k, count(*) OVER () AS m FROM p), q AS (SELECT *, round(least(min(p_value * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 10) AS q_value FROM r)"""
_KEY_COLUMNS = "token, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, g2, log_ratio, ci, p_value, q_value"


@query(f"{_KEY} SELECT {_KEY_COLUMNS} FROM q")
def keyness_g2(spark, sf):
    return _keyness(frequency.token_counts(_t(spark, sf, "documents"), ["lang"]))


def _keyness(counts):
    return frequency.keyness(counts, "lang", "en", "fr", 20).select("token", "a", "b", "g2", "log_ratio", "ci", "p_value", "q_value")


@query(f"""{_KEY}, dc AS (SELECT lang, source, token, count(*) AS k FROM ({_EXPLODED}) WHERE lang IN ('en', 'fr') GROUP BY 1, 2, 3), ds AS (SELECT lang, source, sum(k) / sum(sum(k)) OVER (PARTITION BY lang) AS share FROM dc GROUP BY 1, 2),
dt AS (SELECT lang, token, sum(k) AS total FROM dc GROUP BY 1, 2), dp AS (SELECT lang, token, round(sum(abs(coalesce(k, 0) / total - share)) / 2, 6) AS dp FROM dt JOIN ds USING (lang) LEFT JOIN dc USING (lang, source, token) GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN log_ratio > 0 THEN 'en' WHEN log_ratio < 0 THEN 'fr' END AS side FROM q WHERE q_value <= 0.05), k2 AS (SELECT s.*, dp, row_number() OVER (PARTITION BY side ORDER BY abs(log_ratio) DESC, token) AS place FROM s JOIN dp USING (token) WHERE side = lang AND dp <= 0.8)
SELECT {_KEY_COLUMNS}, side, dp, CAST(place AS INT) AS place FROM k2 WHERE place <= 30""")
def keyness_bh(spark, sf):
    docs = _t(spark, sf, "documents").where(F.col("lang").isNotNull() & F.col("lang").isin("en", "fr"))  # as the joins add it, so that the plans agree
    counts = frequency.token_counts(docs, ["lang", "source"])  # the words are counted once for both
    return frequency.distinctive(_keyness(counts), frequency.dispersion_of(counts, "lang", "source"), "en", "fr", "lang")


@query(f"""WITH c AS (SELECT source, token, count(*) AS n FROM ({_EXPLODED}) GROUP BY 1, 2), s AS (SELECT source, sum(n) AS size FROM c GROUP BY 1), w AS (SELECT source, size / sum(size) OVER () AS share FROM s),
t AS (SELECT token, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) >= 80), g AS (SELECT t.token, t.total, w.share, coalesce(c.n, 0) / t.total AS v FROM t CROSS JOIN w LEFT JOIN c ON c.token = t.token AND c.source = w.source)
SELECT token, CAST(max(total) AS BIGINT) AS count, round(sum(abs(v - share)) / 2, 6) AS dp FROM g GROUP BY token""")
def dispersion_dp(spark, sf):
    return frequency.dispersion(_t(spark, sf, "documents"), "source", 80)


@query(f"""WITH c AS (SELECT lang, token, count(*) AS n FROM ({_EXPLODED}) WHERE lang IN ('en', 'fr') GROUP BY 1, 2), p AS (SELECT lang, token, n, (row_number() OVER (PARTITION BY lang ORDER BY n, token) - 1) / greatest(count(*) OVER (PARTITION BY lang) - 1, 1) AS pct FROM c)
SELECT a.token, round(a.pct, 6) AS pct_en, round(b.pct, 6) AS pct_fr FROM p a JOIN p b ON a.token = b.token AND a.lang = 'en' AND b.lang = 'fr' ORDER BY a.pct + b.pct DESC, a.token LIMIT 160""")
def drift_rank_pairs(spark, sf):
    counts = frequency.token_counts(_t(spark, sf, "documents").where(F.col("lang").isin("en", "fr")), ["lang"])
    w = Window.partitionBy("lang")
    pct = (F.row_number().over(w.orderBy("count", "token")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    ranked = counts.withColumn("pct", pct)
    side = lambda lang: ranked.where(F.col("lang") == lang).select("token", F.col("pct").alias(f"pct_{lang}"))
    top = side("en").join(side("fr"), "token").orderBy(F.desc(F.col("pct_en") + F.col("pct_fr")), "token").limit(160)
    return top.select("token", F.round("pct_en", 6).alias("pct_en"), F.round("pct_fr", 6).alias("pct_fr"))


# --- vectors ---

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(f"""WITH s AS (SELECT a.vec_id, b.vec_id AS neighbor, round({_DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor) AS place FROM s)
SELECT vec_id, neighbor, score, CAST(place AS INT) AS place FROM r WHERE place <= 8""")
def embedding_neighbors_topk(spark, sf):
    v = _t(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return vectors.exact_neighbours(v, v, 8)


@query(f"""WITH k AS (SELECT unnest([1, 2]) AS era), s AS (SELECT era, a.vec_id, b.vec_id AS neighbor, round({_DOT}, 6) AS score FROM k JOIN embeddings a ON true JOIN embeddings b ON a.vec_id <> b.vec_id AND b.vec_id % 2 = era - 1), r AS (SELECT *, row_number() OVER (PARTITION BY era, vec_id ORDER BY score DESC, neighbor) AS place FROM s),
l AS (SELECT vec_id, list(neighbor // 2) FILTER (era = 1) AS x, list(neighbor // 2) FILTER (era = 2) AS y FROM r WHERE place <= 15 GROUP BY vec_id)
SELECT vec_id, round(1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS change FROM l""")
def neighbor_overlap(spark, sf):
    v = _t(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    eras = [vectors.exact_neighbours(v, v.where(F.col("vec_id") % 2 == e), 15) for e in (0, 1)]
    sets = [e.groupBy("vec_id").agg(F.collect_set(F.floor(F.col("neighbor") / 2)).alias(n)) for e, n in zip(eras, "xy")]
    return sets[0].join(sets[1], "vec_id").select("vec_id", F.round(1 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("change"))


@query("""WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY 1, 2)
SELECT a.label AS first_label, b.label AS last_label, round(1 - sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 6) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def centroid_drift(spark, sf):
    return vectors.centroid_distances(_t(spark, sf, "embeddings"), "label", "embedding")


# --- contexts ---


@query(f"""WITH t AS (SELECT conv_id, turn, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) AS i FROM conversations), c AS (SELECT token, count(*) AS n FROM t GROUP BY 1), s AS (SELECT sum(n) AS total FROM c),
p AS (SELECT a.token AS word, b.token AS collocate, count(*) AS n FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i = a.i + 1 WHERE a.token <> b.token GROUP BY 1, 2 HAVING count(*) >= 3),
g AS (SELECT word, collocate, p.n, round(p.n * ln(p.n * total / (x.n * y.n::DOUBLE)), 6) AS score FROM p JOIN c x ON x.token = word JOIN c y ON y.token = collocate, s), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, collocate) AS place FROM g)
SELECT word, collocate, n, score, CAST(place AS INT) AS place FROM r WHERE place <= 12""")
def collocations_topk(spark, sf):
    return contexts.collocations(_t(spark, sf, "conversations"), 3, 12)


_SENTENCES = r"SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]')) AS raw FROM documents"


@query(rf"""WITH s AS (SELECT DISTINCT lang, trim(raw, E' \t\n\r') AS sentence FROM ({_SENTENCES})), q AS (SELECT lang, sentence, len(regexp_split_to_array(sentence, '\s+')) AS n FROM s),
k AS (SELECT lang, sentence, -abs(n - 14) + CASE WHEN ends_with(sentence, '.') THEN 0.5 ELSE 0 END AS score FROM q WHERE n BETWEEN 6 AND 28 AND regexp_matches(sentence, '^\p{{Lu}}') AND NOT regexp_matches(sentence, 'https?://|www\.|@') AND length(regexp_replace(sentence, '[^0-9]', '', 'g')) <= 0.15 * length(sentence)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, length(sentence), sentence) AS place FROM k) SELECT lang, sentence, CAST(score AS DOUBLE) AS score, CAST(place AS INT) AS place FROM r WHERE place <= 5""")
def kwic_examples(spark, sf):
    return contexts.examples(_t(spark, sf, "documents"), "lang", 5)


@query(r"""SELECT doc_id, trim(regexp_replace(translate(lower(coalesce(text, '')), 'άέήίόύώϊϋΐΰς', 'αεηιουωιυιυσ'), '\s+', ' ', 'g')) AS folded FROM documents""")
def fold_keys(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.fold_native(F.col("text")).alias("folded"))


# --- lexicon ---


@query("""WITH i AS (SELECT p_partkey AS id, p_name AS surface, lower(p_name) AS key, CASE WHEN p_size > 25 THEN 1.0 ELSE 0.7 END AS weight FROM part), r AS (SELECT l_partkey AS id, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey HAVING count(*) >= 25),
q AS (SELECT DISTINCT p_name AS query, lower(p_name) AS key FROM part), h AS (SELECT query, i.id, surface, weight, coalesce(rank, 1e9) AS rank, CAST(query = surface AS INT) AS exact FROM q JOIN i USING (key) LEFT JOIN r ON r.id = i.id),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, rank, weight DESC, id, surface) AS place FROM h) SELECT query, CAST(place AS INT) AS place, id, surface, exact FROM o WHERE place <= 10""")
def search_ranked(spark, sf):
    part = _t(spark, sf, "part")
    index = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("surface"), F.lower("p_name").alias("key"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.7).alias("weight"))
    counts = _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).count().where("count >= 25")
    ranks = counts.select("id", F.row_number().over(Window.orderBy(F.desc("count"), "id")).alias("rank"))
    return lexicon.ranked_search(part.select(F.col("p_name").alias("query"), F.lower("p_name").alias("key")).distinct(), index, ranks, 10)


@query("""SELECT o_orderkey, o_orderstatus, to_json(list({'line': l_linenumber, 'part': l_partkey, 'flag': l_returnflag} ORDER BY l_linenumber, l_partkey, l_returnflag)) AS lines, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def word_entries_nested(spark, sf):
    lines = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")))).alias("all"), F.count("*").alias("n_lines"))
    return _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey").select("o_orderkey", "o_orderstatus", F.to_json("all").alias("lines"), "n_lines")


@query("""WITH e AS (SELECT o_custkey AS source, o_orderkey AS edge_id, o_orderstatus AS type, o_orderpriority AS target, CASE WHEN o_totalprice > 1000 THEN o_orderkey END AS target_id, o_totalprice AS weight, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS type_rank FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY type_rank, (target_id IS NOT NULL) DESC, weight DESC, edge_id) AS place FROM e), d AS (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY place) AS again FROM p WHERE place <= 60)
SELECT source, target, type, weight, CAST(place AS INT) AS place FROM d WHERE again = 1""")
def graph_edges_ranked(spark, sf):
    o = _t(spark, sf, "orders")
    edges = o.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("edge_id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("target"), F.when(F.col("o_totalprice") > 1000, F.col("o_orderkey")).alias("target_id"), F.col("o_totalprice").alias("weight"))
    rank = F.when(F.col("type") == "F", 0).when(F.col("type") == "O", 1).otherwise(2)
    return lexicon.top_edges(edges.withColumn("type_rank", rank), 60)


@query("""WITH s AS (SELECT conv_id, concat(role, ':', turn) AS node, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, lag(concat(role, ':', turn)) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations)
SELECT conv_id, coalesce(f, CAST(conv_id AS VARCHAR)) AS from_node, node AS to_node, CAST(place AS INT) AS place FROM s WHERE place <= 20""")
def lineage_path(spark, sf):
    return lexicon.lineage(_t(spark, sf, "conversations"), "conv_id", "turn", F.concat_ws(":", "role", F.col("turn").cast("string")), 20)


@query("""WITH m AS (SELECT DISTINCT l_partkey AS g, l_suppkey AS i FROM lineitem), z AS (SELECT g, i, count(*) OVER (PARTITION BY g) - 1 AS size FROM m), p AS (SELECT a.i AS item, b.i AS kin, min(a.size) AS group_size FROM z a JOIN z b ON a.g = b.g AND a.i <> b.i WHERE a.size BETWEEN 1 AND 60 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY group_size, kin) AS place FROM p) SELECT item, kin, group_size FROM r WHERE place <= 12""")
def cognate_families(spark, sf):
    return lexicon.families(_t(spark, sf, "lineitem"), "l_partkey", "l_suppkey", 60, 12)


@query("""WITH e AS (SELECT props AS normalized, max(event_id) AS sample, count(*) AS hits FROM events WHERE event_type = 'error' GROUP BY 1), t AS (SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS unresolved FROM events)
SELECT total, unresolved, round(1 - unresolved / total, 4) AS resolution_rate, normalized, sample, hits FROM (SELECT * FROM e ORDER BY hits DESC, normalized LIMIT 50), t""")
def query_insights(spark, sf):
    return contexts.gap_analysis(_t(spark, sf, "events"), F.col("event_type") == "error", "props", "event_id", 50)


@query("""SELECT lang AS corpus FROM documents UNION SELECT event_type FROM events UNION SELECT role FROM conversations""")
def union_corpora(spark, sf):
    parts = [_t(spark, sf, n).select(F.col(c).alias("corpus")) for n, c in (("documents", "lang"), ("events", "event_type"), ("conversations", "role"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("""SELECT p_partkey AS id, p_name AS surface, lower(p_name) AS key, 'lemma' AS surface_type, 1.0 AS rank_weight FROM part UNION ALL SELECT p_partkey, p_brand, lower(p_brand), 'form', 0.7 FROM part""")
def search_index_union(spark, sf):
    part = _t(spark, sf, "part")
    row = lambda c, kind, w: part.select(F.col("p_partkey").alias("id"), F.col(c).alias("surface"), F.lower(c).alias("key"), F.lit(kind).alias("surface_type"), F.lit(w).alias("rank_weight"))
    return row("p_name", "lemma", 1.0).unionByName(row("p_brand", "form", 0.7))


@query("""SELECT p_name, p_type, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS sources, count(*) AS n_rows FROM part GROUP BY 1, 2""")
def upsert_sources(spark, sf):
    return lexicon.upsert_sources(_t(spark, sf, "part").withColumn("source", F.col("p_brand")), ["p_name", "p_type"])


@query("""WITH r AS (SELECT o_custkey AS key, o_orderpriority AS source, o_orderstatus AS value, o_orderkey AS seq FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (source = '1-URGENT') DESC, seq DESC, value) AS place FROM r) SELECT key, source, value FROM k WHERE place = 1""")
def precedence_merge(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))
    return lexicon.precedence_merge(rows, "key", "1-URGENT")


@query("""WITH i AS (SELECT p_name || '/' || p_size AS surface, p_name AS key, p_partkey AS id FROM part), w AS (SELECT DISTINCT p_name || '/' || p_size AS surface, p_name AS key FROM part), x AS (SELECT surface, min(id) AS id FROM i GROUP BY 1), k AS (SELECT key, min(id) AS id FROM i GROUP BY 1 HAVING min(id) = max(id))
SELECT w.surface, w.key, coalesce(x.id, k.id) AS id FROM w LEFT JOIN x ON x.surface = w.surface LEFT JOIN k ON k.key = w.key""")
def two_tier_resolve(spark, sf):
    rows = _t(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_size").alias("surface"), F.col("p_name").alias("key"), F.col("p_partkey").alias("id"))
    return lexicon.two_tier_resolve(rows.select("surface", "key").distinct(), rows)


@query("""SELECT l_orderkey AS lemma_id, CASE WHEN bool_and(l_returnflag = 'N') THEN 'name' ELSE 'content' END AS lemma_class, count(*) AS senses FROM lineitem GROUP BY 1""")
def class_by_every_sense(spark, sf):
    every = F.bool_and(F.col("l_returnflag") == "N")
    return _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("lemma_id")).agg(F.when(every, "name").otherwise("content").alias("lemma_class"), F.count("*").alias("senses"))


@query("""SELECT c.o_custkey, p.o_orderpriority FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND o.o_orderpriority = p.o_orderpriority)""")
def backfill_missing_cells(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    return lexicon.missing_cells(o, o.select("o_custkey").distinct(), o.select("o_orderpriority").distinct(), ["o_custkey", "o_orderpriority"])


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1""")
def paradigm_pivot(spark, sf):
    rows = _t(spark, sf, "orders").withColumn("large", F.col("o_totalprice") > 1000)
    wide = rows.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    flags = rows.groupBy("o_custkey").agg(F.bool_and("large").alias("all_large"))
    return wide.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p")).join(flags, "o_custkey")


_PER_DAY = "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1"


@query(f"""WITH d AS ({_PER_DAY}) SELECT c.day AS centre, CAST(min(m.day) AS DATE) AS first_day, CAST(max(m.day) AS DATE) AS last_day, CAST(sum(m.n) AS BIGINT) AS size FROM d c JOIN d m ON abs(date_diff('day', c.day, m.day)) <= 2 GROUP BY 1""")
def pool_band(spark, sf):
    return contexts.bands(_t(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), 2)


@query(f"""WITH d AS ({_PER_DAY}), w AS (SELECT unnest(range(0, 8)) AS w), b AS (SELECT c.day AS centre, w, sum(m.n) AS size FROM d c CROSS JOIN w JOIN d m ON abs(date_diff('day', c.day, m.day)) <= w GROUP BY 1, 2), t AS (SELECT 4 * avg(n) AS target FROM d)
SELECT centre, CAST(coalesce(min(w) FILTER (size >= target), 7) AS INT) AS width FROM b, t GROUP BY centre""")
def adaptive_band(spark, sf):
    days = _t(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return contexts.adaptive_bands(days, 7, 4.0)


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def props_json(spark, sf):
    return _t(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").getField("k").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


# --- calibration ---

_SCORED = "SELECT doc_id, quality, ((doc_id * 37) % 101) / 100.0::DOUBLE AS s FROM labels"


@query(f"""WITH x AS (SELECT CASE WHEN s >= 0.5 THEN s ELSE 1 - s END AS conf, CAST((CASE WHEN s >= 0.5 THEN 1 ELSE 0 END) = quality AS INT) AS ok FROM ({_SCORED})), b AS (SELECT greatest(ceil(round(conf * 10, 9)), 1) AS bin, conf, ok FROM x),
g AS (SELECT bin, count(*) AS n, avg(conf) AS conf, avg(ok) AS acc FROM b GROUP BY 1) SELECT CAST(bin AS INT) AS bin, n, round(conf, 6) AS confidence, round(acc, 6) AS accuracy, round(sum(n * abs(acc - conf)) OVER () / sum(n) OVER (), 6) AS ece FROM g""")
def calibration_ece(spark, sf):
    return calibration.reliability(calibration.confident(_scored(spark, sf)), 10)


@query(f"SELECT round(avg((s - quality) * (s - quality)), 6) AS brier, count(*) AS n FROM ({_SCORED})")
def brier(spark, sf):
    return _scored(spark, sf).agg(F.round(F.avg((F.col("s") - F.col("quality")) ** 2), 6).alias("brier"), F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS cls, CASE WHEN s >= 0.5 THEN s ELSE 1 - s END AS conf, CAST((CASE WHEN s >= 0.5 THEN 1 ELSE 0 END) = quality AS INT) AS ok, doc_id FROM ({_SCORED})),
r AS (SELECT cls, conf, avg(ok) OVER (PARTITION BY cls ORDER BY conf DESC, doc_id ROWS UNBOUNDED PRECEDING) AS prec, row_number() OVER (PARTITION BY cls ORDER BY conf DESC, doc_id) AS n FROM x), b AS (SELECT cls, max(n) FILTER (prec >= 0.7) AS n FROM r GROUP BY 1)
SELECT CAST(b.cls AS INT) AS cls, CASE WHEN b.n IS NULL THEN 1.01 ELSE greatest(r.conf, 0.3) END AS threshold FROM b LEFT JOIN r ON r.cls = b.cls AND r.n = b.n""")
def class_thresholds(spark, sf):
    return calibration.thresholds(calibration.confident(_scored(spark, sf)), 0.7, 0.3)


def _scored(spark, sf):
    return _t(spark, sf, "labels").select("doc_id", "quality", ((F.col("doc_id") * 37 % 101) / 100.0).cast("double").alias("s"))


@query("""WITH b AS (SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 10 WHEN l_quantity < 40 THEN 20 ELSE 40 END AS low, l_extendedprice / (l_quantity * 1000) AS snr FROM lineitem), g AS (SELECT low, median(snr) AS m, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(low AS INT) AS low, round(m, 6) AS median_snr, n, min(low) FILTER (m >= 1.5) OVER () AS floor FROM g""")
def snr_bands(spark, sf):
    q = F.col("l_quantity")
    low = F.when(q < 10, 0).when(q < 20, 10).when(q < 40, 20).otherwise(40)
    rows = _t(spark, sf, "lineitem").select(low.alias("low"), (F.col("l_extendedprice") / (q * 1000)).alias("snr"))
    bands = stats.exact_quantiles(rows, "low", "snr", [0.5], F.count("*").alias("n")).withColumn("m", F.col("p")[0])
    return bands.select("low", F.round("m", 6).alias("median_snr"), "n", F.min(F.when(F.col("m") >= 1.5, F.col("low"))).over(Window.partitionBy()).alias("floor"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 4) AS low, round(quantile_cont(l_extendedprice, 0.975), 4) AS high, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1 HAVING count(*) >= 2""")
def percentile_ci(spark, sf):
    x = F.col("l_extendedprice")
    both = stats.exact_quantiles(_t(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", [0.025, 0.975], F.stddev_samp(x).alias("sd"), F.count("*").alias("n")).where("n >= 2")
    return both.select("l_returnflag", F.round(F.col("p")[0], 4).alias("low"), F.round(F.col("p")[1], 4).alias("high"), F.round("sd", 4).alias("sd"))


# --- learned and sampled: rows only, tested by their properties ---


@query()
def domain_classifier(spark, sf):
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("domain"), "embedding")
    return domains.classify(rows, "domain", "embedding")


@query()
def word2vec_drift(spark, sf):
    docs = _t(spark, sf, "documents").where("lang = 'en' AND source IN ('src1', 'src2')").select("source", tx.tokens(F.col("text")).alias("tokens"))
    years = {"src1": 2001, "src2": 2009}
    slices = [drift.train(docs.where(F.col("source") == s), size=16, min_count=3, epochs=1).withColumn("corpus", F.lit("en")).withColumn("year", F.lit(y)) for s, y in years.items()]
    return drift.aligned_drift(slices[0].unionByName(slices[1]), 2001, floor=3)


@query()
def bootstrap_share_ci(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", "lang")
    drawn = drift.bootstrap_weights(lines, 40)
    total = F.sum("weight").over(Window.partitionBy("replicate"))
    shares = drawn.groupBy("replicate", "lang").agg(F.sum("weight").alias("weight")).withColumn("share", F.col("weight") / total)
    return drift.percentile_interval(shares, ["lang"], "share", 20)


@query()
def hash_sample(spark, sf):
    return drift.hash_sample(_t(spark, sf, "documents").select("lang", "doc_id"), ["lang"], 10)


@query()
def manifest_checks(spark, sf):
    counts = F.create_map(F.lit("documents"), F.lit(1).cast("bigint"))
    builds = spark.range(1).select(F.lit("corpus").alias("component"), F.lit(manifest.SCHEMA_VERSION).alias("version"), F.lit("").alias("commit"), F.timestamp_seconds(F.lit(0)).alias("run_at"), counts.alias("row_counts"))
    none = spark.range(1).select(F.lit(None).cast("double").alias("drift_ci_lo"), F.lit(None).cast("double").alias("drift_score_boot"))
    return manifest.checks(builds, token_frequency_zipf(spark, sf), none, ["documents", "events"])


@query()
def paradigm_generate(spark, sf):
    words = [(1, "άνθρωπος", "noun", "masculine"), (2, "όνομα", "noun", "neuter"), (3, "καλός", "adj", None), (4, "γράφω", "verb", None), (5, "γάιδαρος", "noun", "masculine")]
    return morphology.paradigms(spark.createDataFrame(words, "id bigint, lemma string, pos string, gender string"))
