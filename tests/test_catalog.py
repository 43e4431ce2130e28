"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

from lexmill.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert rows
    if name in ORACLE_SQL:
        df = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(df.columns) == names
        assert _plain(rows) == _plain(df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None))


def _tables(spark, path, **frames):
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _same_as_sql(spark, path, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(path):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{path}/{t}/*.parquet'")
    df, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, path)
    names = sorted(got.columns)
    assert sorted(df.columns) == names
    rows = _plain([tuple(r[c] for c in names) for r in got.collect()])
    assert rows and rows == _plain(df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None))
    return rows


def test_collocations_know_every_supplier(spark, tmp_path):
    rows = [(p, s, float(p * 7 + s)) for p in range(40) for s in (3, 399, 400, 401, 999, 12345)]
    path = _tables(spark, tmp_path, lineitem=spark.createDataFrame(rows, "l_partkey bigint, l_suppkey bigint, l_extendedprice double"))
    _same_as_sql(spark, path, "collocations_by_lemma")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["keyness_g2", "keyness_bh"])
def test_words_are_counted_once(spark, name):
    got = QUERIES[name](spark, DATA)
    assert got.collect()
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Generate explode") == 1
