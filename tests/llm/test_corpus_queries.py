"""The registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

import os

import pytest

from sievelake.llm import oracles, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def values(df):
    names = sorted(df.columns)
    return sorted(map(str, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))


def test_all_ten_are_there():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, want = queries.queries()[name](spark, DIR).toPandas(), con.sql(getattr(oracles, name)).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in c.STAGES:
        docs = c.materialise(stage(spark, docs, DIR), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert c.run(spark, DIR).count() == docs.count()
    empty = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    for name, stage in c.STAGES:
        empty = c.materialise(stage(spark, empty, DIR), f"empty-{name}")
        assert empty.count() == 0
