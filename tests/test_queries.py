import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def values(df):
    names = sorted(df.columns)
    return sorted(map(str, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query_against_sql(spark, con, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    if name not in entry.oracle_sql():
        assert len(got)
        return
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


@pytest.mark.parametrize("name", ["rollup_all_categories", "union_methods", "validate_batch", "validate_cross_notes"])
def test_all_categories_are_looked_for_in_whole_columns(spark, name):
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    if name == "validate_cross_notes":  # forms are tried on distinct words
        lines = plan.split("\n")
        assert max(i for i, x in enumerate(lines) if "RLIKE(word" in x) <= max(i for i, x in enumerate(lines) if "Aggregate [" in x)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_name_patterns_over_documents_against_python(spark):
    import re

    from sievelake.functions.catalog import names

    want = {}
    for p in names():
        found = [m for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect() for m in re.finditer(p.regex, r.text)]
        if found:
            want[p.method] = (len(found), sum(m.start() for m in found), sum(m.end() for m in found))
    assert {r.method: (r.n, r.starts, r.ends) for r in entry.queries()["detect_fullname"](spark, DIR).collect()} == want
