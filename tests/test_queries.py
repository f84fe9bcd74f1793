"""Registered queries against their SQL on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"}
    assert without == {"bow_regression", "bow_regression_by_source", "count_vectors", "word2vec_vectors", "word2vec_synonyms"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = ordered([tuple(r) for r in df.select(*columns).collect()])
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = ordered([tuple(row[names.index(c)] for c in columns) for row in found.fetchall()])
    assert got and got == expected


@pytest.mark.parametrize("name", ["bow_regression", "bow_regression_by_source", "count_vectors", "word2vec_vectors", "word2vec_synonyms"])
def test_model_queries(spark, name):
    rows = entry.queries()[name](spark, SF_DIR).collect()
    assert rows
    if name.startswith("bow_regression"):
        assert all(math.isfinite(r.coef) for r in rows)


def test_entry(spark):
    report = entry.entry(spark)
    assert report.columns == [
        "rank", "feature", "representative", "n_reviews", "n_ngrams", "modifier", "n_windows", "n_modifier_reviews", "coef",
    ]
    assert report.count() > 0
