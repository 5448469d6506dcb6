"""Each registered query that has SQL gives the rows that the SQL gives on the smallest sample data."""

import os

import duckdb
import pytest

from helixframe.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value) if isinstance(value, bool) else f"{float(value):.9g}" if isinstance(value, int) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted((tuple(map(plain, r)) for r in found.select(columns).collect()), key=str)
    if name in registry.ORACLES:
        relation = sql.sql(registry.ORACLES[name])
        assert sorted(relation.columns) == columns
        want = sorted((tuple(map(plain, r)) for r in relation.select(*(f'"{c}"' for c in columns)).fetchall()), key=str)
        assert rows == want


def test_near_duplicate_pairs_has_a_row_for_each_text(spark, tmp_path):
    from helixframe.plans import cohort_queries

    rows = [(1, "abcdefghijklmnopqrstuvwxyz" * 3), (2, "abcdefghijklmnopqrstuvwxyz" * 3), (3, "short"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = cohort_queries.near_duplicate_pairs(spark, str(tmp_path))
    assert sorted(map(tuple, found.select("frag", "class_id", "representative", "links").collect())) == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 3, 0), (4, 4, 4, 0), (5, 5, 5, 0)]
