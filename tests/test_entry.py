import __spark_entry__ as entry
import duckdb
import pytest
from workload import queries as workload

TABLES = ["documents", "embeddings", "labels", "conversations"]
# The others share their plans with one of these.
SHORT = ["section_changes", "link_lookback", "taxonomy_text", "parse_mixed", "published_csv"]


def test_every_query_of_the_workload_has_its_sql():
    assert set(workload.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SHORT)
def test_against_sql(spark, testdata, name):
    found = entry.queries()[name](spark, testdata)
    columns = sorted(found.columns)
    with duckdb.connect() as connection:
        for table in TABLES:
            connection.execute(f"CREATE VIEW {table} AS FROM '{testdata}/{table}.parquet'")
        expected = connection.sql(entry.oracle_sql()[name])
        assert sorted(expected.columns) == columns
        rows = expected.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, rows))


def test_partial_pages_against_sql(spark, testdata):
    test_against_sql(spark, testdata, "partial_pages")


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
