"""Every registered cohort query against its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from mustra.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, tables, sf_dir):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    assert len(set(columns)) == len(columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(repr, tables.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())) == got


def test_guids_of_all_persons(spark, sf_dir):
    assert QUERIES["persons_guid_lookup_all"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["person_id"]
