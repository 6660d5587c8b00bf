"""Every query with an oracle gives what DuckDB gives on the same tables."""

import datetime
import decimal
import math

import __spark_entry__
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op"))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[k]) for k in order] for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, duck, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert not any("HUGEINT" in str(k) for k in want.types)
    found = rows(got.columns, got.collect())
    assert found == rows(want.columns, want.fetchall())


#: Queries that SQL can't express: each is held against a brute-force version in a test of its own.
WITHOUT_SQL = {"cluster_leiden", "vec_nearest"}


def test_every_query_has_an_oracle_or_is_listed():
    without = {k for k in __spark_entry__.queries() if k not in __spark_entry__.oracle_sql() and not k.startswith("op") and k != "pipeline"}
    assert without == WITHOUT_SQL


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
