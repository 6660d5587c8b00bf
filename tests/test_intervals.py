import datetime as dt
import random

import pytest
from graphloom.operators import ledger, relational
from graphloom.sources.tables import Tables
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1)


def windows(n, keys, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(300)
        e = rng.choice([s + rng.randrange(-2, 40), s, s + 300, None])
        rows.append((rng.choice(keys), i, DAY + dt.timedelta(hours=s) if i % 29 else None, None if e is None else DAY + dt.timedelta(hours=e)))
    return rows


def brute(rows):
    far = dt.datetime.max
    return sorted((k, a, b) for k, a, s, e in rows for k2, b, s2, e2 in rows if k is not None and k == k2 and a < b and s and s2 and s < (e2 or far) and s2 < (e or far))


@pytest.mark.parametrize("limit", [0, 10_000])
def test_overlaps_against_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(relational, "CANDIDATES", limit)
    monkeypatch.setattr(relational, "_RUN", 5)
    rows = windows(220, ["x", "x", "y", "z", None], 3)
    df = spark.createDataFrame(rows, "k string, id long, s timestamp, e timestamp")
    got = sorted(map(tuple, relational.overlapping(df, ["k"], "s", "e", "id").collect()))
    assert got == brute(rows) and len(got) > 1000
    assert relational.overlapping(df.limit(0), ["k"], "s", "e", "id").count() == 0


def test_a_hot_key_costs_its_pairs(spark):
    """20,000 windows of one key that meet their next ones only: all pairs would be 200 million."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), "id", F.timestamp_seconds(F.col("id") * 10).alias("s"), F.timestamp_seconds(F.col("id") * 10 + 25).alias("e"))
    found = relational.overlapping(df, ["k"], "s", "e", "id")
    assert found.count() == 2 * 20_000 - 3
    assert found.where("b - a > 2").count() == 0


def test_closings_are_carried(spark):
    posted = spark.createDataFrame([("a", 0, 5), ("a", 0, 1), ("a", 3, -2), ("b", 2, 7)], "account string, k long, delta long")
    got = sorted(map(tuple, ledger.closings(posted, "k", 4).collect()))
    assert got == [("a", 0, 6), ("a", 1, 6), ("a", 2, 6), ("a", 3, 4), ("a", 4, 4), ("b", 2, 7), ("b", 3, 7), ("b", 4, 7)]


def test_stored_tables_follow_their_files(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    spark.range(3).write.parquet(f"{tmp_path}/orders.parquet")
    first = t.stored("copy", lambda: t.orders, of=("orders",))
    assert t.stored("copy", lambda: t.orders, of=("orders",)) == first
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    second = t.stored("copy", lambda: t.orders, of=("orders",))
    assert second != first and spark.read.parquet(second).count() == 5
