import random

import pytest
from graphloom.streaming import deltas, log
from pyspark.sql import functions as F


def test_newest_rows_by_batch(spark, tmp_path):
    rng = random.Random(2)
    state = {k: 0 for k in range(40)}
    table = deltas.Deltas(spark, str(tmp_path), spark.createDataFrame(list(state.items()), "root long, seq long"), "root", every=3, buckets=4)
    history = [dict(state)]
    for batch in range(7):
        changed = {rng.randrange(60): 10 * batch + 1 for _ in range(5)}
        table.put(batch, spark.createDataFrame(list(changed.items()), "root long, seq long"))
        state |= changed
        history.append(dict(state))
    for batch, want in enumerate(history):
        assert dict(map(tuple, table.before(batch).collect())) == want
    keys = spark.createDataFrame([(3,), (59,), (99,)], "root long")
    assert dict(map(tuple, table.of(7, keys).collect())) == {k: v for k, v in state.items() if k in (3, 59, 99)}


def test_a_batch_writes_its_own_keys_only(spark, tmp_path):
    table = deltas.Deltas(spark, str(tmp_path), spark.range(10_000).select(F.col("id").alias("root"), F.lit(1).cast("long").alias("seq")), "root")
    table.put(0, spark.createDataFrame([(5, 2)], "root long, seq long"))
    assert spark.read.parquet(f"{tmp_path}/delta/{0:012d}").count() == 1
    plan = table.before(1, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1][:80]


@pytest.mark.parametrize("crash_at", [0, 1, 2])
def test_a_crash_between_write_and_mark_changes_nothing(spark, crash_at):
    rows = spark.range(240).select(F.col("id").alias("txn"), (F.col("id") % 7).alias("root"), (F.col("id") % 5).alias("expected"), (F.col("id") % 4).alias("k"))
    heads = spark.createDataFrame([(0, 1), (3, 2)], "root long, seq long")
    stream = log.stream_of_folder(spark, log.split(rows, F.col("k"), 4, 2), 2).select("txn", "root", "expected")
    want = sorted(map(tuple, log.guarded_writes(stream, heads, every=2, buckets=2).collect()), key=repr)
    folder = log.scratch(spark)

    def fault(batch):
        if batch == crash_at:
            raise OSError("crash")

    with pytest.raises(Exception, match="crash"):
        log.guarded_writes(stream, heads, every=2, buckets=2, fault=fault, folder=folder)
    got = sorted(map(tuple, log.guarded_writes(stream, heads, every=2, buckets=2, folder=folder).collect()), key=repr)
    assert got == want and len(got) == 240


def test_parts_need_rows_for_their_files(spark):
    with pytest.raises(ValueError, match="fewer rows"):
        log.split(spark.range(3), F.lit(0), 1, 8)
