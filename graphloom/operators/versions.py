"""Versioned state: compare-and-set batches, patch logs, delta membership and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_and_set(heads: DataFrame, writes: DataFrame) -> DataFrame:
    """Outcome of each write (txn, root, expected): applied, lost or conflict; with the new seq of applied ones.

    One writer wins for each root and expected seq: the least txn. ``heads``: root, seq.
    """
    j = writes.join(heads, "root", "left").withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))
    place = F.row_number().over(Window.partitionBy("root", "expected").orderBy("txn"))
    outcome = F.when(F.col("expected") != F.col("seq"), "conflict").when(place == 1, "applied").otherwise("lost")
    return j.withColumn("outcome", outcome).select("txn", "root", "outcome", F.when(F.col("outcome") == "applied", F.col("seq") + 1).alias("seq"))


def last_event(events: DataFrame, keys: list[str], order: list[str], kind: str, gone: str) -> DataFrame:
    """Keys whose last event is not of the kind ``gone``: patch replay and membership without a sort."""
    return events.groupBy(*keys).agg(F.max_by(kind, F.struct(*order)).alias("_k")).where(F.col("_k") != gone).select(*keys)


def gaps(receipts: DataFrame, key: str, seq: str) -> DataFrame:
    """Keys whose receipts skip numbers between their first and last, with how many are missing."""
    g = receipts.groupBy(key).agg(F.min(seq).alias("low"), F.max(seq).alias("high"), F.count_distinct(seq).alias("n"))
    return g.where("high - low + 1 <> n").select(key, "low", "high", (F.col("high") - F.col("low") + 1 - F.col("n")).alias("missing"))


def replace_rows(rows: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of the keys that the payload names replaced by the payload's."""
    return rows.join(payload.select(*keys).distinct(), keys, "left_anti").select(*payload.columns).unionByName(payload)
