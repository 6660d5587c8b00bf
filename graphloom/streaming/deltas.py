"""A keyed table that a stream updates: a base, and on it a delta for each batch.

A batch reads the newest rows of its own keys, by buckets of a hash of the key, and writes a delta of what it
changes: its cost is its own keys and their buckets, not the table. After every ``EVERY`` batches base and deltas become the next base.
Where a batch's files are follows from its number alone: a batch that is repeated after a crash reads what it
read before, without its own delta, and overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches between two bases, and buckets of the keys.
EVERY, BUCKETS = 8, 32


class Deltas:
    """The table of ``key`` and ``value`` columns in ``folder``; ``start`` is the base before batch 0."""

    def __init__(self, spark: SparkSession, folder: str, start: DataFrame, key: str, every: int = EVERY, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.every, self.buckets = spark, folder, key, every, buckets
        self.columns = start.columns
        self.schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in start.schema] + ["bucket int"])
        self._write(start, f"{folder}/base/{0:012d}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.select(*self.columns).withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _parts(self, batch: int) -> list[str]:
        """The base and the deltas that hold the table before ``batch``, oldest first."""
        base = batch // self.every * self.every
        return [f"{self.folder}/base/{base:012d}", *[f"{self.folder}/delta/{b:012d}" for b in range(base, batch)]]

    def _newest(self, paths: list[str], buckets: list[int] | None = None) -> DataFrame:
        """The newest row of each key in tables, oldest first."""
        parts = [self.spark.read.schema(self.schema).parquet(p).withColumn("_age", F.lit(age)) for age, p in enumerate(paths)]
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(buckets)) for p in parts]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        if len(parts) == 1:
            return found.select(*self.columns)  # a base has a key once
        row = F.max_by(F.struct(*[c for c in self.columns if c != self.key]), "_age").alias("_row")
        return found.groupBy(self.key).agg(row).select(self.key, "_row.*").select(*self.columns)

    def before(self, batch: int, buckets: list[int] | None = None) -> DataFrame:
        """The table as batch ``batch`` finds it; of some buckets only."""
        return self._newest(self._parts(batch), buckets)

    def of(self, batch: int, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` before ``batch``; only their buckets are read."""
        asked = [r[0] for r in keys.select(self.bucket()).distinct().collect()]  # at most the number of buckets
        return self.before(batch, asked).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def put(self, batch: int, rows: DataFrame) -> None:
        """Write what a batch changes, and the next base if one is due."""
        self._write(rows, f"{self.folder}/delta/{batch:012d}")
        if (batch + 1) % self.every == 0:
            self._write(self._newest([*self._parts(batch), f"{self.folder}/delta/{batch:012d}"]), f"{self.folder}/base/{batch + 1:012d}")
