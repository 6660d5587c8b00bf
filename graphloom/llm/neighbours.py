"""Order rows over the whole table and let each partition see the rows next to it.

``ordered_with_edges`` range-partitions a table by explicit key bounds and copies the rows
at each border into the partitions beside it. A partition's rows, read in order, then hold
every row's predecessor and successor in the global order: no global window, one shuffle
of the payload, and no partition depends on how large a group of equal prefixes is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Values of the column ``role``: a row lent by the partition before, an own row, a row lent by the one after.
BEFORE, OWN, AFTER = 0, 1, 2

#: Keys sampled for the bounds, for each partition. They only steer the balance.
KEYS_PER_PARTITION = 40


def _bucket(key: Column, bounds: list, as_column) -> Column:
    """Number of bounds at or below the key: a two-step search over literal arrays."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    all_bounds = F.array(*[as_column(b) for b in bounds])
    coarse = F.array(*[as_column(b) for b in bounds[step - 1 :: step]]) if len(bounds) >= step else None
    skip = F.size(F.filter(coarse, lambda b: b <= key)) * step if coarse is not None else F.lit(0)
    return (skip + F.size(F.filter(F.slice(all_bounds, skip + 1, F.lit(step)), lambda b: b <= key))).cast("int")


def ordered_with_edges(df: DataFrame, key: list[str], ties: list[str], wrap: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` with a column ``role``, range-partitioned and sorted by ``key`` then ``ties``.

    ``key``: non-null columns of types long or string; they decide the partition. Rows with equal
    keys stay together, in the order of ``ties``. With ``wrap``, the first row also follows the last.
    Rows with role BEFORE or AFTER are copies for looking at; only OWN rows are the partition's own.
    ``keys``: the key columns of all rows from a cheaper plan, if df costs much. An empty table
    gives no rows.
    """
    spark = df.sparkSession
    n = max(2, partitions(spark))
    kinds = {c: t for c, t in df.dtypes if c in key}

    def as_column(values) -> Column:
        return F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(key, values, strict=True)])

    keys = (df if keys is None else keys).select(*key)
    total = keys.count()
    sample = keys.sample(min(1.0, KEYS_PER_PARTITION * n / max(total, 1)), seed=7) if total > KEYS_PER_PARTITION * n else keys
    seen = sorted({tuple(r) for r in sample.collect()})
    bounds = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []

    at = F.struct(*[F.col(c) for c in key])
    bucket = _bucket(at, bounds, as_column)
    ends = {r["b"]: (tuple(r["lo"]), tuple(r["hi"])) for r in keys.groupBy(bucket.alias("b")).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).collect()}
    used = sorted(ends)
    own = F.struct(F.col("_b").alias("b"), F.lit(OWN).alias("role"))
    lent = []
    for left, right in zip(used, used[1:], strict=False):
        lent.append((ends[left][1], right, BEFORE))
        lent.append((ends[right][0], left, AFTER))
    if wrap and used:
        lent.append((ends[used[0]][0], used[-1], AFTER))
    if lent:
        # The border rows are found by a map from their key, at most three for a key and partition.
        # A key can be both ends of its partition, so that it holds a list of targets.
        targets: dict = {}
        for k, b, role in lent:
            targets.setdefault(k, []).append((b, role))
        rows = [(*k, b, r) for k, t in targets.items() for b, r in t]
        borders = spark.createDataFrame(rows, ", ".join([f"_k{i} {kinds[c]}" for i, c in enumerate(key)] + ["b int", "role int"]))
        borders = borders.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.collect_list(F.struct("b", "role")).alias("_lent"))
        df = df.join(F.broadcast(borders), [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(key)], "left")  # a few rows a partition
        places = F.when(F.col("_lent").isNull(), F.array(own)).otherwise(F.concat(F.array(own), F.col("_lent")))
    else:
        places = F.array(own)
    columns = [c for c in df.columns if c != "_lent" and not c.startswith("_k")]
    spread = df.withColumn("_b", bucket).select(*columns, F.explode(places).alias("_p")).select(*columns, F.col("_p.b").alias("_b"), F.col("_p.role").alias("role"))
    return spread.repartitionById(n, F.col("_b")).sortWithinPartitions("_b", "role", *key, *ties)
