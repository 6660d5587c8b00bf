"""Joins and selections that the relational built-ins compose to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank. The order should be total."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def latest_at(df: DataFrame, keys: list[str], order: list[str], at: Column) -> DataFrame:
    """For each key, the last row by ``order`` among those for which ``at`` holds: one partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.where(at).groupBy(*keys).agg(best).select(*keys, "_row.*")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the right row of equal keys that is last at or before them.

    One union and one window over the keys instead of a range join.
    """
    a = left.withColumn("_t", F.col(left_at)).withColumn("_side", F.lit(1))
    b = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


#: Candidates for each row up to which overlapping windows are found by a join on their keys.
CANDIDATES = 64
#: Partners of a window that one task writes out.
_RUN = 4096


def overlapping(df: DataFrame, keys: list[str], start: str, end: str, label: str) -> DataFrame:
    """Pairs a < b (by ``label``, which a row has to itself) of rows of equal keys whose half-open windows overlap; a null end is open.

    Where keys have few rows each (counted first), they are joined by key. Else by ranks: of two windows
    that overlap, one starts within the other. All starts are numbered in the order of keys and time, so that
    a window's partners are a run of numbers, from its own start to the last one before its end. Runs
    are dealt in pieces and joined by number: the cost is rows and pairs, however large a key is.
    """
    far = F.lit("9999-12-31").cast("timestamp")
    rows = df.select(*keys, F.col(label).alias("_l"), F.col(start).cast("timestamp").alias("_s"), F.coalesce(F.col(end).cast("timestamp"), far).alias("_e")).where("_s is not null")
    rows = rows.dropna(subset=keys) if keys else rows
    square = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if (square["nn"] or 0) <= CANDIDATES * (square["n"] or 0):
        b = rows.select(*keys, F.col("_l").alias("_l2"), F.col("_s").alias("_s2"), F.col("_e").alias("_e2"))
        return rows.join(b, keys).where("_l < _l2 AND _s < _e2 AND _s2 < _e").select(*keys, F.col("_l").alias("a"), F.col("_l2").alias("b"))
    return _overlapping_by_rank(rows, keys)


def _overlapping_by_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of ``overlapping`` by runs of numbers; rows: keys, _l, _s, _e."""
    ends = rows.select(*keys, "_l", F.col("_e").alias("_t"), F.lit(0).alias("_kind"))  # before starts of the same time: windows are half-open
    both = ends.unionByName(rows.select(*keys, "_l", F.col("_s").alias("_t"), F.lit(1).alias("_kind")))
    order = [F.col(c) for c in (*keys, "_t", "_kind", "_l")]
    sorted_ = checkpointed(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    offsets, total = [], 0
    for r in sorted(sorted_.groupBy(part.alias("p")).agg(F.sum("_kind").alias("n")).collect()):
        offsets += [F.lit(r["p"]), F.lit(total)]
        total += r["n"]
    base = F.create_map(*offsets)[part] if offsets else F.lit(0)
    within = F.sum("_kind").over(Window.partitionBy(part).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))  # a partition's rows
    ranked = sorted_.withColumn("_n", (base + within).cast("long"))
    own = F.max(F.when(F.col("_kind") == 1, F.col("_n")))
    last = F.max(F.when(F.col("_kind") == 0, F.col("_n")))
    found = ranked.groupBy(*keys, "_l").agg(own.alias("_n"), last.alias("_last"), F.max(F.when(F.col("_kind") == 1, F.col("_t"))).alias("_s"), F.max(F.when(F.col("_kind") == 0, F.col("_t"))).alias("_e"))
    found = checkpointed(found)
    runs = found.where("_last > _n").withColumn("_from", F.explode(F.sequence(F.col("_n") + 1, F.col("_last"), F.lit(_RUN).cast("long"))))
    runs = runs.repartition(F.col("_from"), F.col("_l")).withColumn("_n", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (_RUN - 1), F.col("_last")))))
    other = found.select("_n", F.col("_l").alias("_l2"), F.col("_s").alias("_s2"), F.col("_e").alias("_e2"))
    met = runs.select(*keys, "_n", "_l", "_s", "_e").join(other, "_n").where("_s < _e2 AND _s2 < _e")  # empty windows end before they start
    return met.select(*keys, F.least("_l", "_l2").alias("a"), F.greatest("_l", "_l2").alias("b"))


def divides(pairs: DataFrame, owner: str, item: str, needed: DataFrame) -> DataFrame:
    """Owners that have every item of ``needed`` (column ``item``): relational division by counts."""
    need = needed.select(item).distinct()
    total = need.count()
    return pairs.select(owner, item).distinct().join(need, item).groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") == total).select(owner)


def signed_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with op: ``del`` for those only in old, ``add`` for those only in new."""
    return old.subtract(new).withColumn("op", F.lit("del")).unionByName(new.subtract(old).withColumn("op", F.lit("add")))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in the global order, without a window over all rows in one task.

    Rows are range-partitioned and sorted; a place is the rows of the partitions before, counted
    once, plus the place in the own partition.
    """
    sorted_ = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    counts = sorted((r["p"], r["n"]) for r in sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    base = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return sorted_.withColumn(name, (base + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_m")
