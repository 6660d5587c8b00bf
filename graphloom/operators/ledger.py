"""Balances on account trees: folds, checkpoints, ceilings, guards and rationing.

Folds aggregate postings to accounts first and only then join the tree paths, so that the
shuffle of the postings is one partial aggregate and the paths meet one row for each account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subtree_fold(postings: DataFrame, paths: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """account and the sums of ``amounts`` over the postings of its subtree. ``paths``: desc, anc."""
    own = postings.groupBy("account").agg(*[F.sum(v).alias(k) for k, v in amounts.items()])
    return own.join(paths, F.col("account") == F.col("desc")).groupBy("anc").agg(*[F.sum(k).alias(k) for k in amounts]).withColumnRenamed("anc", "account")


def stepwise(deltas: DataFrame, keys: list[str], order: list[str], delta: str, start: Column, ceiling: Column, out: str = "after", block: Column | None = None) -> DataFrame:
    """Ordered fold clamped at a ceiling after each step, in window form.

    With S the running sum, the balance is S + least(start, least of (ceiling - S) so far). Where a
    key may hold a large part of all rows, ``block`` numbers ranges of its order: sums and least
    rooms are taken within blocks and then over the blocks of a key, so that no task holds a key.
    Then ``before``, the balance before the step, is given too.
    """
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        summed = deltas.withColumn("_s", F.sum(delta).over(w))
        room = F.min(ceiling - F.col("_s")).over(w)
        return summed.withColumn(out, F.col("_s") + F.least(start, room)).drop("_s")
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto, past = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    parts = deltas.withColumn("_block", block).withColumn("_s", F.sum(delta).over(upto))
    parts = parts.withColumn("_room", F.min(ceiling - F.col("_s")).over(upto)).withColumn("_past", F.min(ceiling - F.col("_s")).over(past))
    blocks = parts.groupBy(*keys, "_block").agg(F.sum(delta).alias("_d"), F.min("_room").alias("_r"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_o", F.coalesce(F.sum("_d").over(earlier), F.lit(0))).withColumn("_m", F.min(F.col("_r") - F.col("_o")).over(earlier))
    carried = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_o", "_m")
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    base = F.col("_o") + F.col("_s")  # least passes over nulls: the first block has no room behind it, its first row none before it
    after = base + F.least(start, F.col("_m"), F.col("_room") - F.col("_o"))
    before = base - F.col(delta) + F.least(start, F.col("_m"), F.col("_past") - F.col("_o"))
    return parts.join(carried, same).withColumn(out, after).withColumn("before", before).select(*deltas.columns, out, "before")


def checkpoints(postings: DataFrame, period: Column) -> DataFrame:
    """account, period, closed: the balance at the end of each period that has postings."""
    per = postings.groupBy("account", period.alias("period")).agg(F.sum("delta").alias("d"))
    return per.select("account", "period", F.sum("d").over(Window.partitionBy("account").orderBy("period")).alias("closed"))


def closing_runs(postings: DataFrame, period: str, head: int) -> DataFrame:
    """account, since, until, closed: the balance at the ends of the periods since..until, up to ``head``, over which an account rests.

    One running window over the periods with postings: a row for each account and period that moved, however
    many periods pass without a posting.
    """
    moved = postings.groupBy("account", period).agg(F.sum("delta").alias("d"))
    w = Window.partitionBy("account").orderBy(period)
    return moved.select("account", F.col(period).alias("since"), F.coalesce(F.lead(period).over(w) - 1, F.lit(head)).alias("until"), F.sum("d").over(w).alias("closed"))


def closings(postings: DataFrame, period: str, head: int) -> DataFrame:
    """account, period, closed: the balance at the end of each period up to ``head`` from an account's first on: accounts times periods."""
    return closing_runs(postings, period, head).select("account", F.explode(F.sequence("since", "until")).alias(period), "closed")


def ration_by_rank(requests: DataFrame, keys: list[str], order: list[Column], wanted: str, available: Column) -> DataFrame:
    """granted: what is left of ``available`` when a request's turn comes, up to what it wants."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(wanted).over(before), F.lit(0))
    return requests.withColumn("granted", F.greatest(F.least(F.col(wanted), available - used), F.lit(0)))


def largest_remainder(requests: DataFrame, keys: list[str], weight: str, total: Column, ties: list[Column]) -> DataFrame:
    """granted: whole shares of ``total`` by weight; what floors leave goes to the largest remainders."""
    w = Window.partitionBy(*keys)
    whole = F.sum(weight).over(w)
    shared = requests.withColumn("_t", whole).withColumn("_x", total * F.col(weight))
    shared = shared.withColumn("_q", F.expr("_x div _t")).withColumn("_r", F.expr("_x % _t"))
    short = total - F.sum("_q").over(w)
    place = F.row_number().over(w.orderBy(F.col("_r").desc(), *ties))
    return shared.withColumn("granted", F.col("_q") + F.when(place <= short, 1).otherwise(0)).drop("_t", "_x", "_q", "_r")


def nested_ration(requests: DataFrame, levels: list[tuple[list[str], Column]], order: list[Column], wanted: str) -> DataFrame:
    """granted: what limits leave of each request, from the narrowest set of requests to the widest.

    ``levels`` are (keys of the set, its limit); each is settled in ``order`` on what the one before
    has left, so that a request is cut to its own limits before it competes. Keys of a wider set
    must be among those of the narrower one: sets that cross have no such order and are refused.
    """
    for (narrow, _), (wide, _) in zip(levels, levels[1:], strict=False):
        if not set(wide) <= set(narrow):
            raise ValueError(f"the sets by {narrow} and {wide} cross")
    claims = requests.withColumn("granted", F.col(wanted))
    for keys, limit in levels:
        claims = ration_by_rank(claims.withColumnRenamed("granted", "_claim"), keys, order, "_claim", limit).drop("_claim")
    return claims


def unmet(requests: DataFrame, keys: list[str], wanted: str, available: Column) -> DataFrame:
    """The requests whose whole share of ``available`` by what they want is less than that, with it as ``part``."""
    total = F.sum(wanted).over(Window.partitionBy(*keys))
    shared = requests.withColumn("_x", available * F.col(wanted)).withColumn("_t", total).withColumn("part", F.expr("_x div _t"))
    return shared.where(F.col("part") < F.col(wanted)).drop("_x", "_t")


def tie_arises(requests: DataFrame, keys: list[str], rank: str, wanted: str, available: str) -> DataFrame:
    """keys, rank, left of the ranks of two requests or more that together want more than is left for them, when some is."""
    own = requests.groupBy(*keys, available, rank).agg(F.count("*").alias("n"), F.sum(wanted).alias("asked"))
    before = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    left = own.withColumn("left", F.col(available) - F.coalesce(F.sum("asked").over(before), F.lit(0)))
    return left.where("n > 1 AND left > 0 AND left < asked").select(*keys, rank, "left")
