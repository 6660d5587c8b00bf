"""Settlement of postings against a limit of the own account and one that the accounts of a group share.

Accounts settle alone, in parallel, as long as the group's limit lets through all that they settle: the group's
balance then is a running sum. The first posting for which it is too small is where the group begins to bind,
exactly, since until then both ways agree. Only a group's postings from there on are one ordered fold,
which starts from the balances reached; a group whose limit never binds has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import written

from .fold import ordered_fold


def _outcome(take: Column, delta: Column) -> Column:
    return F.when(take == delta, "granted").when(take == 0, "refused").otherwise("rationed")


def _running(rows: DataFrame, group: str, order: str, value: str, block: Column) -> DataFrame:
    """rows with ``before``: the sum of ``value`` over a group's earlier rows, by blocks of the order and then over the blocks."""
    parts = rows.withColumn("_block", block)
    within = F.coalesce(F.sum(value).over(Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.groupBy(group, "_block").agg(F.sum(value).alias("_d"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(group, "_block", F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_base"))
    return parts.withColumn("_within", within).join(carried, [group, "_block"]).withColumn("before", F.col("_base") + F.col("_within")).drop("_block", "_within", "_base")


def settle(postings: DataFrame, own: int, shared: int, block: int = 4096) -> DataFrame:
    """pos, settled, outcome of postings (group, account, pos, delta): a debit takes what its account and its group have, a credit all.

    ``own`` and ``shared`` are the opening balances of an account and of a group. Positions are unique; an account is of
    one group. Nulls in any of the four columns are left out.
    """
    rows = postings.select("group", "account", "pos", "delta").dropna()

    def alone(state: int, row: tuple) -> tuple[int, tuple]:
        group, account, pos, delta = row
        take = delta if delta >= 0 else -min(-delta, max(0, state))
        return state + take, (group, account, pos, delta, take, state + take)

    kinds = dict(postings.dtypes)
    schema = f"group {kinds['group']}, account {kinds['account']}, pos long, delta long, take long, have long"
    single = written(ordered_fold(rows, ["account"], ["pos"], ["group", "account", "pos", "delta"], lambda row: own, alone, schema))
    seen = _running(single, "group", "pos", "take", F.floor(F.col("pos") / block)).withColumn("top", F.col("before") + shared)
    binds = written(seen.where((F.col("take") < 0) & (F.col("top") < -F.col("take"))).groupBy("group").agg(F.min_by(F.struct("pos", "top"), "pos").alias("m")).select("group", F.col("m.pos").alias("since"), F.col("m.top").alias("opening")))
    free = single.join(binds.select("group", "since"), "group", "left").where("since is null or pos < since")
    settled = free.select("pos", F.col("take").alias("settled"), _outcome(F.col("take"), F.col("delta")).alias("outcome"))
    if binds.isEmpty():
        return settled
    # What the fold starts from: each account's balance, and the group's, as rows before the first posting.
    reached = free.where("since is not null").groupBy("group", "account").agg(F.max_by("have", "pos").alias("delta")).select("group", F.lit(0).alias("kind"), "account", F.lit(-1).cast("long").alias("pos"), "delta")
    opening = binds.select("group", F.lit(1).alias("kind"), F.lit(None).cast(kinds["account"]).alias("account"), F.lit(-1).cast("long").alias("pos"), F.col("opening").alias("delta"))
    rest = rows.join(binds, "group").where("pos >= since").select("group", F.lit(2).alias("kind"), "account", "pos", "delta")

    def together(state: tuple[dict, int], row: tuple) -> tuple[tuple, tuple]:
        balances, top = state
        kind, account, pos, delta = row
        if kind < 2:
            if kind == 0:
                balances[account] = delta
            return (balances, delta if kind == 1 else top), (None, None, None)
        have = balances.get(account, own)
        take = delta if delta >= 0 else -min(-delta, max(0, min(have, top)))
        balances[account] = have + take
        return (balances, top + take), (pos, take, "granted" if take == delta else "refused" if take == 0 else "rationed")

    folded = ordered_fold(reached.unionByName(opening).unionByName(rest), ["group"], ["kind", "pos"], ["kind", "account", "pos", "delta"], lambda row: ({}, shared), together, "pos long, settled long, outcome string")
    return settled.unionByName(folded.where("pos is not null"))
