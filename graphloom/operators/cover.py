"""Minimal covers: the maximal elements of sets and of places in a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import written

#: Largest sets that are held against all others at once; the part of the sets left from which on it is not done again.
PIVOTS, GOOD = 64, 0.8
#: Parts of an item's list of sets.
SLICES = 32


def topmost(members: DataFrame, paths: DataFrame) -> DataFrame:
    """owner, node of the members that lie below no other member of their owner. ``paths``: desc, anc of a tree.

    Each member meets its own ancestors, once for each level, and not the other members.
    """
    own = members.select("owner", "node").distinct()
    above = own.join(paths.where("desc <> anc"), F.col("node") == F.col("desc")).select("owner", "node", F.col("anc").alias("above"))
    below = above.join(own.select("owner", F.col("node").alias("above")), ["owner", "above"], "left_semi").select("owner", "node").distinct()
    return own.join(below, ["owner", "node"], "left_anti")


def _held(size: str, items: str) -> Column:
    """Whether the set ``items`` is part of the set ``larger`` and less than it."""
    return (F.size("larger") > F.col(size)) & (F.size(F.array_except(items, "larger")) == 0)


def maximal_sets(rows: DataFrame) -> DataFrame:
    """owner, shared of each owner (owner, item rows) whose set no other set holds and exceeds; ``shared``: the least owner of that set.

    Owners of equal sets are one set. The PIVOTS largest sets are held against all others first, then the largest of those
    left, as long as that takes off a good part: what a set that is dropped holds, the larger one holds too. Of the rest, a set that holds another one has
    also its rarest item, so that each is only held against the larger sets in the list of that item, which is the shortest of
    its items' lists; lists are cut into SLICES, so that one of a third of all sets is many tasks.
    """
    items = rows.select("owner", "item").distinct()
    often = items.groupBy("item").agg(F.count("*").alias("n"))
    sets = written(items.join(often, "item").groupBy("owner").agg(F.array_sort(F.collect_set("item")).alias("set"), F.min_by("item", F.struct("n", "item")).alias("rare")))  # one owner's items
    kinds = written(sets.groupBy("set").agg(F.min("owner").alias("shared"), F.min("rare").alias("rare")).withColumn("size", F.size("set")))
    left, top = kinds.count(), None
    while left > PIVOTS:
        pivots = written(kinds.orderBy(F.col("size").desc(), "set").limit(PIVOTS))
        larger = F.broadcast(pivots.select(F.col("set").alias("larger")))  # PIVOTS sets
        best = pivots.join(larger, _held("size", "set"), "left_anti")
        top = best if top is None else top.unionByName(best)
        kinds = written(kinds.join(larger, _held("size", "set") | (F.col("set") == F.col("larger")), "left_anti"))
        before, left = left, kinds.count()
        if left > GOOD * before:
            break
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    lists = kinds.select(F.explode("set").alias("rare"), F.col("set").alias("larger"), F.pmod(F.xxhash64("set"), F.lit(SLICES)).cast("int").alias("slice"))
    held = kinds.withColumn("slice", slices).join(lists, ["rare", "slice"]).where(_held("size", "set")).select("set").distinct()
    kept = kinds.join(held, "set", "left_anti").select("set", "shared")
    return sets.join(kept if top is None else kept.unionByName(top.select("set", "shared")), "set").select("owner", "shared")
