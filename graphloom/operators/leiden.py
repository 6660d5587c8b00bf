"""Communities over levels: local moves, refinement, contraction, until the modularity stops rising.

All nodes move in rounds (see ``_moved``), the best partition of all rounds counts. Refinement then
builds connected parts within each community by contracting edges, the parts become the nodes of the next,
smaller graph, and moves go on there from the communities found so far. So a level never gives less
modularity than the one before, and a community is never cut off from itself: what is left apart at
the end is split into its connected components, which only adds modularity.

Up to ``LIMIT`` nodes a round is one read of packed edges, without a shuffle (see ``leiden_arrays``). Beyond it a round is
an aggregate over the edges of its level and a table written. Levels shrink by a factor, so that the first level's
rounds are most of the cost. Ids of nodes are of any type that has an order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import written

from . import leiden_arrays as arrays
from .community import both_ways
from .graph import components
from .matching import cooccurrence

#: Gains and modularities are compared after rounding, so that the order of a sum decides nothing.
DIGITS = 9
#: Nodes, 20 bytes each, that the driver and each worker hold; the rounds of larger graphs are joins.
LIMIT = 1 << 23


def _coin(name: str, *salt: int) -> Column:
    """0 or 1 by a hash of the column and of numbers."""
    return F.pmod(F.xxhash64(F.col(name), *[F.lit(s) for s in salt]), F.lit(2))


def _moved(near: DataFrame, state: DataFrame, total: float, resolution: float, rounds: int, salt: int, patience: int = 2) -> tuple[DataFrame, float]:
    """(state, modularity) of the best partition met in ``rounds`` rounds of moves from ``state`` (node, k, loops, community).

    In a round the nodes whose coin shows 1 go to the neighbours' community that gains most (the least of
    equals); neighbours that move at once may lose by it, so that the partition of each round is
    weighed. Ends after ``patience`` rounds without a rise, or when no node wants to move.
    """
    best: tuple[float, DataFrame] | None = None
    waited = 0
    for r in range(rounds + 1):
        size = state.groupBy("community").agg(F.sum("k").alias("t"))
        full = state.join(size, "community")  # a row a node: the size goes along with the community, and rows of edges meet it only there
        links = near.join(full.select(F.col("node").alias("other"), "community", "t"), "other").select("node", "community", "t", "weight")
        choices = links.unionByName(full.select("node", "community", "t", F.lit(0.0).alias("weight"))).repartition("node")  # a node has no more rows than there are nodes
        scored = choices.groupBy("node", "community").agg(F.sum("weight").alias("w"), F.max("t").alias("t")).join(state.select("node", "k", "loops", F.col("community").alias("was")), "node")
        stays = F.col("community") == F.col("was")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(stays, F.col("k")).otherwise(0.0)) / total, DIGITS)
        to = F.min_by("community", F.struct((-F.col("gain")).alias("g"), (~F.col("stays")).alias("s"), F.col("community")))
        picked = scored.withColumn("gain", gain).withColumn("stays", stays).groupBy("node", "k", "loops", "was").agg(to.alias("to"), F.max(F.when(F.col("stays"), F.col("w"))).alias("within"))
        picked = written(picked)
        sums = picked.groupBy("was").agg(F.sum(F.col("within") + F.col("loops")).alias("within"), F.sum("k").alias("t"), F.count_if(F.col("to") != F.col("was")).alias("eager"))
        sums = sums.agg(F.sum("within").alias("within"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum("eager").alias("eager")).first()
        quality = round((sums["within"] or 0.0) / total - resolution * (sums["tt"] or 0.0) / (total * total), DIGITS)
        if best is None or quality > best[0]:
            best, waited = (quality, state), 0
        else:
            waited += 1
        if not sums["eager"] or waited >= patience or r == rounds:
            break
        turn = F.lit(1) if sums["eager"] == 1 else _coin("node", salt, r)
        state = picked.select("node", "k", "loops", F.when(turn == 1, F.col("to")).otherwise(F.col("was")).alias("community"))
    return best[1], best[0]


def _parts(near: DataFrame, state: DataFrame, total: float, resolution: float, salt: int, rounds: int = 8) -> DataFrame:
    """node, part: connected parts of communities, grown from single nodes by merges that gain.

    In a round each part whose coin shows 0 joins, along an edge, the part of its community whose coin shows 1
    and where it gains most: two connected sets and an edge between them are one connected set.
    """
    of = state.select("node", "community")
    inside = near.join(of, "node").join(of.select(F.col("node").alias("other"), F.col("community").alias("c2")), "other").where("community = c2").select(F.col("node").alias("a"), F.col("other").alias("b"), "weight")
    parts = written(state.select("node", F.col("node").alias("part"), "k"))
    weights, idle = state.select(F.col("node").alias("part"), "k"), 0
    for r in range(rounds):
        inside = written(inside)
        heavy = weights.select(F.col("part").alias("b"), F.col("k").alias("kb"))
        met = inside.where((_coin("a", salt, r) == 0) & (_coin("b", salt, r) == 1)).join(weights.select(F.col("part").alias("a"), F.col("k").alias("ka")), "a").join(heavy, "b")
        gain = F.round(F.col("weight") - resolution * F.col("ka") * F.col("kb") / total, DIGITS)
        joins = written(met.withColumn("gain", gain).where("gain > 0").groupBy("a").agg(F.min_by("b", F.struct((-F.col("gain")).alias("g"), F.col("b"))).alias("to")))
        if joins.isEmpty():
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0

        def renamed(df: DataFrame, column: str, joins: DataFrame = joins) -> DataFrame:
            return df.join(joins.select(F.col("a").alias(column), "to"), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        parts = written(renamed(parts, "part"))
        weights = parts.groupBy("part").agg(F.sum("k").alias("k"))
        inside = renamed(renamed(inside, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    return parts.select("node", "part")


def _linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Packed edges of a, b, weight by the numbers of their nodes."""
    ids = [nodes.select(F.col("node").alias(c), F.col("id").alias(i)) for c, i in (("a", "u"), ("b", "v"))]
    linked = edges.join(ids[0], "a").join(ids[1], "b").select("u", "v", F.col("weight").cast("double").alias("w"))
    return arrays.of_edges(written(linked.select(F.inline(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))))))


def _by_arrays(near: DataFrame, nodes: DataFrame, n: int, resolution: float, rounds: int, levels: int, salt: int) -> DataFrame:
    """node, community: the same as by tables, with nodes as numbers."""
    linked = arrays.linked(near, n)
    loops = arrays.loops_of(near, n)
    k = arrays.degrees(near, n) + loops
    total = float(k.sum()) or 1.0
    place = np.arange(n)
    state, quality = arrays.moved(near, np.arange(n, dtype=np.int32), k, float(loops.sum()), total, resolution, rounds, salt)
    for level in range(1, levels):
        part = arrays.parts(arrays.inside(near, state), k, total, resolution, salt + 1000 * level)
        kept, group = np.unique(part, return_inverse=True)
        if len(kept) == len(part):
            break
        group = group.astype(np.int32)
        near = arrays.contracted(near, group)
        k = np.bincount(group, weights=k)
        loops = np.bincount(group, weights=loops) + arrays.loops_of(near, len(kept))
        place = group[place]
        state = np.unique(state[kept], return_inverse=True)[1].astype(np.int32)
        state, found = arrays.moved(near, state, k, float(loops.sum()), total, resolution, rounds, salt + 1000 * level)
        if found <= quality:
            break
        quality = found
    whole = arrays.connected(arrays.inside(near, state), len(state))[place]
    least = np.full(len(state), n, np.int32)
    np.minimum.at(least, whole, np.arange(n, dtype=np.int32))
    return arrays.named(nodes, np.where(linked, least[whole], np.int32(-1)))


def leiden(edges: DataFrame, resolution: float = 1.0, rounds: int = 10, levels: int = 8, salt: int = 0) -> DataFrame:
    """node, community (its least node) of undirected edges a, b, weight; equal ends are loops, repeated edges add up.

    ``salt`` picks other coins. Nodes are those of the edges; an empty table gives no rows.
    """
    edges = written(edges.select("a", "b", "weight").where("a is not null AND b is not null"))
    places = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    nodes, n = arrays.numbered(places)
    if n <= LIMIT:
        return _by_arrays(_linked(edges, nodes), nodes, n, resolution, rounds, levels, salt)
    ends = both_ways(edges.where("a <> b")).groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    near = written(ends)
    loops = edges.where("a = b").groupBy(F.col("a").alias("node")).agg((2 * F.sum(F.col("weight").cast("double"))).alias("loops"))
    degree = near.groupBy("node").agg(F.sum("weight").alias("k0")).join(loops, "node", "full")
    zero = F.lit(0.0)
    state = written(degree.select("node", (F.coalesce("k0", zero) + F.coalesce("loops", zero)).alias("k"), F.coalesce("loops", zero).alias("loops"), F.col("node").alias("community")))
    total = state.agg(F.sum("k")).first()[0] or 1.0
    place = state.select("node", F.col("node").alias("at"))
    state, quality = _moved(near, state, total, resolution, rounds, salt)
    for level in range(1, levels):
        parts = written(_parts(near, state, total, resolution, salt + 1000 * level))
        if parts.where("node <> part").isEmpty():
            break
        of = parts.select(F.col("node").alias("other"), F.col("part").alias("p2"))
        linked = written(near.join(parts, "node").join(of, "other").groupBy("part", "p2").agg(F.sum("weight").alias("weight")))
        inner = linked.where("part = p2").select("part", F.col("weight").alias("inner"))
        grown = state.join(parts, "node").groupBy("part").agg(F.sum("k").alias("k"), F.sum("loops").alias("loops"), F.min("community").alias("community"))
        state = written(grown.join(inner, "part", "left").select(F.col("part").alias("node"), "k", (F.col("loops") + F.coalesce("inner", zero)).alias("loops"), "community"))
        near = linked.where("part <> p2").select(F.col("part").alias("node"), F.col("p2").alias("other"), "weight")
        place = written(place.join(parts.select(F.col("node").alias("at"), "part"), "at").select("node", F.col("part").alias("at")))
        state, found = _moved(near, state, total, resolution, rounds, salt + 1000 * level)
        if found <= quality:
            break
        quality = found
    of = state.select("node", "community")
    inside = near.join(of, "node").join(of.select(F.col("node").alias("other"), F.col("community").alias("c2")), "other").where("community = c2").select("node", "other")
    whole = components(inside, "node", "other")
    named = place.join(whole.select(F.col("node").alias("at"), "component"), "at", "left").select("node", F.coalesce("component", "at").alias("c"))
    least = named.groupBy("c").agg(F.min("node").alias("community"))
    return named.join(least, "c").select("node", "community")


def of_sections(sections: DataFrame, resolution: float = 1.0, rounds: int = 10, levels: int = 8, salt: int = 0) -> DataFrame:
    """node, community of the concepts c that are in sections s together, weighted by the overlap coefficient."""
    sections = sections.where("s is not null AND c is not null")
    nodes, n = arrays.numbered(sections.select(F.col("c").alias("node")).distinct())
    if n > LIMIT:
        return leiden(cooccurrence(sections, "s", "c"), resolution, rounds, levels, salt)
    nodes = written(nodes)
    near = arrays.of_sections(sections.join(nodes.withColumnRenamed("node", "c"), "c").select("s", F.col("id").alias("c")), n)
    return _by_arrays(near, nodes, n, resolution, rounds, levels, salt)
