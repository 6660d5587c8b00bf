"""Communities of weighted graphs: local moves, resolution sweep, coverage of templates.

Moves are made in rounds over the whole graph at once; in a round only every second node may move,
so that neighbours do not swap places for ever. Each round is two aggregates and a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import checkpointed, written

from .relational import top_k


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, weight of undirected edges a, b, weight, each seen from both ends."""
    e = edges.select("a", "b", F.col("weight").cast("double").alias("weight"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def local_moves(edges: DataFrame, rounds: int, resolution: float, turn: Callable[[Column], Column]) -> DataFrame:
    """node, community after so many rounds of moves that gain modularity at a resolution.

    Every node begins alone. In round r the nodes whose ``turn`` is r modulo 2 move to the community
    of neighbours where the gain is the largest, to the least one among equals, or stay.
    """
    near = checkpointed(both_ways(edges))
    degree = checkpointed(near.groupBy("node").agg(F.sum("weight").alias("k")))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    state = degree.select("node", "k", F.col("node").alias("community"))
    for r in range(rounds):
        of = state.select(F.col("node").alias("other"), "community")
        links = near.join(of, "other").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        own = state.select("node", "community", F.lit(0.0).alias("w"))  # staying is a choice even without a neighbour there
        choices = links.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w"))
        size = state.groupBy("community").agg(F.sum("k").alias("t"))
        scored = choices.join(size, "community").join(state.select("node", "k", F.col("community").alias("was")), "node")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(F.col("community") == F.col("was"), F.col("k")).otherwise(0.0)) / total, 9)
        best = scored.withColumn("gain", gain).groupBy("node", "k", "was").agg(F.min_by("community", F.struct((-F.col("gain")).alias("g"), F.col("community"))).alias("to"))
        moves = turn(F.col("node")) % 2 == r % 2
        state = checkpointed(best.select("node", "k", F.when(moves, F.col("to")).otherwise(F.col("was")).alias("community")))
    return state.select("node", "community")


def quality(edges: DataFrame, communities: DataFrame, least: int = 2) -> DataFrame:
    """One row: modularity and coverage (share of nodes) of the communities of ``least`` nodes or more."""
    big = communities.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = communities.join(big.select("community"), "community")
    near = both_ways(edges)
    degree = near.groupBy("node").agg(F.sum("weight").alias("k"))
    inside = near.join(kept, "node").join(kept.select(F.col("node").alias("other"), F.col("community").alias("c2")), "other").where("community = c2").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    ends = degree.join(kept, "node").groupBy("community").agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)).alias("kk"))
    whole = degree.agg(F.sum("k").alias("m2"), F.count("*").alias("nodes"))
    members = kept.agg(F.count("*").alias("members"))
    one = whole.crossJoin(inside).crossJoin(ends).crossJoin(members)  # one row each
    return one.select((F.col("inside") / F.col("m2") - F.col("kk") / (F.col("m2") * F.col("m2"))).alias("modularity"), (F.col("members") / F.col("nodes")).alias("coverage"))


def sweep(edges: DataFrame, resolutions: list[float], rounds: int, turn: Callable[[Column], Column], least: int = 2) -> tuple[float, DataFrame]:
    """(resolution, communities) of the best modularity, the first among equals. Resolutions are a short list."""
    edges = checkpointed(edges)
    best = None
    for resolution in resolutions:
        found = local_moves(edges, rounds, resolution, turn)
        value = round(quality(edges, found, least).first()["modularity"], 9)
        if best is None or value > best[0]:
            best = (value, resolution, found)
    return best[1], best[2]


def alike(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, set) of sections s, c and (set, c) of their distinct sets of concepts.

    What depends on a section's concepts only is worked out once for each set: sections of few concepts
    repeat theirs. An array holds the distinct concepts of one section.
    """
    sets = written(sections.where("c is not null").groupBy("s").agg(F.array_sort(F.collect_set("c")).alias("set")))
    return sets, sets.select("set").distinct().select("set", F.explode("set").alias("c"))


def template_coverage(sections: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """s, template, coverage, missing of the template that covers a section best, if it covers ``least`` of its own concepts.

    ``sections``: s, c; ``templates``: template, c. Concepts meet by an equi-join, once for each set of
    concepts that sections have; the name breaks ties.
    """
    sets, concepts = alike(sections)
    sizes = templates.groupBy("template").agg(F.count("*").alias("size"))
    hits = concepts.join(templates, "c").groupBy("set", "template").agg(F.count("*").alias("hit")).join(sizes, "template")
    scored = hits.withColumn("coverage", F.round(F.col("hit") / F.col("size"), 6)).where(F.col("coverage") >= least)
    best = scored.groupBy("set").agg(F.min_by(F.struct("template", "coverage", (F.col("size") - F.col("hit")).alias("missing")), F.struct(-F.col("coverage"), "template")).alias("b"))
    return sets.join(best, "set").select("s", "b.template", "b.coverage", "b.missing")


def matched(sections: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """s, comm, score of the k communities in whose profiles a section's concepts weigh most; the name breaks ties.

    ``sections``: s, c; ``profiles``: comm, c, p. Worked out once for each set of concepts that sections have.
    """
    sets, concepts = alike(sections)
    summed = concepts.join(profiles, "c").groupBy("set", "comm").agg(F.round(F.sum("p"), 6).alias("score"))
    best = top_k(summed, ["set"], [F.col("score").desc(), F.col("comm")], k)
    return sets.join(best, "set").select("s", "comm", "score")


def resolve_sections(candidates: DataFrame, matches: DataFrame, profiles: DataFrame, gap: float, floor: float = 0.001) -> DataFrame:
    """s, token, concept, score, status of each token's best concept, with its section's community as evidence.

    ``candidates``: s, token, concept, prior; ``matches``: s, comm (one at most); ``profiles``: comm, c,
    p. The score is the log of the prior and of the concept's share in the community; a token is
    resolved if the best leads the second by ``gap``, or is alone, else it stays open.
    """
    known = candidates.join(matches, "s", "left").join(profiles.select("comm", F.col("c").alias("concept"), "p"), ["comm", "concept"], "left")
    score = F.round(F.log("prior") + F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(floor))), 6)
    w = Window.partitionBy("s", "token").orderBy(F.col("score").desc(), "concept")
    ranked = known.withColumn("score", score).withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_r = 1")
    status = F.when(F.col("_next").isNull() | (F.col("score") - F.col("_next") >= gap), "resolved").otherwise("open")
    return ranked.select("s", "token", "concept", "score", status.alias("status"))
