"""Paths over edges: from a state graph to one expression, and from an expression to the pairs that it joins.

An expression is a nested tuple: ("step", name), ("back", name), ("seq", a, b), ("alt", a, b),
("star", a) or ("none",) for the empty path. It is built on the driver from a declared graph, and
evaluated as joins, unions and one closure for each star.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import checkpointed

from . import graph

Path = tuple
NONE: Path = ("none",)


def seq(a: Path, b: Path) -> Path:
    return b if a == NONE else a if b == NONE else ("seq", a, b)


def alt(a: Path | None, b: Path | None) -> Path | None:
    return b if a is None or a == b else a if b is None else ("alt", a, b)


def star(a: Path | None) -> Path:
    return NONE if a is None or a == NONE else ("star", a)


def eliminated(edges: list[tuple[str, str, str]], start: str, end: str) -> Path | None:
    """The expression of all paths from start to end of a graph of (state, step, state), by removing states; null without any.

    A step that begins with ^ goes against its edge. States go in the order of their names.
    """
    first, last = "<start>", "<end>"
    between: dict[tuple[str, str], Path | None] = {(first, start): NONE, (end, last): NONE}
    for a, name, b in edges:
        step: Path = ("back", name[1:]) if name.startswith("^") else ("step", name)
        between[a, b] = alt(between.get((a, b)), step)
    for state in sorted({s for a, _, b in edges for s in (a, b)} | {start, end}):
        loop = star(between.get((state, state)))
        into = [(a, p) for (a, b), p in between.items() if b == state and a != state and p is not None]
        out = [(b, p) for (a, b), p in between.items() if a == state and b != state and p is not None]
        for a, p in into:
            for b, q in out:
                between[a, b] = alt(between.get((a, b)), seq(seq(p, loop), q))
        between = {(a, b): p for (a, b), p in between.items() if state not in (a, b)}
    return between.get((first, last))


def text(path: Path) -> str:
    """The expression as text: / for a sequence, | for a choice, * for any number, ^ for a step backwards."""
    kind = path[0]
    if kind == "none":
        return "()"
    if kind == "step":
        return path[1]
    if kind == "back":
        return "^" + path[1]
    if kind == "star":
        return f"({text(path[1])})*"
    return "(" + {"seq": "/", "alt": "|"}[kind].join(text(p) for p in path[1:]) + ")"


def pairs(path: Path, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b of the nodes that a path joins. ``edges``: s, p, o; ``nodes`` (node): those that the empty path joins to themselves."""
    kind = path[0]
    if kind == "none":
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if kind == "step":
        return edges.where(F.col("p") == path[1]).select(F.col("s").alias("a"), F.col("o").alias("b"))
    if kind == "back":
        return edges.where(F.col("p") == path[1]).select(F.col("o").alias("a"), F.col("s").alias("b"))
    if kind == "alt":
        return pairs(path[1], edges, nodes).unionByName(pairs(path[2], edges, nodes)).distinct()
    if kind == "seq":
        left, right = pairs(path[1], edges, nodes), pairs(path[2], edges, nodes)
        return left.join(right.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
    if kind == "star":
        steps = pairs(path[1], edges, nodes).select(F.col("a").alias("child"), F.col("b").alias("parent"))
        closed = graph.closure(steps).select(F.col("desc").alias("a"), F.col("anc").alias("b"))
        return closed.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))).distinct()
    raise ValueError(f"unknown path {kind}")


def simulations(moves: DataFrame, start: str) -> DataFrame:
    """sub, super of protocols whose start accepts all that the other's does, and goes on so.

    ``moves``: protocol, state, event, next, one next for each event. Pairs of states are dropped
    until none breaks: rounds grow with the length of the shortest counterexample.
    """
    states = moves.select("protocol", "state").union(moves.select("protocol", "next")).distinct()
    a, b = states.select(F.col("protocol").alias("sub"), F.col("state").alias("x")), states.select(F.col("protocol").alias("super"), F.col("state").alias("y"))
    left = checkpointed(a.crossJoin(b))  # states of declared protocols: design-time data
    mine = moves.select(F.col("protocol").alias("sub"), F.col("state").alias("x"), "event", F.col("next").alias("x2"))
    theirs = moves.select(F.col("protocol").alias("super"), F.col("state").alias("y"), "event", F.col("next").alias("y2"))
    while True:
        asked = left.join(theirs, ["super", "y"]).join(mine, ["sub", "x", "event"], "left")
        still = left.select("sub", "super", F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(True).alias("ok"))
        broken = asked.join(still, ["sub", "super", "x2", "y2"], "left").where("ok is null").select("sub", "x", "super", "y").distinct()
        kept = checkpointed(left.join(broken, ["sub", "x", "super", "y"], "left_anti"))
        if kept.count() == left.count():
            return kept.where((F.col("x") == start) & (F.col("y") == start)).select("sub", "super")
        left = kept


def parsed(expression: str, step: Callable[[str], Path] = lambda name: ("back", name[1:]) if name.startswith("^") else ("step", name)) -> Path:
    """A path from text with / between steps; a caller's ``step`` reads another language's steps."""
    out = NONE
    for name in expression.split("/"):
        out = seq(out, step(name.strip()))
    return out
