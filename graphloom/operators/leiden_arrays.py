"""Rounds of communities over packed edges: what is known of nodes is a few arrays, edges stay in Spark and are never shuffled in a round.

Nodes are numbered in their order. Edges are stored as rows that hold whole nodes with all their edges, as bytes of arrays,
about ``ROW`` edges each. A round sends the nodes' communities to the workers, reads the packed edges once and gives back
a number for each node. So the driver holds a few numbers for each node, a worker as much and a row of edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import written

#: Edges of a packed row; a node with more has a row of its own.
ROW = 1 << 19
DIGITS = 9
PACKED = ("nodes", "ends", "others", "weights", "loops", "inner")
Edges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def coin(ids: np.ndarray, *salt: int) -> np.ndarray:
    """0 or 1 by a hash of the ids and of numbers."""
    x = ids.astype(np.uint64)
    for s in (*salt, 0):
        x = x + np.uint64((s * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x & np.uint64(1)).astype(bool)


def numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(node, id in the order of the nodes from 0; how many) of distinct nodes."""
    ordered = written(nodes.orderBy("node").select("node", F.monotonically_increasing_id().alias("m")))
    begins, n = [], 0
    part = F.shiftright("m", 33)
    for r in sorted(ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        begins.append((r.p, n))
        n += r.n
    at = ordered.sparkSession.createDataFrame(begins, "p long, begin long")
    return ordered.join(F.broadcast(at), part == F.col("p")).select("node", (F.col("begin") + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int").alias("id")), n


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order and the sums of their weights."""
    if not len(a):
        return a, b, w
    order = np.argsort((a.astype(np.int64) << 32) | b, kind="stable")
    a, b, w = a[order], b[order], w[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(w, first)


def _row(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[bytes]:
    """A packed row of edges with distinct, ordered ends."""
    same = a == b
    loops, inner = a[same], w[same]
    a, b, w = a[~same], b[~same], w[~same]
    begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    ends = np.r_[begins[1:], len(a)] if len(a) else begins
    kinds = (np.int32, np.int64, np.int32, np.float64, np.int32, np.float64)
    return [np.ascontiguousarray(x, kind).tobytes() for x, kind in zip((a[begins], ends, b, w, loops, inner), kinds, strict=True)]


def _record(rows: list[list[bytes]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(len(names))], list(names))


SENT = "to int, a binary, b binary, w binary"


def _sent(a: np.ndarray, b: np.ndarray, w: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """Edges as one row of bytes for each part of the nodes that they come from; without weights each counts 1."""
    to = a % parts
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True]) if len(a) else np.zeros(1, int)
    spans = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = [[x[i].tobytes() if x is not None else b"" for i in spans] for x in (a.astype(np.int32), b.astype(np.int32), w)]
    return pa.RecordBatch.from_arrays([pa.array([int(to[i[0]]) for i in spans], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["to", "a", "b", "w"])


def packed(sent: DataFrame, parts: int, weight: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Packed rows of the edges sent (each is there from both ends); equal edges add up, to what ``weight`` makes of the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, w = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in ((1, np.int32), (2, np.int32), (3, np.float64)))
                for found, x in zip(got, (a, b, w if len(w) else np.ones(len(a))), strict=True):
                    found.append(x.copy())
        if got[0]:
            a, b, w = _summed(*map(np.concatenate, got))
            yield _record([_row(a, b, weight(a, b, w) if weight else w)], PACKED)

    return written(sent.repartition(parts, "to").mapInArrow(run, ", ".join(f"{c} binary" for c in PACKED)))


def parts_for(edges: int) -> int:
    return max(1, -(-edges // ROW))


def of_edges(edges: DataFrame) -> DataFrame:
    """Packed rows of directed edges u, v, w."""
    parts = parts_for(edges.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _sent(*[c.to_numpy(zero_copy_only=False) for c in batch.columns], parts)

    return packed(edges.mapInArrow(run, SENT), parts)


def of_sections(observations: DataFrame, n: int) -> DataFrame:
    """Packed edges between concepts c (numbers) that are in a section s together, weighted by the overlap coefficient."""
    context = observations.sparkSession.sparkContext

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            s = pa.chunked_array([x[0] for x in got]).combine_chunks().dictionary_encode().indices.to_numpy()
            s, c, _ = _summed(s, np.concatenate([x[1].to_numpy() for x in got]), np.zeros(len(s)))
            size = np.bincount(s).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([s.astype(np.int32).tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([int((size * (size - 1)).sum())])], ["s", "c", "edges"])

    sections = written(observations.select("s", "c").repartition(parts_for(observations.count()), "s").mapInArrow(kept, "s binary, c binary, edges long"))
    parts = parts_for(sections.agg(F.sum("edges")).first()[0] or 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch[0]:
                c, many = np.unique(np.frombuffer(x.as_buffer(), np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(many)], ["c", "n"])

    counts = sections.select("c").mapInArrow(counted, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    degree = np.zeros(n)
    degree[counts["c"].to_numpy()] = counts["n"].to_numpy()
    sent = context.broadcast(degree)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s, c = (np.frombuffer(batch[k][i].as_buffer(), np.int32) for k in (0, 1))
                d, met, size = 1, [], 0
                at = np.flatnonzero(s[:-1] == s[1:])
                while len(at):  # pairs whose places are d apart in a section
                    met.append((c[at], c[at + d]))
                    size += len(at)
                    if size >= 1 << 20:
                        a, b = map(np.concatenate, zip(*met, strict=True))
                        yield _sent(np.r_[a, b], np.r_[b, a], None, parts)
                        met, size = [], 0
                    d += 1
                    at = at[at + d < len(s)]
                    at = at[s[at] == s[at + d]]
                if met:
                    a, b = map(np.concatenate, zip(*met, strict=True))
                    yield _sent(np.r_[a, b], np.r_[b, a], None, parts)

    return packed(sections.select("s", "c").mapInArrow(paired, SENT), parts, lambda a, b, w: np.round(w / np.minimum(sent.value[a], sent.value[b]), 6))


def _edges(near: DataFrame, each: Callable[[Edges], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``each`` gives for the packed rows (nodes, the edges' place in them, others, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, ends, others, weights = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in enumerate((np.int32, np.int64, np.int32, np.float64)))
                if len(nodes):
                    out = each((nodes, np.repeat(np.arange(len(nodes)), np.diff(ends, prepend=0)), others, weights))
                    if out is not None:
                        yield out

    return near.select(*PACKED[:4]).mapInArrow(run, schema)


def _by_node(near: DataFrame, each: Callable[[Edges], tuple[np.ndarray, float]], values: np.ndarray) -> tuple[np.ndarray, float]:
    """``values`` with those that ``each`` gives for its nodes, and the sum of its numbers."""

    def run(edges: Edges) -> pa.RecordBatch:
        found, number = each(edges)
        return pa.RecordBatch.from_arrays([pa.array([edges[0].tobytes()], pa.binary()), pa.array([found.astype(values.dtype).tobytes()], pa.binary()), pa.array([number], pa.float64())], ["nodes", "found", "number"])

    out, numbers = values.copy(), []
    for r in _edges(near, run, "nodes binary, found binary, number double").collect():  # some bytes a node
        out[np.frombuffer(r.nodes, np.int32)] = np.frombuffer(r.found, values.dtype)
        numbers.append(r.number)
    return out, math.fsum(numbers)


def _best(edges: Edges, community: np.ndarray, k: np.ndarray, t: np.ndarray, total: float, resolution: float) -> tuple[np.ndarray, float]:
    """Where each node gains most (staying before moving, then the least), and the weight to its own community of all."""
    nodes, place, others, weights = edges
    a, c, w = _summed(place, community[others], weights)
    me, ka = community[nodes], k[nodes]
    stays = c == me[a]
    gain = np.round(w - resolution * ka[a] * (t[c] - np.where(stays, ka[a], 0.0)) / total, DIGITS)
    stay = np.round(-resolution * ka * (t[me] - ka) / total, DIGITS)
    stay[a[stays]] = gain[stays]
    begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    most = np.maximum.reduceat(gain, begins)
    least = np.minimum.reduceat(np.where(gain == most[a], c, np.iinfo(np.int32).max), begins)
    return np.where(stay >= most, me, least), float(w[stays].sum())


def moved(near: DataFrame, community: np.ndarray, k: np.ndarray, loops: float, total: float, resolution: float, rounds: int, salt: int, patience: int = 2) -> tuple[np.ndarray, float]:
    """(communities, modularity) of the best partition met in ``rounds`` rounds of moves, as ``leiden._moved``."""
    context, ids = near.sparkSession.sparkContext, np.arange(len(community))
    best: tuple[float, np.ndarray] | None = None
    waited = 0
    for r in range(rounds + 1):
        t = np.bincount(community, weights=k, minlength=len(k))
        sent = context.broadcast((community, k, t))
        to, within = _by_node(near, lambda edges, sent=sent: _best(edges, *sent.value, total, resolution), community)
        sent.destroy()
        eager = int((to != community).sum())
        quality = round((within + loops) / total - resolution * float((t * t).sum()) / (total * total), DIGITS)
        if best is None or quality > best[0]:
            best, waited = (quality, community), 0
        else:
            waited += 1
        if not eager or waited >= patience or r == rounds:
            break
        community = to if eager == 1 else np.where(coin(ids, salt, r), to, community)
    return best[1], best[0]


def inside(near: DataFrame, community: np.ndarray) -> DataFrame:
    """The edges within communities, packed."""
    sent = near.sparkSession.sparkContext.broadcast(community)

    def each(edges: Edges) -> pa.RecordBatch | None:
        nodes, place, others, weights = edges
        kept = sent.value[nodes][place] == sent.value[others]
        return _record([_row(nodes[place[kept]], others[kept], weights[kept])], PACKED) if kept.any() else None

    found = written(_edges(near, each, ", ".join(f"{c} binary" for c in PACKED)))
    sent.destroy()
    return found


def parts(within: DataFrame, k: np.ndarray, total: float, resolution: float, salt: int, rounds: int = 8) -> np.ndarray:
    """Part of each node: connected parts of communities, grown by merges that gain, as ``leiden._parts``."""
    context, part, idle = within.sparkSession.sparkContext, np.arange(len(k), dtype=np.int32), 0
    for r in range(rounds):
        sent = context.broadcast((part, np.bincount(part, weights=k, minlength=len(k))))

        def each(edges: Edges, sent=sent, r: int = r) -> pa.RecordBatch | None:
            part, kp = sent.value
            nodes, place, others, weights = edges
            a, b = part[nodes][place], part[others]
            met = ~coin(a, salt, r) & coin(b, salt, r)
            a, b, w = _summed(a[met], b[met], weights[met])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, w, kp[a] * kp[b])], ["a", "b", "w", "kk"]) if len(a) else None

        met = _edges(within, each, "a int, b int, w double, kk double").repartition("a").groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("kk").alias("kk"))
        gain = F.round(F.col("w") - resolution * F.col("kk") / total, DIGITS)
        joins = met.withColumn("gain", gain).where("gain > 0").groupBy("a").agg(F.min_by("b", F.struct((-F.col("gain")).alias("g"), F.col("b"))).alias("to")).toArrow()
        sent.destroy()
        if not joins.num_rows:
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        new = np.arange(len(k), dtype=np.int32)
        new[joins["a"].to_numpy()] = joins["to"].to_numpy()
        part = new[part]
    return part


def contracted(near: DataFrame, group: np.ndarray) -> DataFrame:
    """Packed edges between groups of nodes, with those within as loops."""
    sent = near.sparkSession.sparkContext.broadcast(group)
    parts = parts_for((near.agg(F.sum(F.length("others"))).first()[0] or 0) // 4)

    def each(edges: Edges) -> pa.RecordBatch:
        nodes, place, others, weights = edges
        return _sent(*_summed(sent.value[nodes][place], sent.value[others], weights), parts)

    found = packed(_edges(near, each, SENT), parts)
    sent.destroy()
    return found


def loops_of(near: DataFrame, n: int) -> np.ndarray:
    """Weight of each node's loops, both ways."""
    out = np.zeros(n)
    for r in near.select("loops", "inner").where("length(loops) > 0").collect():
        out[np.frombuffer(r.loops, np.int32)] = np.frombuffer(r.inner, np.float64)
    return out


def linked(near: DataFrame, n: int) -> np.ndarray:
    """Whether each node has an edge or a loop."""
    out = np.zeros(n, bool)
    for r in near.select("nodes", "loops").collect():
        for x in r:
            out[np.frombuffer(x, np.int32)] = True
    return out


def degrees(near: DataFrame, n: int) -> np.ndarray:
    """Weight of each node's edges to others."""
    return _by_node(near, lambda edges: (np.bincount(edges[1], weights=edges[3]), 0.0), np.zeros(n))[0]


def connected(within: DataFrame, n: int) -> np.ndarray:
    """Least node of each node's component: labels of neighbours are hooked onto each other, then jumped over."""
    context, label = within.sparkSession.sparkContext, np.arange(n, dtype=np.int32)
    while True:
        sent = context.broadcast(label)

        def each(edges: Edges, sent=sent) -> tuple[np.ndarray, float]:
            nodes, place, others, _ = edges
            return np.minimum.reduceat(sent.value[others], np.flatnonzero(np.r_[True, place[1:] != place[:-1]])), 0.0

        least, _ = _by_node(within, each, label)
        sent.destroy()
        new = np.minimum(label, least)
        np.minimum.at(new, label, least)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            return label
        label = new


def named(nodes: DataFrame, community: np.ndarray) -> DataFrame:
    """node, community (a node) of nodes node, id and the ids of their communities; below 0 for none."""
    sent, kind = nodes.sparkSession.sparkContext.broadcast(community), nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(sent.value[batch[1].to_numpy()])], ["node", "c"])

    of = nodes.select(F.col("node").alias("community"), F.col("id").alias("c"))
    return nodes.select("node", "id").mapInArrow(run, f"node {kind}, c int").where("c >= 0").join(of, "c").select("node", "community")
