import random
from collections import defaultdict

import pytest
from graphloom.operators import leiden


def modularity(edges, found, resolution=1.0):
    total = 2 * sum(w for *_, w in edges)
    degree, inside = defaultdict(float), 0.0
    for a, b, w in edges:
        degree[found[a]] += w
        degree[found[b]] += w
        inside += 2 * w * (found[a] == found[b])
    return inside / total - resolution * sum((d / total) ** 2 for d in degree.values())


def connected(edges, found):
    near = defaultdict(set)
    for a, b, _ in edges:
        if found[a] == found[b]:
            near[a].add(b)
            near[b].add(a)
    groups = defaultdict(set)
    for n, c in found.items():
        groups[c].add(n)
    for nodes in groups.values():
        seen, todo = set(), [next(iter(nodes))]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n]
        if seen != nodes:
            return False
    return True


def run(spark, edges, **options):
    options = {"rounds": 6, "levels": 4} | options
    df = spark.createDataFrame([(str(a), str(b), float(w)) for a, b, w in edges], "a string, b string, weight double")
    return {r.node: r.community for r in leiden.leiden(df, **options).collect()}, [(str(a), str(b), w) for a, b, w in edges], df


def rings(n, size):
    """n cliques in a ring, each linked to the next by one edge."""
    edges = [(c * size + i, c * size + j, 1.0) for c in range(n) for i in range(size) for j in range(i)]
    return edges + [(c * size, (c + 1) % n * size + 1, 1.0) for c in range(n)]


def test_cliques_in_a_ring(spark):
    found, edges, _ = run(spark, rings(8, 5))
    assert {min(map(int, (n for n in found if found[n] == c))) for c in set(found.values())} == {5 * k for k in range(8)}
    assert connected(edges, found)


@pytest.mark.parametrize("salt", [1])
def test_never_below_one_level_and_always_connected(spark, salt):
    rng = random.Random(salt)
    nodes = 40
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(70)) if a != b}
    edges |= {(i, i + 1) for i in range(nodes - 1) if i % 10 != 9}
    weighted = [(a, b, 1.0 + (a * b) % 3) for a, b in sorted(edges)]
    found, edges, df = run(spark, weighted, salt=salt)
    one = {r.node: r.community for r in leiden.leiden(df, rounds=6, levels=1, salt=salt).collect()}
    assert set(found) == {n for e in edges for n in e[:2]}
    assert modularity(edges, found) >= modularity(edges, one) - 1e-9
    assert connected(edges, found) and all(found[c] == c for c in found.values())


def test_one_level_gets_stuck_where_levels_do_not(spark):
    # Pairs of heavy pairs: single nodes have no move that gains once the pairs are made, only pairs as wholes have.
    edges = []
    for g in range(6):
        a, b, c, d = (4 * g + i for i in range(4))
        edges += [(a, b, 10.0), (c, d, 10.0), (a, c, 3.0), (b, d, 3.0)]
        edges += [(d, (4 * g + 4) % 24, 0.5)]
    one, named, _ = run(spark, edges, levels=1)
    found, _, _ = run(spark, edges)
    assert modularity(named, found) > modularity(named, one) + 0.01
    assert connected(named, found)


def test_loops_repeats_and_empty(spark):
    edges = [(1, 2, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 3, 5.0), (3, 4, 0.1), (4, 5, 2.0)]
    found, _, df = run(spark, edges)
    assert found == {"1": "1", "2": "1", "3": "3", "4": "4", "5": "4"}
    assert leiden.leiden(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    """The registered query, on the smallest tables: all parts that share an order, connected communities, better than none."""
    from itertools import combinations

    from __spark_entry__ import queries

    orders, degree, together = defaultdict(set), defaultdict(int), defaultdict(int)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect():
        orders[r[0]].add(r[1])
        degree[r[1]] += 1
    for parts in orders.values():
        for pair in combinations(sorted(parts), 2):
            together[pair] += 1
    edges = [(a, b, round(n / min(degree[a], degree[b]), 6)) for (a, b), n in together.items()]
    found = {r.node: r.community for r in queries()["cluster_leiden"](spark, sf_dir).collect()}
    assert set(found) == {n for e in edges for n in e[:2]} and connected(edges, found)
    assert modularity(edges, found) > 0 and all(found[c] == c == min(n for n in found if found[n] == c) for c in set(found.values()))


def test_edges_are_worked_out_once(spark):
    """What makes the edges (a join of all pairs) runs once, not once for the links and once for the loops."""
    met = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([("1", "2", 1.0), ("3", "3", 2.0)], "a string, b string, weight double").mapInArrow(seen, "a string, b string, weight double")
    assert {r.node for r in leiden.leiden(df, rounds=1, levels=1).collect()} == {"1", "2", "3"}
    assert met.value == 2


def test_rounds_read_packed_edges_and_shuffle_none(spark, monkeypatch):
    """Sections of any type, with repeats, nulls and one alone; also in several packed rows; no round of joins."""
    monkeypatch.setattr(leiden, "_moved", None)
    monkeypatch.setattr(leiden.arrays, "ROW", 4)
    rows = [("s1", "a"), ("s1", "b"), ("s1", "c"), ("s1", "a"), ("s2", "a"), ("s2", "b"), ("s3", "x"), ("s3", "y"), ("s4", "z"), (None, "q"), ("s5", None), ("s6", "c"), ("s6", "b")]
    found = {r.node: r.community for r in leiden.of_sections(spark.createDataFrame(rows, "s string, c string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    near = leiden.arrays.of_sections(spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 2)], "s long, c int"), 3)
    assert leiden.arrays.degrees(near, 3).tolist() == [2.0, 1.0, 1.0] and leiden.arrays.linked(near, 4).tolist() == [True, True, True, False]
