import numpy as np
import pytest
from __spark_entry__ import queries
from graphloom.operators import nearest


def brute(ids, x, qids, q, k):
    x, q = nearest.unit(np.asarray(x, float)), nearest.unit(np.asarray(q, float))
    out = {}
    for i, v in zip(qids, q, strict=True):
        sim = np.round(x @ v, 6)
        out[i] = sorted((-s, j) for s, j in zip(sim, ids, strict=True) if j != i)[:k]
    return out


def recall(got, want):
    """Share of the true neighbours found, by similarity: ties are as good as each other."""
    hits = total = 0
    for i, true in want.items():
        found = sorted((r["similarity"] for r in got if r["query"] == i), reverse=True)
        least = -true[-1][0]
        hits += min(len(true), sum(s >= least - 1e-6 for s in found))
        total += len(true)
    return hits / total


def test_query_recall(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries()["vec_nearest"](spark, sf_dir).collect()
    asked = [r for r in rows if r.vec_id % 50 == 0]
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows], [r.vec_id for r in asked], [r.embedding for r in asked], 10)
    assert {r["query"] for r in got} == set(want) and all(len([r for r in got if r["query"] == i]) == len(w) for i, w in want.items())
    assert recall([r.asDict() | {"similarity": 2 * r.similarity - 1} for r in got], want) >= 0.9


@pytest.mark.parametrize("probes", [4, 1000])
def test_hot_lists_and_recall_on_clusters(spark, monkeypatch, probes):
    monkeypatch.setattr(nearest, "BLOCK", 50)
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 16))
    x = np.concatenate([middles[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16)), np.repeat(middles[:1], 300, axis=0)])  # a third are copies
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    got = nearest.nearest(df, df.where("id % 9 = 0"), "id", "v", 5, probes).collect()
    want = brute(ids, x, ids[::9], x[::9], 5)
    assert recall(got, want) >= (1.0 if probes == 1000 else 0.9)
    if probes == 1000:  # all lists are visited: exact, ties and ranks too
        assert {(r["query"], r["rank"], r.id) for r in got} == {(i, k, j) for i, w in want.items() for k, (_, j) in enumerate(w, 1)}


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["query"], r["rank"]): r.id for r in nearest.nearest(df, df, "id", "v", 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 6, (2, 1): 1, (2, 2): 6, (6, 1): 2, (6, 2): 1}
    assert nearest.nearest(df.limit(0), df, "id", "v", 2).count() == 0
    assert nearest.nearest(df, df.limit(0), "id", "v", 2).count() == 0
