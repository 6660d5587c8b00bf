import itertools
import random
from collections import Counter

import pytest
import xxhash
from graphloom.llm import queries, simhash


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: " " for c in [9, 10, 11, 12, 13]}).split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, threshold=3):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= threshold:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_simhash_components(spark, sf_dir).collect()}
    want = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    roots = brute_components(set(want.values()))
    least = {}
    for i, f in want.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {i: r.component_id for i, r in got.items()} == {i: least[roots[f]] for i, f in want.items()}
    assert max(Counter(r.component_id for r in got.values()).values()) > 1


@pytest.mark.parametrize(("cells", "threshold"), [(False, 3), (True, 3), (False, 5), (True, 5)])
def test_links_hold_all_near_pairs_together(spark, monkeypatch, cells, threshold):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1, 1 << 31, 1 << 63, 1 << 31 | 1 << 63}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            base ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, threshold + 1))})
            fps.add(base)
    if cells:
        monkeypatch.setattr(simhash, "PAIRS_AT_ANCHOR", 1)
        monkeypatch.setattr(simhash, "CELL", 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.connected(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), threshold)).collect()
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in found}
    want = brute_components(fps, threshold)

    def classes(of):
        groups = {}
        for f in fps:
            groups.setdefault(of.get(f, f), set()).add(f)
        return {frozenset(g) for g in groups.values()}

    assert classes(got) == classes(want)


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd, 3).collect()
    assert len(got) == 11
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by[(1, 0)] == by[(2, 0)] == 1
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in got if r.doc_id == 3} == {3}
    assert simhash.near_duplicates(empty, 3).count() == 0


def test_deduplicated_keeps_one_of_each(spark, odd, empty):
    kept = simhash.deduplicated(odd).orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [None, 1, 3, 4, 6, 7, 8, 9]
    assert kept[0].asDict().keys() == set(odd.columns)
    assert simhash.deduplicated(empty).count() == 0
    base = " ".join(f"w{k}" for k in range(400))
    near = spark.createDataFrame([(1, base), (2, base.replace("w7 ", "x ")), (3, base + " more"), (4, base[::-1])], "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicated(near).orderBy("doc_id").collect()] == [1, 4]
