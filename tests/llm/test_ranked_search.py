import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from graphloom.llm import queries, ranked_search
from pyspark.sql import functions as F

_TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in _TERM.findall(text or "")]


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by the definitions, all documents for each item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    rows = []
    for i, words in asked.items():
        found = []
        for d, c in held:
            n = sum(c.values())
            m = 75 + (25 * n * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        rows += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return rows


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op12_ranked_search"])
    assert want.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(queries.op12_ranked_search(spark, sf_dir)) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize(("shard_bytes", "set_terms"), [(1 << 20, 1 << 20), (4000, 60)])
def test_against_brute_force_in_any_shards_and_sets(spark, sf_dir, shard_bytes, set_terms):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index = ranked_search.build(docs, shard_bytes)
    assert spark.read.parquet(index.folder).select("shard").distinct().count() > (20 if shard_bytes == 4000 else 0)
    got = rows(ranked_search.search(index, items, 7, set_terms))
    assert got == sorted(brute(docs.collect(), items.select("item_id", "text").collect(), 7), key=repr)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "word line naïve"), (1, "word"), (2, None), (3, "?!"), (None, "LINE 漢字"), (5, "nowhere"), (6, "a a ab")], "item_id int, text string")
    index = ranked_search.build(odd)
    got = ranked_search.search(index, items, 3)
    assert rows(got) == sorted(brute(odd.select("doc_id", "text").collect(), items.collect(), 3), key=repr)
    assert {r.item_id for r in got.collect()} == {1, None, 6}
    assert ranked_search.search(ranked_search.build(empty), items).count() == 0
    assert ranked_search.search(index, items.limit(0)).count() == 0


def test_blocks_cost_the_least(monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_COST", 40)
    rng = np.random.default_rng(3)
    lists = [rng.integers(1, 100, n) for n in (1, 2, 7, 30, 1, 90)]
    offsets = np.cumsum([0, *map(len, lists)])
    lengths, tops, at = ranked_search.cut_blocks(np.concatenate(lists), offsets)
    for k, x in enumerate(lists):
        best = [0]
        for i in range(1, len(x) + 1):
            best.append(min(best[j] + 40 + (i - j) * int(x[j:i].max()) for j in range(max(0, i - ranked_search._LONGEST), i)))
        own, top = lengths[at[k] : at[k + 1]], tops[at[k] : at[k + 1]]
        ends = np.cumsum(own)
        assert ends[-1] == len(x)
        assert [int(x[e - n : e].max()) for e, n in zip(ends, own, strict=True)] == top.tolist()
        assert int((own * top).sum()) + 40 * len(own) == best[-1]


def test_long_lists_are_cut_in_stretches():
    x = np.random.default_rng(1).integers(1, 1_000_000, 3 * ranked_search._STRETCH + 5)
    lengths, tops, _ = ranked_search.cut_blocks(x, np.array([0, len(x)]))
    assert lengths.sum() == len(x) and lengths.max() <= ranked_search._LONGEST
    assert (np.repeat(tops, lengths) >= x).all()


def test_stretches_below_the_bound_are_not_scored():
    n = 4096
    ords, counts = np.arange(n, dtype=np.uint16), np.ones(n, np.uint32)
    counts[1000:1010] = 50
    norms = np.full(n, 100)
    lengths, tops, _ = ranked_search.cut_blocks(ranked_search.impact(counts, norms), np.array([0, n]))
    lists = {0: (ords, counts, lengths.astype(np.uint8), tops.astype(np.uint32))}
    asked = ranked_search._Asked(ranked_search.pa.array([7]), {"t": 0}, np.array([0, 1]), np.array([0]), np.array([9]))
    best = ranked_search._Best(1, 5)
    scored = ranked_search._search_shard(asked, lists, np.arange(n), np.ones(n, bool), norms, best)
    assert best.ids[0].tolist() == [1000, 1001, 1002, 1003, 1004] and scored < n // 8


def test_a_term_in_every_document_is_spread(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the thing "), (F.col("id") % 7).cast("string")).alias("text"))
    index = ranked_search.build(docs, 1000)
    lists = spark.read.parquet(index.folder).where("term = 'the'")
    assert lists.count() > 20 and lists.agg(F.sum("df")).first()[0] == 3000
    items = spark.createDataFrame([(1, "the 3 thing")], "item_id long, text string")
    assert [r.doc_id for r in ranked_search.search(index, items, 4).orderBy("rank").collect()] == [3, 10, 17, 24]
