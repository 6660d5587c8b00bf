from collections import Counter, defaultdict

import duckdb
import pytest
from graphloom.llm import divergence, queries
from pyspark.sql import functions as F


def words(text):
    out, now = [], ""
    for c in [*(text or ""), " "]:
        if c.isascii() and not c.isalpha():
            out += [now] * bool(now)
            now = ""
        else:
            now += c.lower() if c.isascii() else c
    return out


def brute(docs, top=200, least=3):
    """docs: (lang, source, text). All rows by the definitions."""
    docs = [tuple(x or "" for x in d) for d in docs]
    held, used, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        groups[lang].add(source)
        w = words(text)
        held[lang].update(set(w))
        used[lang, source].update(w)
    rows = []
    for lang, sources in groups.items():
        kept = {t for t, n in held[lang].items() if n >= least}
        v = len(kept)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + v) for t in kept}

        q = shares(sum((used[lang, s] for s in sources), Counter()))
        p = {s: shares(used[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if used[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (x[0], x[1].encode()))
                rows += [(lang, s, part, i, -f, r) for r, (f, i) in enumerate(order, 1) if part == "pair" or r <= top]
    return sorted(rows)


def rows(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_query_against_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = rows(queries.op13_divergence(spark, sf_dir))
    assert got == sorted(con.sql(queries.oracle_sql()["op13_divergence"]).fetchall())
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()])


DOCS = [
    ("x", "a", "one two three é1é"), ("x", "a", "ONE two"), ("x", "b", "one, one. two"), ("x", "c", None), ("x", "c", "three three é"), ("x", None, "three two É"),
    ("y", "a", "alone alone"), (None, None, None), (None, "b", "one one one"), ("z", "a", "p q"), ("z", "b", "p q"), ("z", "a", "p q"), ("z", "a", "p q"),
]


@pytest.mark.parametrize(("top", "least"), [(200, 3), (1, 1), (2, 2)])
def test_small_groups(spark, top, least):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "lang string, source string, text string, term int")
    assert rows(divergence.audit(docs, top, least)) == brute(DOCS, top, least)


def test_odd_rows(spark, odd, empty):
    assert rows(divergence.audit(odd, least_docs=1)) == brute([tuple(r) for r in odd.select("lang", "source", "text").collect()], least=1)
    assert divergence.audit(empty).count() == 0


@pytest.mark.parametrize("k", [1, 7, 50, 5000])
def test_radix_top_against_sorting(spark, k):
    groups = {"small": [5, 5, 1], "ties": [3] * 500, "wide": [(i * 7919) % 1009 << (i % 50) for i in range(900)], "two": [2**60, 2**60, 0, 0, 0]}
    names = "é ", "e", "ea", "\U0001f600", "中", "z"
    data = [(g, names[i % 6] + str(i), v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "g string, item string, value long")
    got = sorted(map(tuple, divergence.radix_top(df, ["g"], k).collect()))
    want = []
    for g in groups:
        want += sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
    assert got == sorted(want)
    assert divergence.radix_top(df.limit(0), ["g"], k).count() == 0


def test_an_item_twice_at_the_threshold_is_refused(spark):
    df = spark.createDataFrame([("g", "same", 3), ("g", "same", 3), ("g", "other", 5)], "g string, item string, value long")
    with pytest.raises(ValueError, match="twice"):
        divergence.radix_top(df, ["g"], 2)


def test_shares_beyond_64_bits(spark):
    counts = [(0, 0, 0), (5, 100, 7), (9 * 10**9, 10**10, 3), (10**13, 3 * 10**13, 10**6)]
    got = spark.createDataFrame(counts, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // max(1, r.n + r.v) for r in got)


def test_value_of_no_kept_terms_is_zero(spark):
    got = rows(divergence.audit(spark.createDataFrame([("x", "a", "t"), ("x", "b", "")], "lang string, source string, text string")))
    assert got == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]
