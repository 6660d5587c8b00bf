import random
from collections import Counter, defaultdict
from itertools import product

from graphloom.operators import abbreviations, cover
from pyspark.sql import functions as F


def test_maximal_sets_against_brute_force(spark):
    rng = random.Random(4)
    sets = {f"o{i:03}": {rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))} for i in range(160)}
    rows = [(o, x) for o, s in sets.items() for x in s] + [("o000", next(iter(sets["o000"])))]
    got = sorted(map(tuple, cover.maximal_sets(spark.createDataFrame(rows, "owner string, item string")).collect()))
    want = sorted((o, min(p for p, t in sets.items() if t == s)) for o, s in sets.items() if not any(s < t for t in sets.values()))
    assert got == want and len(got) < 160
    assert cover.maximal_sets(spark.createDataFrame([], "owner string, item string")).count() == 0


def test_maximal_sets_by_pivots_and_by_lists(spark, monkeypatch):
    """The largest sets first, then the lists: the same sets, whether the pivots hold many sets or none."""
    rng = random.Random(5)
    held = {f"h{i:03}": set(rng.sample("abcdefgh", rng.randrange(1, 8))) for i in range(90)} | {"all": set("abcdefgh")}
    apart = {f"p{i:02}": set(rng.sample("qrstuvwxyz", 4)) for i in range(60)}
    for pivots in (1, 3, 1000):
        monkeypatch.setattr(cover, "PIVOTS", pivots)
        for sets in (held, apart, held | apart):
            got = sorted(map(tuple, cover.maximal_sets(spark.createDataFrame([(o, x) for o, s in sets.items() for x in s], "owner string, item string")).collect()))
            assert got == sorted((o, min(p for p, t in sets.items() if t == s)) for o, s in sets.items() if not any(s < t for t in sets.values()))


def test_topmost_against_brute_force(spark):
    rng = random.Random(6)
    parent = {i: rng.randrange(i) for i in range(1, 60)}
    above = {i: set() for i in range(60)}
    for i in range(1, 60):
        above[i] = {parent[i]} | above[parent[i]]
    members = [(o, rng.randrange(60)) for o in range(25) for _ in range(8)]
    paths = [(i, a) for i in above for a in {i, *above[i]}]
    got = sorted(map(tuple, cover.topmost(spark.createDataFrame(members, "owner long, node long"), spark.createDataFrame(paths, "desc long, anc long")).collect()))
    assert got == sorted({(o, n) for o, n in members if not any(p == o and m in above[n] for p, m in members)})


def short_form(a, b):
    rest = iter(b)
    return 1 < len(a) < len(b) and a[0] == b[0] and all(c in rest for c in a)


def brute_align(short, long):
    """(met, letters) of the best alignment, by trying all."""
    if not short or not long:
        return 0, 0
    best = max(brute_align(short[1:], long), brute_align(short, long[1:]))
    if short[0] == long[0] or short_form(short[0], long[0]):
        m, n = brute_align(short[1:], long[1:])
        best = max(best, (m + 1, n + len(short[0])))
    return best


def test_short_forms_are_learned(spark):
    rng = random.Random(9)
    words = ["policy", "number", "amount", "account", "insured", "date", "of", "birth", "limit"]
    cut = {"policy": "pol", "number": "nmbr", "amount": "amt", "account": "acct", "insured": "ins", "limit": "lim"}
    pairs = []
    for _ in range(120):
        long = rng.sample(words, rng.randrange(1, 5))
        short = [cut.get(w, w) if rng.random() < 0.7 else w for w in long if rng.random() < 0.9]
        pairs.append((short, long))
    pairs += [([], ["x"]), (["a+b"], ["a+bc"]), (["zz"], []), (["ac", "c."], ["account", "c.d"])]
    df = spark.createDataFrame(pairs, "short array<string>, long array<string>")
    found = [r.p for r in df.select(abbreviations.aligned(F.col("short"), F.col("long")).alias("p")).collect()]
    for (short, long), p in zip(pairs, found, strict=True):
        met, letters = brute_align(short, long)
        assert all(short_form(x.short, x.long) and x.short in short and x.long in long for x in p)
        assert len(p) <= met and sum(len(x.short) for x in p) <= letters
    learned = {(r.short, r.long): r for r in abbreviations.learn(df).collect()}
    assert {(s, w) for w, s in cut.items()} <= set(learned)
    seen = Counter((x.short, x.long) for p in found for x in p)
    assert {k: r.n for k, r in learned.items()} == {k: n for k, n in seen.items() if n >= 2}
    assert all(abs(r.share - seen[k] / sum(n for (s, _), n in seen.items() if s == k[0])) < 1e-6 for k, r in learned.items())


def test_expansion_is_bounded_and_likeliest_first(spark):
    learned = spark.createDataFrame([("ac", "account", 3, 0.75), ("ac", "actual", 1, 0.25), ("no", "number", 2, 1.0)], "short string, long string, n long, share double")
    names = spark.createDataFrame([(1, ["ac", "no"]), (2, ["x"]), (3, ["ac"] * 9)], "id int, w array<string>")
    got = defaultdict(list)
    for r in abbreviations.expanded(names, "id", "w", learned, 50).collect():
        got[r.id].append(r.variant)
    assert sorted(got[1]) == sorted(" ".join(p) for p in product(["ac", "account", "actual"], ["no", "number"]))
    assert got[2] == ["x"]
    shares = {"ac": 1.0, "account": 0.75, "actual": 0.25}
    every = sorted((-(shares[a] * shares[b] * shares[c] * shares[d] * shares[e] * shares[f] * shares[g] * shares[h] * shares[i]), " ".join((a, b, c, d, e, f, g, h, i))) for a, b, c, d, e, f, g, h, i in product(shares, repeat=9))
    assert len(got[3]) == 50 and set(got[3]) == {t for _, t in every[:50]}
