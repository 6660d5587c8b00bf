import random

import pytest
from graphloom.operators import settle


def brute(rows, own, shared):
    have, top, out = {}, {}, []
    for group, account, pos, delta in sorted(rows, key=lambda r: r[2]):
        a, t = have.get(account, own), top.get(group, shared)
        take = delta if delta >= 0 else -min(-delta, max(0, min(a, t)))
        have[account], top[group] = a + take, t + take
        out.append((pos, take, "granted" if take == delta else "refused" if take == 0 else "rationed"))
    return sorted(out)


def postings(n, seed):
    rng = random.Random(seed)
    return [(a % 5 if a % 3 else 5, f"a{a}", pos, rng.choice([-1, -1, -1, 1]) * rng.randrange(0, 60)) for pos, a in ((p, rng.randrange(30)) for p in range(n))]


@pytest.mark.parametrize(("own", "shared"), [(100, 10**9), (100, 400), (100, 0), (0, 50), (1000, 900)])
def test_against_the_plain_loop(spark, own, shared):
    rows = postings(600, own + shared)
    df = spark.createDataFrame(rows, "group long, account string, pos long, delta long")
    got = sorted(map(tuple, settle.settle(df, own, shared, block=50).collect()))
    assert got == brute(rows, own, shared)


def test_a_limit_that_does_not_bind_needs_no_fold_of_the_group(spark, monkeypatch):
    folds = []
    plain = settle.ordered_fold
    monkeypatch.setattr(settle, "ordered_fold", lambda rows, keys, *rest: folds.append(keys) or plain(rows, keys, *rest))
    df = spark.createDataFrame(postings(200, 1), "group long, account string, pos long, delta long")
    assert settle.settle(df, 50, 10**9).count() == 200 and folds == [["account"]]
    assert settle.settle(df.limit(0), 50, 10).count() == 0
