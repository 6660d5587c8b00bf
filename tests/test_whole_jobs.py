"""Queries whose SQL once left a part of the job out: small tables on which the part shows."""

import collections
import datetime
import hashlib

import __spark_entry__

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def over(spark, folder, name, tables):
    """Rows of a query over tables of (rows, schema) lists, each list a file."""
    for table, (parts, schema) in tables.items():
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{table}.parquet")
    return __spark_entry__.queries()[name](spark, str(folder)).collect()


def test_a_signal_meets_every_subscription_before_it(spark, tmp_path):
    rows = [(k, None, user, kind, 0.0, None) for k, user, kind in [(1, 1, "signup"), (2, 1, "signup"), (3, 1, "purchase"), (4, 1, "signup"), (5, 2, "signup"), (6, 2, "purchase"), (7, 3, "purchase")]]
    found = over(spark, tmp_path, "stream_correlate", {"events": ([rows], EVENTS)})
    assert sorted((r.signal, r.subscription) for r in found) == [(3, 1), (3, 2), (6, 5)]


def test_late_rows_correct_their_window_and_the_last_days_are_given(spark, tmp_path):
    def event(k, day):
        return (k, datetime.datetime(2024, 1, day, 12), 1, "view", 0.0, None)

    parts = [[event(20 * d + 1, d) for d in range(1, 31)], *([event(1000 + k, 30)] for k in range(1, 9)), [event(2001, 2), event(2020, 5)]]  # more files than a batch takes, the late ones last
    found = over(spark, tmp_path, "stream_late", {"events": (parts, EVENTS)})
    want = collections.Counter(range(1, 31)) + collections.Counter({30: 8, 2: 2})
    assert {r.start.day: r.n for r in found} == dict(want)


def test_a_states_digest_is_over_its_sorted_rows_hashes(spark, tmp_path):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    rows = [(k, k % 2, "FOP"[k % 3], 1.0, None, "1-URGENT") for k in range(9)]
    found = over(spark, tmp_path, "state_digest", {"orders": ([rows], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")})
    want = {}
    for root in (0, 1):
        by = collections.defaultdict(list)
        for h in sorted(sha(f"{r[0]}\t{r[2]}") for r in rows if r[1] == root):
            by[h[:4]].append(h)
        want[root] = sha("".join(p + sha("".join(hs)) for p, hs in sorted(by.items())))
    assert {r.root: r.digest for r in found} == want
