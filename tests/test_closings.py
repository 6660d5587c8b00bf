"""Closings are kept once for the periods over which an account rests."""

from graphloom.operators import ledger


def test_a_resting_account_has_one_row_for_many_periods(spark):
    posted = spark.createDataFrame([("a", 0, 5), ("a", 0, 2), ("a", 9000, 1), ("b", 40, -3)], "account string, k long, delta long")
    got = sorted(map(tuple, ledger.closing_runs(posted, "k", 10_000).collect()))
    assert got == [("a", 0, 8999, 7), ("a", 9000, 10_000, 8), ("b", 40, 10_000, -3)]
