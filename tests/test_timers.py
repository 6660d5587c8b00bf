import datetime as dt

import pytest
from graphloom.streaming import timers
from graphloom.streaming.timers import Timer

DAY = dt.datetime(2024, 1, 1)
MOVES = {("idle", "go"): "busy", ("busy", "end"): "idle", ("busy", "wait"): "held", ("held", "end"): "idle"}
TIMERS = {"busy": Timer(60, "idle", "late"), "held": Timer(30, None, "nudge")}


def at(s):
    return DAY + dt.timedelta(seconds=s)


def us(s):
    return int((at(s) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """Batches of one file each: (key, second, seq, event). Gives the rows by batch and the state's folder."""
    top = tmp_path_factory.mktemp("timers")
    batches = [
        [(1, 0, 1, "go"), (2, 5, 2, "go"), (3, 0, 3, "go"), (4, 0, 4, "go"), (4, 10, 5, "wait"), (5, 0, 6, "go"), (6, 0, 7, "go"), (6, 100, 8, "end")],
        [(3, 40, 9, "end"), (5, 59, 10, "wait"), (9, 50, 11, "go")],  # 3 leaves in time, 5 changes its timer
        [(9, 500, 12, "end")],  # the watermark passes the deadlines of 1, 2, 4 and 5, which say no more
        [(1, 510, 13, "go"), (9, 900, 14, "tick")],
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(a, at(s), n, e) for a, s, n, e in rows], "key long, ts timestamp, seq long, event string")
        df.coalesce(1).write.parquet(f"{top}/in/part={k}")
    got = {}

    def write(batch, n):
        got[n] = [(r.key, r.at_us, r.before, r.after, r.cause) for r in batch.collect()]

    stream = spark.readStream.schema("key long, ts timestamp, seq long, event string").option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    with timers.timer_state(spark):
        query = timers.timed_machine(stream, "key", "ts", "seq", "event", "10 seconds", MOVES, TIMERS, "idle").writeStream.foreachBatch(write).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted(x for rows in got.values() for x in rows), f"{top}/state"


def of(ran, key):
    return [(t, b, a, c) for k, t, b, a, c in ran[0] if k == key]


def test_a_silent_key_fires_once(ran):
    assert of(ran, 2) == [(us(5), "idle", "busy", "go"), (us(65), "busy", "idle", "late")]
    assert of(ran, 1) == [(us(0), "idle", "busy", "go"), (us(60), "busy", "idle", "late"), (us(510), "idle", "busy", "go"), (us(570), "busy", "idle", "late")]


def test_a_cancelled_timer_does_not_fire(ran):
    assert of(ran, 3) == [(us(0), "idle", "busy", "go"), (us(40), "busy", "idle", "end")]


def test_a_timer_that_does_not_interrupt_leaves_the_state(ran):
    assert of(ran, 4) == [(us(0), "idle", "busy", "go"), (us(10), "busy", "held", "wait"), (us(40), "held", "held", "nudge")]
    assert of(ran, 5) == [(us(0), "idle", "busy", "go"), (us(59), "busy", "held", "wait"), (us(89), "held", "held", "nudge")]


def test_a_deadline_goes_before_a_later_event(ran):
    assert of(ran, 6) == [(us(0), "idle", "busy", "go"), (us(60), "busy", "idle", "late"), (us(100), "idle", "idle", "end")]
    assert of(ran, 9)[:2] == [(us(50), "idle", "busy", "go"), (us(110), "busy", "idle", "late")]


def test_state_is_gone_at_the_start_state(spark, ran):
    rows = spark.read.format("statestore").option("stateVarName", "now").load(ran[1]).collect()
    assert sorted(r.key.key for r in rows) == [4, 5]  # held, their reminders are over
    assert spark.read.format("statestore").option("readRegisteredTimers", True).load(ran[1]).count() == 0


def test_the_start_state_holds_no_timer(spark):
    with pytest.raises(ValueError, match="start state"):
        timers.timed_machine(None, "key", "ts", "seq", "event", "1 second", MOVES, TIMERS, "busy")


def test_the_store_is_set_back(spark):
    before = spark.conf.get(timers._PROVIDER, None)
    with pytest.raises(KeyError), timers.timer_state(spark):
        raise KeyError
    assert spark.conf.get(timers._PROVIDER, None) == before
