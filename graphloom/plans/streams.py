"""Streaming queries, run over the events at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import fold, graph, paths
from graphloom.sources.shared import scratch
from graphloom.sources.tables import Tables
from graphloom.streaming import log, timers

from .registry import query


#: Files of a part of a stream: as many tasks read and write it.
FILES = 4


def events_stream(t: Tables) -> DataFrame:
    return log.stream_of(t.spark, t.sf_dir, "events")


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    return log.collected(log.per_window(events_stream(t), "ts", "1 day", "10 days", ["event_type"]), "complete")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(t: Tables) -> DataFrame:
    return log.collected(log.per_session(events_stream(t), "ts", "2 days", "10 days", ["user_id"]), "complete")


@query("SELECT DISTINCT event_id // 2 AS command FROM events")
def stream_idempotent(t: Tables) -> DataFrame:
    """Each command comes twice and is applied once."""
    s = events_stream(t).select(F.expr("event_id div 2").alias("command"), "ts")
    return log.collected(log.first_of_each(s, "command", "ts", "40 days").select("command"), "append")


@query("SELECT date_trunc('day', CASE WHEN event_id % 20 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END) AS start, count(*) AS n FROM events GROUP BY 1")
def stream_late(t: Tables) -> DataFrame:
    """Late rows correct their window, in whatever file they come: a row of state for each day, and none is dropped."""
    s = events_stream(t).select(F.expr("if(event_id % 20 = 0, ts - interval 3 days, ts)").alias("ts"))
    return log.collected(log.per_window(s, "ts", "1 day", "7 days", []), "complete")


@query("SELECT user_id AS k, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS balance, count(*) AS n FROM events GROUP BY 1")
def stream_single_writer(t: Tables) -> DataFrame:
    """One writer keeps the balance of each key; a batch gives the keys that it changed, and the last of them count."""
    s = events_stream(t).groupBy(F.col("user_id").alias("k")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("balance"), F.count("*").alias("n"))
    changed = log.collected(s, "update", number=True)
    return changed.groupBy("k").agg(F.max_by(F.struct("balance", "n"), "batch").alias("last")).select("k", "last.*")


# The transitions of the session machine; other events leave the state.
MOVES = {("idle", "click"): "active", ("active", "purchase"): "done", ("active", "error"): "idle", ("done", "view"): "idle"}
NEXT = "CASE " + " ".join(f"WHEN {{0}} = '{a}' AND {{1}} = '{e}' THEN '{b}'" for (a, e), b in MOVES.items()) + " ELSE {0} END"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, i, event_id AS seq, 'idle' AS before, {NEXT.format("'idle'", "event_type")} AS after FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.i, o.event_id, r.after, {NEXT.format("r.after", "o.event_type")} FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id, seq, before, after FROM r""")
def stream_session_fsm(t: Tables) -> DataFrame:
    moves = dict(MOVES)
    return log.collected(log.machine(events_stream(t), "user_id", "event_id", "event_type", lambda s, e: moves.get((s, e), s), "idle"), "append")


@query("""WITH e AS (SELECT user_id, event_id AS seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, seq, d // 1000000 AS waited_s FROM e WHERE d > 172800000000""")
def stream_timeout(t: Tables) -> DataFrame:
    return log.collected(log.overdue(events_stream(t), "user_id", "event_id", "ts", 172_800), "append")


# Timers of the session machine: an active session times out, a finished one is reminded once.
TIMERS = {"active": timers.Timer(172_800, "idle", "timeout"), "done": timers.Timer(86_400, None, "reminder")}
CAP_S = 86_400
LIMIT = "CASE s WHEN 'active' THEN e + 172800000000 WHEN 'done' THEN e + 86400000000 END"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
mark AS (SELECT max(epoch_us(ts)) - {CAP_S * 1_000_000} AS w FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS t, CAST('idle' AS VARCHAR) AS s, CAST(0 AS BIGINT) AS e, CAST('' AS VARCHAR) AS was, CAST('' AS VARCHAR) AS cause FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, i, t, s, CASE WHEN s <> was THEN t ELSE e END, was, cause FROM (
  SELECT user_id, i, t, {NEXT.format("was", "cause")} AS s, e, was, cause FROM (
  SELECT r.user_id, o.i, o.t, r.e, CASE WHEN r.s = 'active' AND r.e + 172800000000 <= o.t THEN 'idle' ELSE r.s END AS was, o.event_type AS cause FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))),
n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY i), (SELECT w FROM mark)) AS until FROM r),
f AS (SELECT user_id, {LIMIT} AS due, s, t, until FROM n WHERE i > 0)
SELECT user_id, t AS at_us, was AS before, s AS after, cause FROM r WHERE i > 0
UNION ALL SELECT user_id, due, s, CASE s WHEN 'active' THEN 'idle' ELSE s END, CASE s WHEN 'active' THEN 'timeout' ELSE 'reminder' END FROM f WHERE due > t AND due <= until""")
def stream_timers(t: Tables) -> DataFrame:
    """The session machine with a timer that interrupts and one that reminds; silent users' timers fire at the watermark."""
    with timers.timer_state(t.spark):
        found = log.collected(timers.timed_machine(events_stream(t), "user_id", "ts", "event_id", "event_type", f"{CAP_S} seconds", dict(MOVES), TIMERS, "idle"), "append")
    return found.withColumnRenamed("key", "user_id")


@query("""WITH o AS (SELECT user_id, min(event_id) AS opened FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, event_id AS seq, greatest(opened, event_id) AS released_by FROM events JOIN o USING (user_id) WHERE event_type = 'purchase'""")
def stream_pending(t: Tables) -> DataFrame:
    return log.collected(log.pending(events_stream(t), "user_id", "event_id", "event_type", "signup", "purchase"), "append")


@query("SELECT event_id, event_id % 3 AS part FROM events")
def stream_retry(t: Tables) -> DataFrame:
    """The first attempt of every batch fails; each is written again in its place and no row is lost or doubled."""

    def fault(batch: int, attempt: int) -> None:
        if attempt == 0:
            raise OSError(f"batch {batch} fails once")

    folder = log.split(t.events.select("event_id", (F.col("event_id") % 3).alias("k")), F.col("k"), 3, FILES)
    return log.collected(log.stream_of_folder(t.spark, folder, FILES), "append", attempts=3, fault=fault).select("event_id", F.col("k").alias("part"))


@query("SELECT event_id % 4 AS part, count(*) AS rows, {} AS files, true AS alone FROM events GROUP BY 1".format(FILES))
def stream_backpressure(t: Tables) -> DataFrame:
    """A reader that asks for a part's files at a time gets a batch for each part: rows and files of each, and whether its batch held no other part."""
    folder = log.split(t.events.select("event_id"), F.col("event_id") % 4, 4, FILES)
    stream = log.stream_of_folder(t.spark, folder, FILES).select("event_id", F.col("_metadata.file_name").alias("file"))
    out = log.collected(stream, "append", number=True).withColumn("part", F.col("event_id") % 4)
    own = out.groupBy("batch").agg(F.count_distinct("part").alias("kinds"))
    return out.join(own, "batch").groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct("file").cast("int").alias("files"), F.every(F.col("kinds") == 1).alias("alone"))


@query("SELECT user_id AS producer, count(*) AS kept, count(*) + count(*) FILTER (WHERE event_id % 3 = 0) AS sent FROM events GROUP BY 1")
def stream_producer_dedup(t: Tables) -> DataFrame:
    """A producer that fails over sends a third of its messages again under their numbers; each is kept once."""
    e = t.events.select("user_id", "event_id", "ts")
    sent = e.withColumn("k", F.lit(0)).unionByName(e.where("event_id % 3 = 0").withColumn("k", F.lit(1)))
    stream = log.stream_of_folder(t.spark, log.split(sent, F.col("k"), 2, FILES), FILES).withColumn("at", F.col("ts").cast("timestamp"))
    kept = log.collected(log.first_of_each(stream, "event_id", "at", "60 days").select("user_id", "event_id"), "append").groupBy("user_id").agg(F.count("*").alias("kept"))
    return kept.join(sent.groupBy("user_id").agg(F.count("*").alias("sent")), "user_id").select(F.col("user_id").alias("producer"), "kept", "sent")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS deliveries, 1 AS applied FROM events")
def stream_outbox(t: Tables) -> DataFrame:
    """A relay crashes after it published the even messages and before it marked them; all are delivered, and applied once."""
    outbox, state = t.events.select("event_id", "event_type"), scratch(t.spark)
    log.relay(outbox.where("event_id % 2 = 0"), state, crash=True)
    log.relay(outbox, state)
    log.relay(outbox, state)
    delivered = t.spark.read.parquet(f"{state}/log").groupBy("event_id").agg(F.count("*").cast("int").alias("deliveries"))
    applied = t.spark.read.parquet(f"{state}/log").dropDuplicates(["event_id"]).groupBy("event_id").agg(F.count("*").cast("int").alias("applied"))
    return delivered.join(applied, "event_id")


@query("""WITH RECURSIVE w AS (SELECT event_id AS txn, user_id AS root, event_id % 6 AS expected, event_id % 4 AS batch FROM events), h AS (SELECT o_custkey AS root, count(*) AS seq FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
r AS (SELECT root, CAST(0 AS BIGINT) AS batch, CAST(coalesce(max(seq), 0) AS BIGINT) AS seq FROM (SELECT DISTINCT root FROM w) LEFT JOIN h USING (root) GROUP BY root
UNION ALL SELECT root, batch + 1, seq + CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.root = r.root AND w.batch = r.batch AND w.expected = r.seq) THEN 1 ELSE 0 END FROM r WHERE batch < 4),
j AS (SELECT w.*, r.seq, row_number() OVER (PARTITION BY w.root, w.batch, expected ORDER BY txn) AS k FROM w JOIN r USING (root, batch))
SELECT txn, root, CASE WHEN expected <> seq THEN 'conflict' WHEN k = 1 THEN 'applied' ELSE 'lost' END AS outcome, CASE WHEN expected = seq AND k = 1 THEN seq + 1 END AS seq FROM j""")
def stream_guarded_write(t: Tables) -> DataFrame:
    """Writes of a stream of four batches against the revisions that they expect; each batch leaves a delta of the revisions."""
    heads = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("root")).agg(F.count("*").alias("seq"))
    folder = log.split(t.events.select(F.col("event_id").alias("txn"), F.col("user_id").alias("root"), (F.col("event_id") % 6).alias("expected")), F.col("txn") % 4, 4, FILES)
    return log.guarded_writes(log.stream_of_folder(t.spark, folder, FILES), heads, every=3, buckets=4)


LEASE_S = 432_000


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST('' AS VARCHAR) AS action, false AS held, CAST(0 AS BIGINT) AS beat FROM events
UNION ALL SELECT user_id, i, event_id, CASE WHEN event_type = 'signup' THEN CASE WHEN live THEN 'busy' WHEN held THEN 'taken again' ELSE 'taken' END WHEN NOT live THEN 'stray'
 WHEN event_type = 'click' THEN 'beat' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'requeued' ELSE 'stray' END AS action,
 CASE WHEN event_type = 'signup' THEN true WHEN live AND event_type NOT IN ('purchase', 'error') THEN true ELSE false END AS held, CASE WHEN event_type = 'click' AND live OR event_type = 'signup' AND NOT live THEN moment ELSE beat END AS beat
FROM (SELECT r.user_id, o.i, o.event_id, o.event_type, o.moment, r.held, r.beat, r.held AND o.moment - r.beat <= {LEASE_S * 1_000_000} AS live FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT event_id, action FROM r WHERE i > 0""")
def stream_jobs(t: Tables) -> DataFrame:
    """A consumer with one job in hand: taken, kept by heartbeats, done or given back; without a beat for the lease it is lost and may be taken again."""

    def step(state: tuple, row: tuple) -> tuple:
        held, beat = state
        event, kind, at = row
        live = held and at - beat <= LEASE_S * 1_000_000
        if kind == "signup":
            action = "busy" if live else "taken again" if held else "taken"
        elif not live:
            action = "stray"
        else:
            action = {"click": "beat", "purchase": "done", "error": "requeued"}.get(kind, "stray")
        now = kind == "signup" or live and kind not in ("purchase", "error")
        beat = at if kind == "click" and live or kind == "signup" and not live else beat
        return (now, beat), (event, action)

    rows = t.events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return fold.ordered_fold(rows, ["user_id"], ["event_id"], ["event_id", "event_type", "at"], lambda row: (False, 0), step, "event_id long, action string")


@query("""WITH RECURSIVE n AS (SELECT user_id, event_type AS state, value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
e AS (SELECT DISTINCT user_id || '/' || state AS a, user_id || '/' || next AS b FROM n WHERE value < 4 AND next IS NOT NULL), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS node FROM r WHERE a = b""")
def protocol_contractive(t: Tables) -> DataFrame:
    """States of a user's protocol, as their events follow each other, that come back to themselves without a message (a value of 4 or more): it is not contractive."""
    steps = t.events.select("user_id", F.col("event_type").alias("state"), "value", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    silent = steps.where("value < 4 AND next IS NOT NULL").select(F.concat_ws("/", F.col("user_id").cast("string"), "state").alias("child"), F.concat_ws("/", F.col("user_id").cast("string"), "next").alias("parent"))
    return graph.cyclic(silent.distinct())


@query("""WITH RECURSIVE c AS (SELECT DISTINCT n_regionkey AS a, n_nationkey % 7 AS b FROM nation WHERE n_nationkey % 7 <> n_regionkey), r AS (SELECT a, b FROM c UNION SELECT r.a, c.b FROM r JOIN c ON c.a = r.b) SELECT a AS node FROM r WHERE a = b""")
def protocol_calls(t: Tables) -> DataFrame:
    """Protocols that call themselves through others."""
    calls = t.nation.select(F.col("n_regionkey").alias("child"), (F.col("n_nationkey") % 7).alias("parent")).where("child <> parent").distinct()
    return graph.cyclic(calls)


@query("""WITH RECURSIVE mv AS (SELECT p_brand AS protocol, CAST(p_partkey % 2 AS VARCHAR) AS state, p_type AS event, CAST((min(p_partkey) // 2) % 2 AS VARCHAR) AS next FROM part WHERE p_size <= 12 GROUP BY 1, 2, 3),
st AS (SELECT protocol, state FROM mv UNION SELECT protocol, next FROM mv),
bad AS (SELECT a.protocol AS sub, a.state AS x, t.protocol AS super, t.state AS y FROM st a, mv t WHERE NOT EXISTS (SELECT 1 FROM mv m WHERE m.protocol = a.protocol AND m.state = a.state AND m.event = t.event)
 UNION SELECT m.protocol, m.state, t.protocol, t.state FROM bad b JOIN mv m ON m.protocol = b.sub AND m.next = b.x JOIN mv t ON t.protocol = b.super AND t.next = b.y AND t.event = m.event)
SELECT a.protocol AS sub, b.protocol AS super FROM st a, st b WHERE a.state = '0' AND b.state = '0' AND NOT EXISTS (SELECT 1 FROM bad WHERE sub = a.protocol AND x = '0' AND super = b.protocol AND y = '0')""")
def protocol_subtypes(t: Tables) -> DataFrame:
    """Brands' protocols, whose messages are types of small parts, that can stand for others: from the start on they accept all that the other does."""
    of = t.part.where("p_size <= 12").groupBy(F.col("p_brand").alias("protocol"), (F.col("p_partkey") % 2).cast("string").alias("state"), F.col("p_type").alias("event"))
    return paths.simulations(of.agg(F.expr("cast((min(p_partkey) div 2) % 2 as string)").alias("next")), "0")
