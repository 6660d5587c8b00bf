"""Ordered logs as Structured Streaming queries.

``collected`` runs a streaming plan over all that its source has (trigger availableNow) and
returns what it wrote; a long-running deployment starts the same plan with its own trigger and
sink. Offsets and state are checkpointed in the shared folder, so that a lost executor or a
restarted driver goes on from the last batch, and a batch written twice is written once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators import versions
from graphloom.sources.shared import scratch

from . import deltas


def stream_of(spark: SparkSession, folder: str, table: str, files_at_once: int = 8) -> DataFrame:
    """A table of the data folder as a stream of its files; a bound on files is the back-pressure."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    # A stream reads folders. A table in one file is picked out of its folder by name; where the table is a folder
    # itself, its files are named by another folder level, which the first read shows.
    first = spark.read.parquet(path).inputFiles()[0].rstrip("/")
    if first.endswith(f"/{table}.parquet"):
        rows = reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    else:
        rows = reader.parquet(path)
    return rows.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else f.name for f in schema])


def collected(stream: DataFrame, mode: str, attempts: int = 1, fault: Callable[[int, int], None] | None = None, number: bool = False) -> DataFrame:
    """All that the plan gives for the data at hand: the last complete result, or all appended rows.

    A batch that fails is written again in its place, up to ``attempts`` times, before the next one
    begins, so that order is kept. ``fault(batch, attempt)`` is called before each write and may
    raise, for trials. With ``number``, rows keep their batch's number.
    """
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(attempts):
            try:
                if fault:
                    fault(batch_id, attempt)
                # The batch's number names its folder: a repeated batch overwrites itself.
                batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
                return
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(min(1.0, 0.1 * 2**attempt))

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out if number else out.drop("batch")


def split(rows: DataFrame, part: Column, parts: int, files: int = 1) -> str:
    """A folder of ``parts`` tables by the number ``part``, each of ``files`` files, that a stream takes in turn.

    The rows are read once; parts are laid out one after the other, since a stream takes files by their time.
    Raises ValueError for a part with fewer rows than files.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    rows.withColumn("part", part.cast("int")).write.partitionBy("part").parquet(f"{folder}/all")
    for k in range(parts):
        spark.read.schema(rows.schema).parquet(f"{folder}/all/part={k}").repartition(files).write.parquet(f"{folder}/parts/part={k}")
        if len(spark.read.schema(rows.schema).parquet(f"{folder}/parts/part={k}").inputFiles()) != files:
            raise ValueError(f"part {k} has fewer rows than its {files} files")
    return f"{folder}/parts"


def stream_of_folder(spark: SparkSession, folder: str, files_at_once: int) -> DataFrame:
    """The files of a folder's folders as a stream, so many at once: a reader asks for no more than that before it has written them."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder).drop("part")


def relay(outbox: DataFrame, state: str, crash: bool = False) -> None:
    """Publish the outbox's rows (id first) that are not marked as published, then mark them: at least once each.

    A crash between the two leaves them unmarked, and the next run publishes them again.
    """
    spark, key = outbox.sparkSession, outbox.columns[0]
    try:
        marked = spark.read.parquet(f"{state}/marked")
    except AnalysisException:
        marked = outbox.select(key).limit(0)
    pending = outbox.join(marked, key, "left_anti")
    run = uuid.uuid4().hex
    pending.write.parquet(f"{state}/log/run={run}")
    if not crash:
        spark.read.parquet(f"{state}/log").where(F.col("run") == run).select(key).write.mode("append").parquet(f"{state}/marked")


def guarded_writes(stream: DataFrame, heads: DataFrame, every: int = deltas.EVERY, buckets: int = deltas.BUCKETS, fault: Callable[[int], None] | None = None, folder: str | None = None) -> DataFrame:
    """txn, root, outcome, seq of writes (txn, root, expected): each batch reads the revisions of its roots, decides and writes new ones.

    Revisions are a table with deltas, so that a batch costs its own roots; a batch that is repeated
    decides the same. ``fault(batch)`` is called when a batch has written and before it is marked as
    done, and may raise, for trials; a run with the same ``folder`` then goes on.
    """
    spark, folder = stream.sparkSession, folder or scratch(stream.sparkSession)
    kept = deltas.Deltas(spark, f"{folder}/heads", heads.select("root", "seq"), "root", every, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select("txn", "root", "expected")
        versions.compare_and_set(kept.of(batch_id, asked), asked).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        won = spark.read.parquet(f"{folder}/out/batch={batch_id}").where("outcome = 'applied'").groupBy("root").agg(F.max("seq").alias("seq"))
        kept.put(batch_id, won)
        if fault:
            fault(batch_id)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def first_of_each(stream: DataFrame, key: str, at: str, cap: str) -> DataFrame:
    """One row for each command id; ids are forgotten once the watermark is past their time by ``cap``."""
    return stream.withWatermark(at, cap).dropDuplicatesWithinWatermark([key])


def per_window(stream: DataFrame, at: str, width: str, cap: str, keys: list[str]) -> DataFrame:
    """keys, start, n of tumbling windows. In append mode a window is given once, when it is past the watermark by ``cap``, its
    state goes, and rows that come later than that are dropped; in complete mode all windows stay."""
    g = stream.withWatermark(at, cap).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), "n")


def per_session(stream: DataFrame, at: str, gap: str, cap: str, keys: list[str]) -> DataFrame:
    """keys, start, n of sessions that end after a gap."""
    g = stream.withWatermark(at, cap).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), "n")


def machine(stream: DataFrame, key: str, seq: str, event: str, step: Callable[[str, str], str], start: str) -> DataFrame:
    """key, seq, before, after: a state machine for each key over its events in the order of ``seq`` within a batch.

    Batches must come in order, as a partitioned log gives them. The state is the name of one state.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        rows = sorted((int(s), e) for f in frames for s, e in zip(f[seq], f[event], strict=True))
        out = []
        for s, e in rows:
            after = step(now, e)
            out.append((k[0], s, now, after))
            now = after
        state.update((now,))
        yield pd.DataFrame(out, columns=[key, "seq", "before", "after"])

    return stream.select(key, seq, event).groupBy(key).applyInPandasWithState(run, f"{key} long, seq long, before string, after string", "state string", "append", GroupStateTimeout.NoTimeout)


def overdue(stream: DataFrame, key: str, seq: str, at: str, limit_s: int) -> DataFrame:
    """key, seq, waited_s of events that came more than ``limit_s`` seconds after the one before of their key."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = sorted((int(s), t) for f in frames for s, t in zip(f[seq], f["_at"], strict=True))
        out = []
        for s, t in rows:
            if last is not None and t - last > limit_s * 1_000_000:
                out.append((k[0], s, (t - last) // 1_000_000))
            last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "seq", "waited_s"])

    timed = stream.select(key, seq, F.unix_micros(at).alias("_at"))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} long, seq long, waited_s long", "last long", "append", GroupStateTimeout.NoTimeout)


def pending(stream: DataFrame, key: str, seq: str, event: str, opens: str, waits: str) -> DataFrame:
    """key, seq, released_by: messages ``waits`` queue until the first ``opens`` of their key lets them go; later ones pass at once."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, queue = (state.get[0], list(state.get[1])) if state.exists else (-1, [])
        rows = sorted((int(s), e) for f in frames for s, e in zip(f[seq], f[event], strict=True))
        out = []
        for s, e in rows:
            if e == opens and opened < 0:
                opened = s
                out += [(k[0], q, s) for q in queue]
                queue = []
            elif e == waits:
                if opened < 0:
                    queue.append(s)
                else:
                    out.append((k[0], s, s))
        state.update((opened, queue))
        yield pd.DataFrame(out, columns=[key, "seq", "released_by"])

    return stream.select(key, seq, event).groupBy(key).applyInPandasWithState(run, f"{key} long, seq long, released_by long", "opened long, queue array<long>", "append", GroupStateTimeout.NoTimeout)
