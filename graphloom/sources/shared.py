"""The shared folder for intermediate data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or the one set on the context.

    Only a session on one machine (local master) gets a temporary folder where none is named; on a
    cluster the executors could not see it, so that this raises RuntimeError there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate tables in the session's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the session's shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a table in the session's shared folder.

    For loops of many rounds: the plan of a checkpoint keeps the statistics and constraints of the plan
    before it, which grow from round to round; a table has its own size, by which joins are chosen.
    """
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
