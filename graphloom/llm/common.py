"""Session helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.sources.shared import checkpointed, scratch, shared_folder  # noqa: F401  the operators take them from here

from .textvec import let_go, release


def unused(columns: list[str], name: str) -> str:
    """``name``, or with underscores added a name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str, *within: str) -> Column:
    """A column by its very name, whatever characters it has; ``within``: the struct that holds it."""
    return F.col(".".join(f"`{n.replace('`', '``')}`" for n in (*within, name)))


def whole(docs: DataFrame, name: str = "doc") -> Column:
    """All columns of docs as one struct, so that no name of theirs meets one of an operator's."""
    return F.struct(*[column(c) for c in docs.columns]).alias(name)


def unpacked(found: DataFrame, columns: list[str], name: str = "doc") -> DataFrame:
    """The columns that ``whole`` has put into the struct ``name``."""
    return found.select(*[column(c, name).alias(c) for c in columns])


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of crc32(doc_id as text) modulo ``parts``; null ids fall in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, label: str, cap: int) -> DataFrame:
    """doc_id and ``label`` of at most ``cap`` ids for each value of ``label``, in the order of a hash of doc_id.

    A first cut by the hash, from the (approximate) numbers of distinct ids, keeps about twice the cap,
    so that the ranking never meets all rows of a label; an id that repeats counts once. Rows with a
    null label or id don't count; other columns are ignored.
    """
    known = df.select(F.col("doc_id").alias("doc_id"), column(label).alias("label")).where("label is not null and doc_id is not null")
    counts = known.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    near = known.join(F.broadcast(counts), "label").where(place <= (2.0 * cap + 100) / F.col("n")).select("doc_id", "label").distinct()  # counts: a row for each label
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return near.withColumn("r", rank).where(F.col("r") <= cap).select("doc_id", F.col("label").alias(label))


def sampled_texts(texts: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """doc_id, the other column of ``chosen`` and one text for each row of ``chosen`` (a bounded_sample).

    Of an id's texts, which may be a third of all rows, the one of the least hash counts; it is
    found by a partial aggregate, so that a task passes on one row for each chosen id.
    """
    met = texts.join(F.broadcast(chosen), on)  # chosen: bounded for each label
    least = met.groupBy(*chosen.columns).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))).alias("least"))
    return least.select(*chosen.columns, "least.text")


def map_text(docs: DataFrame, keep: list[str | Column], fields: str, compute: Callable[[pa.Array], list[pa.Array]], at: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of docs and, from their column text, the columns of ``fields`` that ``compute`` returns.

    One Arrow pass without a shuffle; the text itself is passed on only if ``keep`` has it. A
    column of ``keep`` whose name is one of ``fields`` gives way to the computed one. ``at`` names the
    struct in ``keep`` and the field of it that hold the text already, which then is not sent twice.
    """
    added = StructType.fromDDL(fields).fields
    new = {f.name.lower() for f in added}
    inner = unused([f.name for f in added], "kept")  # one struct: Arrow functions take no names that need quoting
    kept = F.struct(*[column(c) if isinstance(c, str) else c for c in keep]).alias(inner)
    at = at if docs.schema["text"].dataType.typeName() == "string" else ()
    rows = docs.select(kept) if at else docs.select(kept, F.col("text").cast("string").alias("text"))
    held = rows.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            text = batch.columns[-1]
            for name in at:
                text = text.field(name)
            yield pa.RecordBatch.from_arrays([batch.columns[0], *compute(text)], [inner, *(f.name for f in added)])
        release()

    found = rows.mapInArrow(run, StructType([held, *added]))
    own = [column(c, inner).alias(c) for c in held.dataType.names if c.lower() not in new]
    return found.select(*own, *[f.name for f in added])
