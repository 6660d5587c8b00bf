"""Nearest vectors by cosine over inverted lists.

Centroids are k-means of a bounded sample; every row goes to the list of its nearest one. A query visits the lists
of its PROBES nearest centroids and is compared with all rows there, exactly. Lists are dealt out in blocks of
about BLOCK rows, so that a list with a third of all rows is many tasks; a block gives k rows for
each of its queries, and the best k of all blocks stay. What is missed is only what lies in lists not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import written

#: Rows that the centroids are learned from, in the order of a hash of their id.
SAMPLE = 20_000
#: Most centroids; below that their number is about the root of the rows.
CENTROIDS = 1024
ROUNDS = 8
PROBES = 12
BLOCK = 4096
#: Similarities held at once.
_CELLS = 1 << 22


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def centroids(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of n clusters of the rows of x (unit vectors): k-means by cosine from rows spread over x."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(x[k : k + 4096] @ c.T).argmax(axis=1) for k in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where((np.bincount(own, minlength=n) > 0)[:, None], unit(sums), c)
    return c


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as rows; others and nulls as zeros."""
    found = np.zeros((len(column), width))
    for k, v in enumerate(column):
        row = v.as_py() if v.is_valid else None
        if row is not None and len(row) == width and None not in row:
            found[k] = row
    return found


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, probes: int = PROBES) -> DataFrame:
    """query, key, similarity (cosine, rounded to 6), rank of the k nearest rows for each row of ``queries``, itself left out.

    Both tables: ``key`` (an integer, its own row's) and ``vector``, of the length of the sample's first; rows without
    such a vector, or of zeros, are near to none. Ties go by key. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    total = rows.count()
    near = (F.pmod(F.xxhash64("id"), F.lit(1 << 32)) / float(1 << 32)) <= (1.2 * SAMPLE + 100) / max(total, 1)
    sample = rows.where(near).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    if not sample.num_rows:
        return spark.createDataFrame([], "query long, id long, similarity double, rank int").withColumnRenamed("id", key)
    width = len(sample["v"][0])
    x = unit(_matrix(sample["v"].combine_chunks(), width))
    x = x[(x != 0).any(axis=1)] if (x != 0).any() else x[:1]
    n = int(min(CENTROIDS, max(1, round(total**0.5)), len(x)))
    sent = spark.sparkContext.broadcast(centroids(x, n))  # CENTROIDS rows at most

    def placed(visits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            for batch in batches:
                x = unit(_matrix(batch.column(1), c.shape[1]))
                kept = np.flatnonzero((x != 0).any(axis=1))
                m = min(visits, len(c))
                cells = np.argpartition(-(x[kept] @ c.T), m - 1, axis=1)[:, :m] if len(kept) else np.zeros((0, m), int)
                flat = np.repeat(kept, m)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat)), pa.array(cells.reshape(-1), pa.int32()), pa.array(list(x[flat].astype(np.float64)), pa.list_(pa.float64()))], ["id", "cell", "v"])

        return run

    lists = written(rows.mapInArrow(placed(1), "id long, cell int, v array<double>"))
    blocks = lists.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each centroid
    stored = lists.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    visits = asked.mapInArrow(placed(probes), "id long, cell int, v array<double>").join(F.broadcast(blocks), "cell")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def compare(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if q.empty or s.empty:
            return pd.DataFrame({"query": [], "id": [], "similarity": []}).astype({"query": "int64", "id": "int64", "similarity": "float64"})
        s = s.sort_values("id")
        ids, y, qs, x = s["id"].to_numpy(), np.stack(s["v"]), q["id"].to_numpy(), np.stack(q["v"])
        out, step = [], max(1, _CELLS // len(ids))
        for i in range(0, len(qs), step):
            sim = np.round(x[i : i + step] @ y.T, 6)
            sim[ids[None, :] == qs[i : i + step, None]] = -np.inf
            m = min(k, len(ids))
            # ids rise, so that a stable order of falling similarity breaks ties by id
            best = np.argsort(-sim, axis=1, kind="stable")[:, :m]
            value = np.take_along_axis(sim, best, axis=1)
            real = value > -np.inf
            out.append(pd.DataFrame({"query": np.repeat(qs[i : i + step], m)[real.reshape(-1)], "id": ids[best][real], "similarity": value[real]}))
        return pd.concat(out)

    found = visits.select("cell", "block", "id", "v").groupBy("cell", "block").cogroup(stored.select("cell", "block", "id", "v").groupBy("cell", "block")).applyInPandas(compare, "query long, id long, similarity double")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")  # k rows for each block visited
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", F.col("id").alias(key), "similarity", "rank")
