"""Named graphs in a folder: write, read, list, drop, count; publication by digest; rendered text; an in-memory sink.

Each graph is a folder of Parquet files named by its percent-encoded name, so that a write of one
graph touches no other and the names are the listing.
"""

from __future__ import annotations

import urllib.parse
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch


class GraphStore:
    """Graphs (DataFrames of triples) by name in a shared folder, with a manifest of versions that is only appended."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or scratch(spark)
        self.written: dict[str, str] = {}

    def put(self, name: str, graph: DataFrame) -> None:
        """Replace a graph: written whole under a new folder, then named, so that readers see the old or the new one."""
        path = f"{self.folder}/{urllib.parse.quote(name, safe='')}/{uuid.uuid4().hex}"
        graph.write.parquet(path)
        self.written[name] = path

    def get(self, name: str) -> DataFrame:
        """A graph; KeyError for a name that is not there."""
        return self.spark.read.parquet(self.written[name])

    def names(self) -> list[str]:
        return sorted(self.written)

    def drop(self, name: str) -> None:
        del self.written[name]

    def count(self, name: str) -> int:
        return self.get(name).count()

    def dataset(self) -> DataFrame:
        """All graphs as one, with the column g."""
        out = None
        for name in self.names():
            graph = self.get(name).withColumn("g", F.lit(name))
            out = graph if out is None else out.unionByName(graph)
        if out is None:
            raise ValueError("the store is empty")
        return out


def digest_tree(rows: DataFrame, keys: list[str], row: str) -> DataFrame:
    """keys, digest, n of the multiset of the texts ``row``: SHA-256 over sorted hashes in two levels.

    The rows' hashes are sorted and hashed by their first four hex digits, and those digests in the
    order of the digits, so that no array holds more than a 65,536th of a group's rows, or 65,536 digests.
    """

    def joined(part: str) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ""), 256)

    leaf = rows.select(*keys, F.sha2(F.col(row).cast("string"), 256).alias("h")).withColumn("p", F.substring("h", 1, 4))
    four = leaf.groupBy(*keys, "p").agg(joined("h").alias("d"), F.count("*").alias("n")).withColumn("h", F.concat("p", "d"))
    return four.groupBy(*keys).agg(joined("h").alias("digest"), F.sum("n").alias("n"))


def digest_tree_sql(rows: str, keys: list[str]) -> str:
    """DuckDB CTEs up to ``tree`` (keys, digest, n) for a query that gives the keys and ``row``."""
    k = "".join(f"{x}, " for x in keys)
    by = " GROUP BY " + ", ".join([*keys, "p"])
    last = " GROUP BY " + ", ".join(keys) if keys else ""
    return (
        f"leaf AS (SELECT {k}sha256(row) AS h FROM ({rows})), four AS (SELECT {k}substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM leaf{by}), "
        f"tree AS (SELECT {k}sha256(string_agg(p || d, '' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM four{last})"
    )


def digest_bag(rows: DataFrame, keys: list[str], row: str) -> DataFrame:
    """keys, digest of the multiset of the texts ``row``: SHA-256 over two sums of 60 bits of the rows' hashes and their count.

    Sums need no order, so that it is one partial aggregate, and a group of any size is three numbers.
    """
    hashed = rows.select(*keys, F.sha2(F.col(row).cast("string"), 256).alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_s{k}") for k in (0, 1)]
    found = hashed.groupBy(*keys).agg(*sums, F.count("*").cast("string").alias("_n"))
    return found.select(*keys, F.sha2(F.concat_ws("|", "_s0", "_s1", "_n"), 256).alias("digest"))


def digest_bag_sql(rows: str, keys: list[str]) -> str:
    """DuckDB CTEs up to ``bag`` (keys, digest) for a query that gives the keys and ``row``."""
    k = ", ".join(keys)
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in (0, 1))
    return f"hashed AS (SELECT {k}, sha256(row) AS h FROM ({rows})), bag AS (SELECT {k}, sha256(concat_ws('|', {sums}, CAST(count(*) AS VARCHAR))) AS digest FROM hashed GROUP BY {k})"


def published(rows: DataFrame, folder: str, row: str) -> str:
    """Write rows to a folder named by their digest and return it; rows that are there already are not written again."""
    found = digest_tree(rows, [], row).first()
    path = f"{folder}/{found['digest'] if found else 'empty'}"
    rows.write.mode("ignore").parquet(path)
    return path



class MemorySink:
    """A sink that holds what is written to it as a cached view, until it is closed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.views = spark, []

    def write(self, name: str, triples: DataFrame) -> DataFrame:
        view = f"graphloom_{name}_{uuid.uuid4().hex[:8]}"
        triples.cache().createOrReplaceTempView(view)
        self.views.append(view)
        return self.spark.table(view)

    def close(self) -> None:
        for view in self.views:
            self.spark.table(view).unpersist()
            self.spark.catalog.dropTempView(view)
        self.views = []
