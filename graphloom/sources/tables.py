"""The data folder as DataFrames, and the graph-shaped views of it that the queries share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch

_REMEMBERED: dict[tuple[str, str, str, str], object] = {}
_STORED: dict[tuple[str, str, str, str], str] = {}


def cents(amount: Column) -> Column:
    """Money in doubles as whole cents."""
    return F.round(amount * 100).cast("long")


class Tables:
    """``tables.orders`` reads that table; column pruning and filters reach its scan."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str, build: Callable[[], DataFrame], by: str | None = None, of: tuple[str, ...] = ()) -> str:
        """Folder of a table that is written once a session in the shared folder, in folders of the values of ``by``.

        It is written anew when a file of the tables ``of`` has another time or size than before.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, self.files(of) if of else "")
        if key not in _STORED:
            folder = scratch(self.spark)
            made = build()
            writer = (made.hint("rebalance", by) if by else made).write  # a value with a large part of all rows is many tasks
            (writer.partitionBy(by) if by else writer).parquet(folder)
            _STORED[key] = folder
        return _STORED[key]

    def remembered(self, name: str, build: Callable[[], object], of: tuple[str, ...]) -> object:
        """A small value that is made once a session, and again when a file of the tables ``of`` changes."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, self.files(of))
        if key not in _REMEMBERED:
            _REMEMBERED[key] = build()
        return _REMEMBERED[key]

    def files(self, tables: tuple[str, ...]) -> str:
        """Paths, times and sizes of the tables' files, from their file system; nothing is read."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        found = []
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{table}.parquet")
            listed = path.getFileSystem(conf).listFiles(path, True)
            while listed.hasNext():
                status = listed.next()
                found.append(f"{status.getPath()} {status.getModificationTime()} {status.getLen()}")
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        """An inline table."""
        return self.spark.createDataFrame(rows, schema)

    def account_edges(self) -> DataFrame:
        """child, parent: ALL over regions over nations over customers."""
        region = self.region.select(F.concat(F.lit("R"), "r_regionkey").alias("child"), F.lit("ALL").alias("parent"))
        nation = self.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
        customer = self.customer.select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
        return region.unionByName(nation).unionByName(customer)

    def account_paths(self) -> DataFrame:
        """desc, anc, depth of the account tree, each account at depth 0 under itself.

        The tree has fixed levels, so that joins on keys replace a recursive closure.
        """
        nation = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        of_nation = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("n"), F.concat(F.lit("R"), "r_regionkey").alias("r"), "n_nationkey")
        customers = self.customer.join(of_nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.array(F.concat(F.lit("C"), "c_custkey"), "n", "r", F.lit("ALL")).alias("path"))
        nations = of_nation.select(F.array("n", "r", F.lit("ALL")).alias("path"))
        regions = self.region.select(F.array(F.concat(F.lit("R"), "r_regionkey"), F.lit("ALL")).alias("path"))
        root = self.spark.range(0, 1, 1, 1).select(F.array(F.lit("ALL")).alias("path"))
        paths = customers.unionByName(nations).unionByName(regions).unionByName(root)
        return paths.select(F.col("path")[0].alias("desc"), F.posexplode("path").alias("depth", "anc"))

    def postings(self) -> DataFrame:
        """account, pos, amount (cents), credit, delta (signed), kind and period (month) of each order."""
        credit = F.col("o_orderpriority") == "1-URGENT"
        amount = cents(F.col("o_totalprice"))
        return self.orders.select(
            F.concat(F.lit("C"), "o_custkey").alias("account"), F.col("o_orderkey").alias("pos"), amount.alias("amount"), credit.alias("credit"),
            F.when(credit, amount).otherwise(-amount).alias("delta"), F.col("o_orderstatus").alias("kind"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        )

    def quads(self) -> DataFrame:
        """Nations, regions and customers as quads (g, s, p, o, o_kind, o_dt, o_lang)."""
        none = F.lit(None).cast("string")

        def triples(df: DataFrame, g: str, s: Column, p: str, o: Column, kind: str, dt: str | None = None) -> DataFrame:
            return df.select(F.lit(g).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), (F.lit(dt) if dt else none).alias("o_dt"), none.alias("o_lang"))

        region, nation, customer = self.region, self.nation, self.customer
        r, n, c = F.concat(F.lit("R"), "r_regionkey"), F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("C"), "c_custkey")
        parts = [
            triples(region, "geo", r, "type", F.lit("Region"), "iri"), triples(region, "geo", r, "label", F.col("r_name"), "literal", "string"),
            triples(nation, "geo", n, "type", F.lit("Nation"), "iri"), triples(nation, "geo", n, "label", F.col("n_name"), "literal", "string"),
            triples(nation, "geo", n, "partOf", F.concat(F.lit("R"), "n_regionkey"), "iri"),
            triples(customer, "party", c, "type", F.lit("Customer"), "iri"), triples(customer, "party", c, "partOf", F.concat(F.lit("N"), "c_nationkey"), "iri"),
            triples(customer, "party", c, "segment", F.col("c_mktsegment"), "literal", "string"),
            triples(customer, "party", c, "balance", cents(F.col("c_acctbal")), "literal", "integer"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


# DuckDB SQL of the same views, for the oracles.
EDGES = """edge AS (SELECT 'R' || r_regionkey AS child, 'ALL' AS parent FROM region UNION ALL
  SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)"""
PATHS = EDGES + """, path AS (SELECT DISTINCT child AS "desc", child AS anc, 0 AS depth FROM (SELECT child FROM edge UNION ALL SELECT 'ALL')
  UNION ALL SELECT p."desc", e.parent, p.depth + 1 FROM path p JOIN edge e ON e.child = p.anc)"""
POSTINGS = """posting AS (SELECT 'C' || o_custkey AS account, o_orderkey AS pos, CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
  o_orderpriority = '1-URGENT' AS credit,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS delta,
  o_orderstatus AS kind, strftime(o_orderdate, '%Y-%m') AS period FROM orders)"""
QUADS = """quad AS (
  SELECT 'geo' AS g, 'R' || r_regionkey AS s, 'type' AS p, 'Region' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM region
  UNION ALL SELECT 'geo', 'R' || r_regionkey, 'label', r_name, 'literal', 'string', NULL FROM region
  UNION ALL SELECT 'geo', 'N' || n_nationkey, 'type', 'Nation', 'iri', NULL, NULL FROM nation
  UNION ALL SELECT 'geo', 'N' || n_nationkey, 'label', n_name, 'literal', 'string', NULL FROM nation
  UNION ALL SELECT 'geo', 'N' || n_nationkey, 'partOf', 'R' || n_regionkey, 'iri', NULL, NULL FROM nation
  UNION ALL SELECT 'party', 'C' || c_custkey, 'type', 'Customer', 'iri', NULL, NULL FROM customer
  UNION ALL SELECT 'party', 'C' || c_custkey, 'partOf', 'N' || c_nationkey, 'iri', NULL, NULL FROM customer
  UNION ALL SELECT 'party', 'C' || c_custkey, 'segment', c_mktsegment, 'literal', 'string', NULL FROM customer
  UNION ALL SELECT 'party', 'C' || c_custkey, 'balance', CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR), 'literal', 'integer', NULL FROM customer)"""
