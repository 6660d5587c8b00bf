"""Scans, projections, filters, joins, aggregates, orders, set operations and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import canonical, graph, paths, relational
from graphloom.sources import paths as source_paths
from graphloom.sources.shared import scratch
from graphloom.sources.store import digest_tree, digest_tree_sql
from graphloom.sources.tables import EDGES, PATHS, POSTINGS, QUADS, Tables, cents

from .registry import query

# ---- scans ----


@query(f"WITH {QUADS} SELECT * FROM quad WHERE p = 'label'")
def scan_quads(t: Tables) -> DataFrame:
    return t.quads().where("p = 'label'")


@query(f"WITH {QUADS} SELECT 'reference' AS g, s, p, o FROM quad WHERE g = 'geo'")
def scan_reference(t: Tables) -> DataFrame:
    return t.quads().where("g = 'geo'").select(F.lit("reference").alias("g"), "s", "p", "o")


@query(f"""WITH {QUADS}, sub(c, super) AS (VALUES ('Region', 'Place'), ('Nation', 'Place'), ('Place', 'Place'))
SELECT DISTINCT s AS instance FROM quad JOIN sub ON o = c WHERE p = 'type' AND super = 'Place'""")
def scan_class_extent(t: Tables) -> DataFrame:
    classes = graph.closure(t.values([("Region", "Place"), ("Nation", "Place")], "child string, parent string")).where("anc = 'Place'").select(F.col("desc").alias("o"))
    return t.quads().where("p = 'type'").join(classes.union(t.values([("Place",)], "o string")), "o", "left_semi").select(F.col("s").alias("instance")).distinct()


@query("SELECT p_brand AS member FROM part UNION SELECT p_type FROM part")
def scan_scheme_members(t: Tables) -> DataFrame:
    part = t.part
    return part.select(F.col("p_brand").alias("member")).union(part.select("p_type")).distinct()


@query(f"""WITH {EDGES}, enum(member) AS (VALUES ('N1'), ('N2')), ext AS (SELECT child AS member FROM edge WHERE parent = 'R0')
SELECT 'enumerated' AS kind, member FROM enum UNION ALL SELECT 'direct', member FROM ext""")
def scan_population(t: Tables) -> DataFrame:
    listed = t.values([("enumerated", "N1"), ("enumerated", "N2")], "kind string, member string")
    return listed.unionByName(t.account_edges().where("parent = 'R0'").select(F.lit("direct").alias("kind"), F.col("child").alias("member")))


@query(f"WITH {POSTINGS} SELECT period, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM posting WHERE period IN ('1996-01', '1996-02') GROUP BY period")
def scan_partition_pruned(t: Tables) -> DataFrame:
    # The period's bounds are put on the stored column too, so that row groups outside are skipped.
    within = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-03-01").cast("timestamp"))
    rows = t.orders.where(within).select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), cents(F.col("o_totalprice")).alias("amount"))
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(f"WITH {QUADS} SELECT DISTINCT g FROM quad")
def scan_graph_names(t: Tables) -> DataFrame:
    return t.quads().select("g").distinct()


@query(f"""WITH {QUADS}, """ + digest_tree_sql("""SELECT g, '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '"' || o || '"' END AS row FROM quad""", ["g"]) + " SELECT g, digest, n FROM tree")
def snapshot_digest(t: Tables) -> DataFrame:
    """A digest of each graph's canonical lines, as a tree over their hashes: no graph is gathered whole."""
    term = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), "o", F.lit('"')))
    lines = t.quads().select("g", F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), term).alias("line"))
    return digest_tree(lines, ["g"], "line").select("g", "digest", F.col("n").cast("long").alias("n"))


@query("""WITH line AS (SELECT l_orderkey AS g, min(l_returnflag) || min(l_linestatus) || min(l_linenumber) % 4 AS row FROM lineitem GROUP BY l_orderkey, l_partkey), kind AS (SELECT g, string_agg(row, ',' ORDER BY row) AS rows, count(*) AS lines FROM line GROUP BY 1)
SELECT g, min(g) OVER (PARTITION BY o_orderstatus, rows) AS same_as, 1 + 4 * lines AS n FROM kind JOIN orders ON o_orderkey = g""")
def graph_canonical(t: Tables) -> DataFrame:
    """Orders and their parts as graphs of blank nodes, each with the first graph that has its canonical digest: the same but for names."""
    rows = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber")])
    order, line = F.concat(F.lit("o"), "l_orderkey"), F.concat_ws(" ", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    values = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "place": (F.col("l_linenumber") % 4).cast("string")}
    parts = F.array(F.struct(order.alias("s"), F.lit("line").alias("p"), line.alias("o"), F.lit(True).alias("o_blank")), *[F.struct(line.alias("s"), F.lit(p).alias("p"), v.alias("o"), F.lit(False).alias("o_blank")) for p, v in values.items()])
    lines = rows.select(F.col("l_orderkey").alias("g"), F.inline(parts))
    heads = t.orders.join(t.lineitem.select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("g"), F.concat(F.lit("o"), "o_orderkey").alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o"), F.lit(False).alias("o_blank"))
    found = canonical.graph_digests(lines.unionByName(heads).withColumn("s_blank", F.lit(True)))
    first = found.groupBy("digest").agg(F.min("g").alias("same_as"))
    return found.join(first, "digest").select("g", "same_as", "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def src_json_path(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k >= 50")


def nested_orders(t: Tables) -> DataFrame:
    """o_orderkey and the order as JSON and as XML: its lines with a part and, of a returned line, two tags. Every 19th text is cut off."""
    tags = F.when(F.col("l_returnflag") == "R", F.array(F.col("l_linestatus"), F.lit("back"))).otherwise(F.array().cast("array<string>"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("_no"), F.col("l_partkey").alias("part"), tags.alias("tag")))).alias("line"))  # the lines of an order
    whole = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("order", F.struct(F.col("o_orderstatus").alias("status"), "line"))
    cut = F.col("o_orderkey") % 19 == 0
    json, xml = F.to_json("order"), F.to_xml("order", {"rowTag": "order", "declaration": ""})
    return whole.select("o_orderkey", *[F.when(cut, F.substring(x, 1, 25)).otherwise(x).alias(n) for n, x in (("json", json), ("xml", xml))])


NESTED = """tagged AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(CASE WHEN l_returnflag = 'R' THEN [l_linestatus, 'back'] ELSE [NULL] END) AS tag FROM lineitem)"""


@query(f"""WITH {NESTED} SELECT o_orderkey, o_orderstatus AS status, CAST(l_partkey AS VARCHAR) AS part, tag FROM orders JOIN tagged ON l_orderkey = o_orderkey WHERE o_orderkey % 19 <> 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def src_json_nested(t: Tables) -> DataFrame:
    """Three paths, two of them through one repeated level and one through another within it, from one parse."""
    found = source_paths.read_json(nested_orders(t), "json", {"status": "$.status", "part": "$.line[*].part", "tag": "$.line[*].tag[*]"})
    return found.select("o_orderkey", "status", "part", "tag")


@query("""SELECT l_orderkey AS o_orderkey, l_linenumber AS no, CAST(l_partkey AS VARCHAR) AS part, CASE WHEN l_returnflag = 'R' THEN l_linestatus || ',back' ELSE '' END AS tags FROM lineitem WHERE l_orderkey % 19 <> 0""")
def src_xml_nested(t: Tables) -> DataFrame:
    """Lines of orders' XML by an iteration path, with an attribute, a child and a repeated child."""
    found = source_paths.read_xml(nested_orders(t), "o_orderkey", "xml", "/order/line", {"no": "@no", "part": "part", "tags": "tag"})
    return found.select("o_orderkey", F.element_at("no", 1).cast("int").alias("no"), F.element_at("part", 1).alias("part"), F.array_join("tags", ",").alias("tags"))


@query("""SELECT 'R' || r_regionkey AS s, r_name AS name FROM region WHERE r_name IS NOT NULL""")
def src_xml_path(t: Tables) -> DataFrame:
    """Records of an XML file, read by paths: a child, an attribute and a text."""
    name = F.struct(F.lit("en").alias("_lang"), F.col("r_name").alias("_VALUE"))

    def build() -> DataFrame:
        return t.region.select(F.struct(F.concat(F.lit("R"), "r_regionkey").alias("id"), name.alias("name")).alias("region")).select("region.*")

    folder = f"{scratch(t.spark)}/regions.xml"
    build().write.option("rowTag", "region").option("rootTag", "regions").xml(folder)
    rows = t.spark.read.option("rowTag", "region").schema("id string, name struct<_lang:string,_VALUE:string>").xml(folder)
    return rows.select(F.col("id").alias("s"), F.col("name._VALUE").alias("name")).where("name is not null")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(t: Tables) -> DataFrame:
    """Records of a CSV file with a header and quoted texts."""
    folder = f"{scratch(t.spark)}/nations.csv"
    t.nation.select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).option("quoteAll", True).csv(folder)
    return t.spark.read.option("header", True).schema("n_nationkey int, n_name string, n_regionkey int").csv(folder)


@query(f"""WITH {QUADS} SELECT '<urn:' || s || '> <urn:' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<urn:' || o || '>' ELSE '"' || o || '"^^<urn:' || o_dt || '>' END || ' .' AS line
FROM quad WHERE g = 'geo'""")
def sink_ntriples(t: Tables) -> DataFrame:
    from graphloom.sources.terms import to_ntriples

    return to_ntriples(t.quads().where("g = 'geo'"))


# ---- projections and filters ----


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def project_expr(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("SELECT o_orderkey, year(o_orderdate) * 100 + month(o_orderdate) AS ym FROM orders")
def bind_column(t: Tables) -> DataFrame:
    return t.orders.withColumn("ym", F.year("o_orderdate") * 100 + F.month("o_orderdate")).select("o_orderkey", "ym")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Denied' WHEN c_acctbal > 5000 THEN 'Permitted' ELSE 'Undetermined' END AS decision,
coalesce(CASE WHEN c_acctbal < 0 THEN 'overdrawn' END, CASE WHEN c_acctbal <= 5000 THEN 'below limit' END, 'ok') AS diagnostic FROM customer""")
def case_decision(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.when(b < 0, "Denied").when(b > 5000, "Permitted").otherwise("Undetermined").alias("decision"), F.coalesce(F.when(b < 0, "overdrawn"), F.when(b <= 5000, "below limit"), F.lit("ok")).alias("diagnostic"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.02 AND l_returnflag <> 'N'")
def filter_compare(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity >= 45 AND l_discount < 0.02D AND l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_partkey")


LITERALS = """lit AS (SELECT l_orderkey AS id, CASE l_orderkey % 4 WHEN 1 THEN '0' || l_linenumber WHEN 2 THEN l_linenumber || '.0' ELSE CAST(l_linenumber AS VARCHAR) END AS lex,
CASE l_orderkey % 4 WHEN 2 THEN 'decimal' WHEN 3 THEN 'string' ELSE 'integer' END AS dt FROM lineitem)"""


@query(f"""WITH {LITERALS} SELECT id, lex, dt, lex = '1' AND dt = 'integer' AS same_term, coalesce(dt <> 'string' AND CAST(lex AS DECIMAL(10, 2)) = 1, false) AS same_value FROM lit""")
def filter_term_vs_value(t: Tables) -> DataFrame:
    """Literals of lines in several lexical forms, held against the integer 1 as terms and as values."""
    n, kind = F.col("l_linenumber").cast("string"), F.col("l_orderkey") % 4
    lex = F.when(kind == 1, F.concat(F.lit("0"), n)).when(kind == 2, F.concat(n, F.lit(".0"))).otherwise(n)
    v = t.lineitem.select(F.col("l_orderkey").alias("id"), lex.alias("lex"), F.when(kind == 2, "decimal").when(kind == 3, "string").otherwise("integer").alias("dt"))
    return v.select("id", "lex", "dt", ((F.col("lex") == "1") & (F.col("dt") == "integer")).alias("same_term"), F.coalesce((F.col("dt") != "string") & (F.col("lex").try_cast("decimal(10,2)") == 1), F.lit(False)).alias("same_value"))


@query("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11' OR p_retailprice < 1000)")
def filter_bool(t: Tables) -> DataFrame:
    return t.part.where(((F.col("p_size") < 5) | (F.col("p_size") > 45)) & ~((F.col("p_brand") == "Brand#11") | (F.col("p_retailprice") < 1000))).select("p_partkey")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') AND user_id NOT IN (1, 2, 3)")
def filter_in(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("purchase", "signup") & ~F.col("user_id").isin(1, 2, 3)).select("event_id", "event_type")


@query(f"WITH {QUADS} SELECT o_kind, coalesce(o_dt, '-') AS dt, count(*) AS n FROM quad WHERE o IS NOT NULL GROUP BY 1, 2")
def filter_term_kind(t: Tables) -> DataFrame:
    return t.quads().where("o is not null").groupBy("o_kind", F.coalesce("o_dt", F.lit("-")).alias("dt")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def filter_prefix(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").startswith("red")).select("p_partkey", "p_name")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus NOT IN ('O', 'F')) AS conforms FROM customer""")
def guard_shape(t: Tables) -> DataFrame:
    """minCount 1 and every value in a list, as one boolean for each focus."""
    seen = t.orders.groupBy("o_custkey").agg(F.count_if(~F.col("o_orderstatus").isin("O", "F")).alias("bad"))
    return t.customer.join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.col("bad") == 0, F.lit(False)).alias("conforms"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderpriority = '5-LOW'")
def param_query(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey = :customer AND o_orderpriority = :priority", args={"customer": 7, "priority": "5-LOW"}, orders=t.orders)


@query("WITH v(seg, w) AS (VALUES ('BUILDING', 1), ('MACHINERY', 2)) SELECT c_custkey, w FROM customer JOIN v ON c_mktsegment = seg")
def inline_values(t: Tables) -> DataFrame:
    v = t.values([("BUILDING", 1), ("MACHINERY", 2)], "c_mktsegment string, w int")
    return t.customer.join(F.broadcast(v), "c_mktsegment").select("c_custkey", "w")


# ---- joins ----


@query("""SELECT n_name, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def join_inner_bgp(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum(cents(F.col("o_totalprice"))).alias("amount"))


@query(f"""WITH {QUADS} SELECT a.s AS customer, b.o AS region FROM quad a JOIN quad b ON a.o = b.s AND a.p = 'partOf' AND b.p = 'partOf' WHERE a.g = 'party'""")
def join_path(t: Tables) -> DataFrame:
    """The path partOf / partOf from customers."""
    step = t.quads().where("p = 'partOf'").select("s", "o", "g")
    return step.where("g = 'party'").alias("a").join(step.alias("b"), F.col("a.o") == F.col("b.s")).select(F.col("a.s").alias("customer"), F.col("b.o").alias("region"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def join_left_optional(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "o_totalprice")
    return t.customer.select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 400000").select("o_custkey")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_custkey FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')) GROUP BY o_custkey HAVING count(*) = 3""")
def join_division(t: Tables) -> DataFrame:
    needed = t.values([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "o_orderpriority string")
    return relational.divides(t.orders, "o_custkey", "o_orderpriority", needed)


@query("SELECT a.l_orderkey AS o, a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey")
def join_self_pairs(t: Tables) -> DataFrame:
    """Pairs of parts of an order, once each; an order has a few lines."""
    s = t.lineitem.select("l_orderkey", "l_partkey")
    j = s.alias("a").join(s.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") < F.col("b.l_partkey")))
    return j.select(F.col("a.l_orderkey").alias("o"), F.col("a.l_partkey").alias("a"), F.col("b.l_partkey").alias("b"))


WINDOWS = """win AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS vf, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) END AS vt FROM orders)"""


def windows_of(t: Tables) -> DataFrame:
    """id, owner and half-open validity [vf, vt) of orders; every seventh is open."""
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("vf"), F.expr("if(o_orderkey % 7 = 0, null, o_orderdate + make_dt_interval(cast(o_orderkey % 90 as int)))").alias("vt"))


@query(f"""WITH {WINDOWS} SELECT a.owner, a.id AS a, b.id AS b FROM win a JOIN win b ON a.owner = b.owner AND a.id < b.id
AND a.vf < coalesce(b.vt, TIMESTAMP '9999-12-31') AND b.vf < coalesce(a.vt, TIMESTAMP '9999-12-31')""")
def join_interval_overlap(t: Tables) -> DataFrame:
    return relational.overlapping(windows_of(t), ["owner"], "vf", "vt", "id")


@query(f"""WITH {WINDOWS} SELECT w.id, o_orderkey AS hit FROM win w JOIN orders ON o_custkey = w.owner AND o_orderkey <> w.id AND o_orderdate >= w.vf AND (w.vt IS NULL OR o_orderdate < w.vt)""")
def join_point_in_interval(t: Tables) -> DataFrame:
    w = windows_of(t)
    at = (F.col("o_custkey") == F.col("owner")) & (F.col("o_orderkey") != F.col("id")) & (F.col("o_orderdate") >= F.col("vf")) & (F.col("vt").isNull() | (F.col("o_orderdate") < F.col("vt")))
    return w.join(t.orders, at).select("id", F.col("o_orderkey").alias("hit"))


VARIANTS = """variant AS (SELECT p_brand || '/' || p_type AS slot, p_partkey AS id, p_size AS lo, p_size + 1 + p_partkey % 7 AS hi FROM part)"""


def variants_of(t: Tables) -> DataFrame:
    """slot, id, lo, hi: whole ranges of sizes that parts of a brand and type stand for."""
    return t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("slot"), F.col("p_partkey").alias("id"), F.col("p_size").alias("lo"), (F.col("p_size") + 1 + F.col("p_partkey") % 7).cast("int").alias("hi"))


def covered(variants: DataFrame, *more: str) -> DataFrame:
    """slot, id, p of all whole points p in [lo, hi), and more columns: widths are small."""
    return variants.select("slot", "id", *more, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("p"))


@query(f"WITH {VARIANTS} SELECT x.slot, x.id AS a, y.id AS b, greatest(x.lo, y.lo) AS witness FROM variant x JOIN variant y ON x.slot = y.slot AND x.id < y.id AND x.lo < y.hi AND y.lo < x.hi")
def interval_variants_overlap(t: Tables) -> DataFrame:
    """Of two variants that overlap, the one that starts later (of equal starts, the larger id) starts within the other: each pair is met there once."""
    v = variants_of(t)
    inside = covered(v, "lo").repartition("slot", "p")  # a small table in one file makes many pairs
    later = v.select("slot", F.col("lo").alias("p"), F.col("id").alias("_id"))
    met = inside.join(later, ["slot", "p"]).where("lo < p AND id <> _id OR lo = p AND id < _id")
    return met.select("slot", F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b"), F.col("p").alias("witness"))


@query(f"""WITH {VARIANTS}, e AS (SELECT slot, hi, max(hi) OVER (PARTITION BY slot) AS top FROM variant)
SELECT DISTINCT slot, hi AS gap_from FROM e WHERE hi < top AND NOT EXISTS (SELECT 1 FROM variant v WHERE v.slot = e.slot AND v.lo <= e.hi AND e.hi < v.hi)""")
def interval_variants_gap(t: Tables) -> DataFrame:
    v = variants_of(t)
    ends = v.select("slot", "hi", F.max("hi").over(Window.partitionBy("slot")).alias("top")).where("hi < top").select("slot", F.col("hi").alias("gap_from")).distinct()
    return ends.join(covered(v).select("slot", F.col("p").alias("gap_from")), ["slot", "gap_from"], "left_anti")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) WHERE m > o_orderdate""")
def order_violation(t: Tables) -> DataFrame:
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return t.orders.select("o_orderkey", "o_orderdate", F.max("o_orderdate").over(before).alias("m")).where("m > o_orderdate").select("o_orderkey")


@query(f"""WITH {POSTINGS} SELECT account, pos, amount FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY pos DESC) AS r FROM posting) WHERE r = 1""")
def asof_latest(t: Tables) -> DataFrame:
    return relational.latest_at(t.postings().select("account", "pos", "amount"), ["account"], ["pos"], F.lit(True))


@query("""SELECT e.event_id, o.o_orderkey FROM events e LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = e.user_id AND o_orderdate + INTERVAL 24 YEAR <= e.ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true WHERE e.event_type = 'purchase'""")
def asof_join(t: Tables) -> DataFrame:
    """Each purchase with its user's last order at or before it (dates moved by 24 years)."""
    orders = t.orders.select(F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + make_ym_interval(24)").alias("at"), "o_orderkey")
    last = orders.groupBy("user_id", "at").agg(F.max("o_orderkey").alias("o_orderkey"))
    events = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return relational.as_of(events, last, ["user_id"], "ts", "at", ["o_orderkey"]).select("event_id", "o_orderkey")


@query(f"""WITH {POSTINGS}, cp AS (SELECT account, (pos - 1) // 1000 AS k, CAST(sum(sum(delta)) OVER (PARTITION BY account ORDER BY (pos - 1) // 1000) AS BIGINT) AS balance FROM posting GROUP BY account, (pos - 1) // 1000)
SELECT p.pos, cp.balance AS closed FROM posting p LEFT JOIN cp ON cp.account = p.account AND cp.k = (p.pos - 1) // 1000 - 1""")
def asof_computed_key(t: Tables) -> DataFrame:
    """The checkpoint before a posting is addressed by a computed period number: an equi-join, no search."""
    p = t.postings().withColumn("k", F.expr("(pos - 1) div 1000"))
    per = p.groupBy("account", "k").agg(F.sum("delta").alias("d"))
    cp = per.select("account", (F.col("k") + 1).alias("k"), F.sum("d").over(Window.partitionBy("account").orderBy("k")).alias("closed"))
    return p.join(cp, ["account", "k"], "left").select("pos", "closed")


NAMES = "names(lex, dt, concept) AS (VALUES ('ASIA', 'string', 'urn:geo#asia'), ('EUROPE', 'string', 'urn:geo#europe'), ('EUROPE', 'token', 'urn:geo/europe2'), ('2', 'integer', 'urn:n/two'))"
NAME_ROWS = [("ASIA", "string", "urn:geo#asia"), ("EUROPE", "string", "urn:geo#europe"), ("EUROPE", "token", "urn:geo/europe2"), ("2", "integer", "urn:n/two")]


def names_of(t: Tables) -> DataFrame:
    return F.broadcast(t.values(NAME_ROWS, "lex string, dt string, concept string"))


@query(f"WITH {NAMES} SELECT r_regionkey, concept FROM region LEFT JOIN names ON lex = r_name")
def lookup_lexical(t: Tables) -> DataFrame:
    return t.region.join(names_of(t), F.col("lex") == F.col("r_name"), "left").select("r_regionkey", "concept")


@query(f"WITH {NAMES} SELECT r_regionkey, concept FROM region LEFT JOIN names ON lex = r_name AND dt = 'string'")
def lookup_term(t: Tables) -> DataFrame:
    return t.region.join(names_of(t), (F.col("lex") == F.col("r_name")) & (F.col("dt") == "string"), "left").select("r_regionkey", "concept")


@query(f"WITH {NAMES} SELECT r_regionkey, concept FROM region LEFT JOIN names ON TRY_CAST(lex AS INTEGER) = r_regionkey")
def lookup_cast(t: Tables) -> DataFrame:
    return t.region.join(names_of(t), F.col("lex").try_cast("int") == F.col("r_regionkey"), "left").select("r_regionkey", "concept")


@query(f"WITH {NAMES} SELECT r_regionkey, concept FROM region LEFT JOIN names ON regexp_replace(concept, '^.*[/#]', '') = lower(r_name)")
def lookup_name(t: Tables) -> DataFrame:
    return t.region.join(names_of(t), F.regexp_replace("concept", "^.*[/#]", "") == F.lower("r_name"), "left").select("r_regionkey", "concept")


@query(f"WITH {NAMES} SELECT n_nationkey, 'urn:nation/' || n_nationkey || '?in=' || concept AS id FROM nation JOIN region ON n_regionkey = r_regionkey JOIN names ON lex = r_name AND dt = 'string'")
def lookup_identity(t: Tables) -> DataFrame:
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(names_of(t).where("dt = 'string'"), F.col("lex") == F.col("r_name"))
    return j.select("n_nationkey", F.concat(F.lit("urn:nation/"), F.col("n_nationkey").cast("string"), F.lit("?in="), "concept").alias("id"))


@query("""WITH m(raw, mapped) AS (VALUES ('BUILDING', 'B'), ('MACHINERY', 'M'), ('FURNITURE', 'F'))
SELECT c_mktsegment AS raw, mapped, count(*) AS n, mapped IS NULL AS unmapped FROM customer LEFT JOIN m ON c_mktsegment = raw GROUP BY 1, 2""")
def value_map(t: Tables) -> DataFrame:
    m = t.values([("BUILDING", "B"), ("MACHINERY", "M"), ("FURNITURE", "F")], "raw string, mapped string")
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("raw")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(m), "raw", "left").select("raw", "mapped", "n", F.col("mapped").isNull().alias("unmapped"))


@query("SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def etl_join_condition(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey")


@query(f"WITH {QUADS} SELECT DISTINCT a.s, b.o AS class FROM quad a JOIN quad b ON a.o = b.s AND b.p = 'type'")
def join_any_predicate(t: Tables) -> DataFrame:
    q = t.quads()
    return q.alias("a").join(q.where("p = 'type'").alias("b"), F.col("a.o") == F.col("b.s")).select(F.col("a.s").alias("s"), F.col("b.o").alias("class")).distinct()


# ---- aggregates ----


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds, min(o_orderstatus) AS one FROM orders GROUP BY o_custkey")
def agg_count_distinct_sample(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("kinds"), F.min("o_orderstatus").alias("one"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS bought, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id")
def agg_count_if(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("SELECT o_custkey, max(coalesce(CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 300000 THEN 'large' END, '')) AS reason FROM orders GROUP BY o_custkey")
def agg_max_reason(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max(F.coalesce(F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") > 300000, "large"), F.lit(""))).alias("reason"))


@query("SELECT p_type, string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS brands FROM part GROUP BY p_type")
def agg_group_concat(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), " ").alias("brands"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg_having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT count(*) AS n, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS discounted FROM lineitem")
def agg_global(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("n"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("discounted"))


@query("""SELECT n_name, round(avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), 4) AS mean, count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal IS NULL) AS errors
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def agg_avg_nulls(t: Tables) -> DataFrame:
    j = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name").agg(F.round(F.avg(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))), 4).alias("mean"), F.count_if((F.col("c_acctbal") < 0) | F.col("c_acctbal").isNull()).alias("errors"))


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n HAVING n > 5")
def agg_nested(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 5").groupBy("n").agg(F.count("*").alias("customers"))


@query("""SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def ledger_rollup(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


# ---- orders, limits, sets ----


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS place FROM supplier")
def sort_multi(t: Tables) -> DataFrame:
    return relational.numbered(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), [F.col("s_nationkey"), F.col("s_acctbal").desc(), F.col("s_suppkey")], "place").select("s_suppkey", "place")


@query("SELECT p_name, row_number() OVER (ORDER BY p_name) AS place FROM (SELECT DISTINCT p_name FROM part)")
def sort_iri(t: Tables) -> DataFrame:
    return relational.numbered(t.part.select("p_name").distinct(), [F.col("p_name")], "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def limit_n(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("""WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '+' ORDER BY l_returnflag || l_linestatus) AS sig FROM lineitem GROUP BY l_orderkey)
SELECT sig, count(*) AS n FROM s GROUP BY sig HAVING count(*) >= 10 ORDER BY n DESC, sig LIMIT 3""")
def top_signatures(t: Tables) -> DataFrame:
    sig = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), "+").alias("sig"))
    return sig.groupBy("sig").agg(F.count("*").alias("n")).where("n >= 10").orderBy(F.col("n").desc(), "sig").limit(3)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT user_id, event_type, n, lead(n) OVER w AS second, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type))
SELECT user_id, event_type, n - coalesce(second, 0) AS gap, CASE WHEN second IS NULL THEN 'single' WHEN n - second >= 5 THEN 'resolved' ELSE 'ambiguous' END AS status FROM r WHERE k = 1""")
def score_gap_status(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "event_type")
    r = c.withColumn("second", F.lead("n").over(w)).withColumn("k", F.row_number().over(w)).where("k = 1")
    return r.select("user_id", "event_type", (F.col("n") - F.coalesce("second", F.lit(0))).alias("gap"), F.when(F.col("second").isNull(), "single").when(F.col("n") - F.col("second") >= 5, "resolved").otherwise("ambiguous").alias("status"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def set_distinct(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT 'customer' AS tag, c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_union_all(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal < 0").select(F.lit("customer").alias("tag"), F.col("c_nationkey").alias("k")).unionByName(t.supplier.where("s_acctbal < 0").select(F.lit("supplier").alias("tag"), F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_union(t: Tables) -> DataFrame:
    return set_union_all(t).select("k").distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


STATES = "a AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)"


def states_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    pick = [t.orders.where(F.col("o_orderkey") % k == 0).select("o_custkey", "o_orderstatus").distinct() for k in (2, 3)]
    return pick[0], pick[1]


@query(f"WITH {STATES} SELECT *, 'del' AS op FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'add' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_except_delta(t: Tables) -> DataFrame:
    return relational.signed_difference(*states_of(t))


@query(f"WITH {STATES} SELECT op, count(*) AS n FROM (SELECT 'only old' AS op FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY op")
def set_symmetric_diff(t: Tables) -> DataFrame:
    d = relational.signed_difference(*states_of(t))
    return d.groupBy(F.when(F.col("op") == "del", "only old").otherwise("only new").alias("op")).agg(F.count("*").alias("n"))


# ---- windows and graphs ----


@query(f"WITH {POSTINGS} SELECT pos, CAST(sum(delta) OVER (PARTITION BY account ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS after FROM posting")
def win_running_balance(t: Tables) -> DataFrame:
    w = Window.partitionBy("account").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return t.postings().select("pos", F.sum("delta").over(w).alias("after"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS number FROM conversations")
def win_sibling_number(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("number"))


@query("SELECT user_id, event_type AS decision, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win_latest_decision(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("e")).select("user_id", F.col("e.event_type").alias("decision"), F.col("e.event_id").alias("event_id"))


@query(f'WITH RECURSIVE {PATHS} SELECT "desc", anc FROM path WHERE depth > 0')
def graph_closure(t: Tables) -> DataFrame:
    return graph.closure(t.account_edges())


CYCLIC = "e(child, parent) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation)"


def cyclic_edges(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("child"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("parent"))


@query(f"WITH RECURSIVE {CYCLIC}, r(a, b) AS (SELECT child, parent FROM e UNION SELECT r.a, e.parent FROM r JOIN e ON r.b = e.child) SELECT DISTINCT a AS node FROM r WHERE a = b")
def graph_cycle(t: Tables) -> DataFrame:
    return graph.cyclic(cyclic_edges(t))


@query(f"""WITH RECURSIVE {EDGES}, l AS (SELECT 'ALL' AS node, 0 AS level UNION ALL SELECT e.child, l.level + 1 FROM l JOIN edge e ON e.parent = l.node) SELECT node, level FROM l""")
def graph_topo(t: Tables) -> DataFrame:
    return graph.levels(t.account_edges())


@query(f"""WITH RECURSIVE {EDGES}, l AS (SELECT 'R1' AS node, 0 AS round UNION ALL SELECT e.child, l.round + 1 FROM l JOIN edge e ON e.parent = l.node) SELECT node, round FROM l""")
def graph_impacted(t: Tables) -> DataFrame:
    return graph.reachable(t.account_edges(), t.values([("R1",)], "node string"), "parent", "child")


STATES = [("customer", "partOf", "nation"), ("nation", "partOf", "region"), ("region", "^partOf", "nation")]


@query(f"""WITH {QUADS}, up AS (SELECT a.s AS a, b.o AS r FROM quad a JOIN quad b ON b.s = a.o AND b.p = 'partOf' WHERE a.p = 'partOf') SELECT DISTINCT a, r AS b FROM up""")
def path_elimination(t: Tables) -> DataFrame:
    """A graph of states made one path, customer to region with the way back as a loop, and the pairs that it joins."""
    q = t.quads()
    path = paths.eliminated(STATES, "customer", "region")
    found = paths.pairs(path, q.select("s", "p", "o"), q.select(F.col("s").alias("node")).distinct())
    return found.where("a like 'C%' and b like 'R%'").select("a", "b")


@query(f"""WITH {QUADS} SELECT DISTINCT a.s AS a, d.s AS b FROM quad a JOIN quad c ON c.s = a.o AND c.p = 'partOf' JOIN quad d ON d.o = c.o AND d.p = 'partOf' WHERE a.p = 'partOf'""")
def path_injected(t: Tables) -> DataFrame:
    """Steps in a caller's own path language, > follows a property, < goes back along it: customers and the nations of their region."""
    q = t.quads()
    path = paths.parsed(">partOf/>partOf/<partOf", lambda name: ("step" if name[0] == ">" else "back", name[1:]))
    return paths.pairs(path, q.select("s", "p", "o"), q.select(F.col("s").alias("node")).distinct()).select("a", "b")
