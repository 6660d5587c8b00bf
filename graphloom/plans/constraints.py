"""Integrity constraints, rules and competency questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import constraints as ck
from graphloom.sources.tables import Tables, cents

from .registry import query


def rows(rule: str, focus: str, value: str, source: str, severity: str = "Violation") -> str:
    """DuckDB SQL of one rule's violations."""
    return f"SELECT '{rule}' AS rule, CAST({focus} AS VARCHAR) AS focus, CAST({value} AS VARCHAR) AS value, '{severity}' AS severity FROM {source}"


@query(rows("lines", "o_orderkey", "n", "(SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE n < 1 OR n > 7"))
def ck_cardinality(t: Tables) -> DataFrame:
    return ck.cardinality(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "lines", t.orders, "o_orderkey", 1, 7)


@query(rows("name", "p_partkey", "p_name", "part WHERE NOT regexp_matches(p_name, '^[a-m][a-z]+ [a-z]+$')"))
def ck_pattern(t: Tables) -> DataFrame:
    return ck.pattern(t.part, "name", "p_partkey", "p_name", "^[a-m][a-z]+ [a-z]+$")


@query(rows("orders", "c_custkey", "NULL", "customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"))
def ck_missing(t: Tables) -> DataFrame:
    return ck.missing(t.customer, "orders", "c_custkey", t.orders, "o_custkey")


@query(rows("status", "o_orderkey", "o_orderstatus", "orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"))
def ck_forbidden(t: Tables) -> DataFrame:
    return ck.violations(t.orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"), "status", F.col("o_orderkey"), F.col("o_orderstatus"))


@query(rows("pair", "c_custkey", "NULL", "(SELECT c_custkey, max(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS a, max(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE (a IS NULL) <> (b IS NULL)"))
def ck_both_or_neither(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "O", 1)).alias("a"), F.max(F.when(F.col("o_orderstatus") == "F", 1)).alias("b"))
    return ck.violations(g.where("(a IS NULL) <> (b IS NULL)"), "pair", F.col("o_custkey"))


@query(rows("line", "concat_ws('/', l_orderkey, l_linenumber)", "n", "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n > 1"))
def ck_unique_key(t: Tables) -> DataFrame:
    return ck.unique_key(t.lineitem, "line", ["l_orderkey", "l_linenumber"])


@query(rows("supersession", "b.o_orderkey", "a.o_orderstatus", "(SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) b JOIN orders a ON a.o_orderkey = b.prev WHERE a.o_orderstatus <> b.o_orderstatus"))
def ck_edge_mismatch(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    j = t.orders.select("o_orderkey", "o_orderstatus", F.lag("o_orderstatus").over(w).alias("was"))
    return ck.violations(j.where("was <> o_orderstatus"), "supersession", F.col("o_orderkey"), F.col("was"))


@query(rows("order", "l_orderkey || '/' || l_linenumber", "l_partkey", "lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate"))
def ck_interval_order(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate")
    return ck.violations(j, "order", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.col("l_partkey"))


@query(rows("fold", "o_orderkey", "s", "(SELECT o_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE s > t"))
def ck_balance_fold(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("s"))
    return ck.violations(s.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("s") > cents(F.col("o_totalprice"))), "fold", F.col("o_orderkey"), F.col("s"))


@query(rows("within", "o_custkey", "n", "(SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS n, count(*) AS m FROM orders GROUP BY 1) WHERE n * 20 > m"))
def ck_merge_within(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"), F.count("*").alias("m"))
    return ck.violations(g.where("n * 20 > m"), "within", F.col("o_custkey"), F.col("n"))


@query(rows("ceiling", "o_orderkey", "CAST(round(o_totalprice) AS BIGINT)", "orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 + 20 * c_acctbal"))
def ck_ceiling(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where("o_totalprice > 100000 + 20 * c_acctbal")
    return ck.violations(j, "ceiling", F.col("o_orderkey"), F.round("o_totalprice").cast("long"))


@query(rows("provenance", "s_suppkey", "NULL", "supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)"))
def ck_provenance(t: Tables) -> DataFrame:
    return ck.missing(t.supplier, "provenance", "s_suppkey", t.lineitem.where("l_quantity > 49"), "l_suppkey")


@query(rows("admitted", "l_orderkey || '/' || l_partkey", "l_suppkey", "(SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_type, p_brand) NOT IN (SELECT p_type, p_brand FROM part WHERE p_size > 10))"))
def ck_admitted(t: Tables) -> DataFrame:
    allowed = t.part.where("p_size > 10").select("p_type", "p_brand").distinct()
    odd = t.part.join(allowed, ["p_type", "p_brand"], "left_anti").select("p_partkey")
    j = t.lineitem.join(odd, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return ck.violations(j, "admitted", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")), F.col("l_suppkey"))


@query(rows("fallback", "p_brand", "b", "(SELECT p_brand, min(p_type) AS a, max(p_type) AS b FROM part WHERE p_size % 7 = 0 GROUP BY 1) WHERE a <> b"))
def ck_fallback(t: Tables) -> DataFrame:
    g = t.part.where("p_size % 7 = 0").groupBy("p_brand").agg(F.min("p_type").alias("a"), F.max("p_type").alias("b"))
    return ck.violations(g.where("a <> b"), "fallback", F.col("p_brand"), F.col("b"))


@query(rows("conflict", "a.s_suppkey", "b.s_suppkey", "supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE abs(a.s_acctbal - b.s_acctbal) < 500 AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = a.s_nationkey AND n_regionkey = 0)", "Warning"))
def ck_conflict_pairs(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation.where("n_regionkey = 0"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey", "s_nationkey", "s_acctbal")
    band = F.floor(F.col("s_acctbal") / 500)  # two balances within 500 are in the same band or in bands beside each other
    near = s.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    j = s.withColumn("band", band).alias("a").join(near.alias("b"), (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")) & (F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal")) < 500))
    return ck.violations(j, "conflict", F.col("a.s_suppkey"), F.col("b.s_suppkey"), "Warning")


@query(rows("coverage", "n_nationkey", "r_name", "nation JOIN region ON n_regionkey = r_regionkey WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)"))
def ck_coverage(t: Tables) -> DataFrame:
    leaf = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier.where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti")
    return ck.violations(leaf, "coverage", F.col("n_nationkey"), F.col("r_name"))


@query(rows("continuity", "a.conv_id || '/' || a.turn", "a.role", "conversations a WHERE a.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)"))
def ck_continuity(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "role")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    lost = c.where("role = 'user'").join(after, ["conv_id", "turn"], "left_anti")
    return ck.violations(lost, "continuity", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.col("role"))


@query("""WITH v AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'm' ELSE 'ft' END AS unit, CASE p_partkey % 4 WHEN 0 THEN 'mass' WHEN 1 THEN 'length' WHEN 2 THEN CASE p_size % 3 WHEN 0 THEN 'mass' ELSE 'length' END END AS space FROM part),
u(unit, space) AS (VALUES ('kg', 'mass'), ('m', 'length'))
SELECT 'units' AS rule, CAST(id AS VARCHAR) AS focus, v.unit AS value, 'Violation' AS severity FROM v LEFT JOIN u ON u.unit = v.unit WHERE u.space IS NULL OR u.space IS DISTINCT FROM v.space""")
def ck_units(t: Tables) -> DataFrame:
    """Parts whose unit is unknown or belongs to another space than they state."""
    unit = F.when(F.col("p_size") % 3 == 0, "kg").when(F.col("p_size") % 3 == 1, "m").otherwise("ft")
    space = F.when(F.col("p_partkey") % 4 == 0, "mass").when(F.col("p_partkey") % 4 == 1, "length").when(F.col("p_partkey") % 4 == 2, F.when(F.col("p_size") % 3 == 0, "mass").otherwise("length"))
    v = t.part.select(F.col("p_partkey").alias("id"), unit.alias("unit"), space.alias("space"))
    u = t.values([("kg", "mass"), ("m", "length")], "unit string, of string")
    j = v.join(u, "unit", "left").where(F.col("of").isNull() | ~F.col("of").eqNullSafe(F.col("space")))
    return ck.violations(j, "units", F.col("id"), F.col("unit"))


@query(rows("ranks", "conv_id", "n", "(SELECT conv_id, min(turn) AS lo, max(turn) AS hi, count(DISTINCT turn) AS n, count(*) AS r FROM conversations WHERE role <> 'system' GROUP BY 1) WHERE hi - lo + 1 <> n OR n <> r"))
def ck_rank_contiguous(t: Tables) -> DataFrame:
    return ck.contiguous(t.conversations.where("role <> 'system'"), "ranks", ["conv_id"], "turn")


@query(rows("code", "child", "parent", "(SELECT 'A.' || n_regionkey || '.' || n_nationkey AS child, CASE WHEN n_nationkey % 6 = 0 THEN 'A.9' ELSE 'A.' || n_regionkey END AS parent FROM nation) WHERE NOT (starts_with(child, parent || '.') AND strpos(substr(child, length(parent) + 2), '.') = 0)"))
def ck_code_prefix(t: Tables) -> DataFrame:
    codes = t.nation.select(F.concat(F.lit("A."), "n_regionkey", F.lit("."), "n_nationkey").alias("child"), F.expr("if(n_nationkey % 6 = 0, 'A.9', concat('A.', n_regionkey))").alias("parent"))
    fits = F.expr("startswith(child, concat(parent, '.')) AND instr(substring(child, length(parent) + 2), '.') = 0")
    return ck.violations(codes.where(~fits), "code", F.col("child"), F.col("parent"))


@query(rows("comparable", "a.c_custkey", "b.c_custkey", "customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_mktsegment <> b.c_mktsegment OR a.c_nationkey <> b.c_nationkey"))
def ck_comparable(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    j = c.alias("a").join(c.alias("b"), F.col("b.c_custkey") == F.col("a.c_custkey") + 1).where("a.c_mktsegment <> b.c_mktsegment OR a.c_nationkey <> b.c_nationkey")
    return ck.violations(j, "comparable", F.col("a.c_custkey"), F.col("b.c_custkey"))


@query(rows("period", "l_orderkey || '/' || l_linenumber", "strftime(l_shipdate, '%Y-%m-%d')", "lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + 100"))
def ck_in_period(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where("to_date(l_shipdate) > date_add(to_date(o_orderdate), 100)")
    return ck.violations(j, "period", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.date_format("l_shipdate", "yyyy-MM-dd"))


@query(rows("inherited", "s_suppkey", "s_nationkey", "supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> n_regionkey"))
def ck_inherited(t: Tables) -> DataFrame:
    j = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).where("s_suppkey % 5 <> n_regionkey")
    return ck.violations(j, "inherited", F.col("s_suppkey"), F.col("s_nationkey"))


@query(rows("antichain", "b.n", "a.n", "(SELECT DISTINCT 'urn:' || c_nationkey AS n FROM customer) a JOIN (SELECT DISTINCT 'urn:' || c_nationkey AS n FROM customer) b ON starts_with(b.n, a.n) AND a.n <> b.n"))
def ck_prefix_overlap(t: Tables) -> DataFrame:
    return ck.prefix_overlap(t.customer.select(F.concat(F.lit("urn:"), "c_nationkey").alias("n")), "antichain", "n")


@query(f"""WITH v AS ({rows("missing", "c_custkey", "NULL", "customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "Warning")} UNION ALL {rows("negative", "c_custkey", "c_nationkey", "customer WHERE c_acctbal < 0")})
SELECT *, row_number() OVER (PARTITION BY rule ORDER BY CASE severity WHEN 'Violation' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END, focus, value NULLS FIRST) AS place FROM v""")
def ck_report(t: Tables) -> DataFrame:
    a = ck.missing(t.customer, "missing", "c_custkey", t.orders, "o_custkey").withColumn("severity", F.lit("Warning"))
    return ck.report(a, ck.violations(t.customer.where("c_acctbal < 0"), "negative", F.col("c_custkey"), F.col("c_nationkey")))


@query(rows("unknown", "p_name", "n", "(SELECT p_name, count(*) AS n FROM part WHERE starts_with(p_name, 'red') AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 30) GROUP BY 1)"))
def ck_unknown_term(t: Tables) -> DataFrame:
    known = t.part.where("p_size > 30").select("p_name").distinct()
    g = t.part.where(F.col("p_name").startswith("red")).join(known, "p_name", "left_anti").groupBy("p_name").agg(F.count("*").alias("n"))
    return ck.violations(g, "unknown", F.col("p_name"), F.col("n"))


@query("SELECT DISTINCT 'E' || o_custkey AS effect, 'causes' AS link, 'S' || l_suppkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 45")
def rule_effect_link(t: Tables) -> DataFrame:
    j = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.concat(F.lit("E"), "o_custkey").alias("effect"), F.lit("causes").alias("link"), F.concat(F.lit("S"), "l_suppkey").alias("target")).distinct()


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def competency_party(t: Tables) -> DataFrame:
    c = t.customer.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"))
    s = t.supplier.groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("suppliers"))
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT p_brand, p_type, min(p_size) AS least, max(p_size) AS most, count(*) AS parts FROM part GROUP BY ALL HAVING count(*) >= 2")
def competency_quantification(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.count("*").alias("parts")).where("parts >= 2")


@query("SELECT o_custkey, count(*) AS postings, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL")
def competency_ledger(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("postings"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT conv_id, count(*) AS elements, string_agg(role, '>' ORDER BY turn) AS form FROM conversations GROUP BY conv_id")
def competency_wording(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("elements"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("form"))


@query("SELECT p_brand AS instrument, l_returnflag AS term, count(DISTINCT l_suppkey) AS parties FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def competency_instrument(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("instrument"), F.col("l_returnflag").alias("term")).agg(F.count_distinct("l_suppkey").alias("parties"))
