"""Eligibility decisions and binding resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import kleene
from graphloom.operators import bindings, eligibility, graph
from graphloom.sources.tables import Tables

from .registry import query

RANGES = [(0.0, True, 1000.0, False, "USD"), (5000.0, False, 9000.0, True, "USD")]
DECIDE = "CASE WHEN {0} IS NULL THEN 'Undetermined' WHEN {0} THEN 'Permitted' ELSE 'Denied' END"


TRUTH = "truth AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS x, CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END AS y FROM lineitem)"


def truths_of(t: Tables) -> DataFrame:
    """id, x, y: two three-valued findings on each line."""
    x = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    y = F.when(F.col("l_linenumber") % 3 == 0, True).when(F.col("l_linenumber") % 3 == 1, False)
    return t.lineitem.select(F.col("l_orderkey").alias("id"), x.alias("x"), y.alias("y"))


@query(f"""WITH {TRUTH} SELECT id, coalesce(CAST(x AS VARCHAR), 'u') AS a, coalesce(CAST(y AS VARCHAR), 'u') AS b,
coalesce(CAST(x AND y AS VARCHAR), 'u') AS both, coalesce(CAST(x OR y AS VARCHAR), 'u') AS one, coalesce(CAST(NOT x AS VARCHAR), 'u') AS negated FROM truth""")
def kleene_truth_table(t: Tables) -> DataFrame:
    """And, or and not of the findings on each line."""
    x, y = F.col("x"), F.col("y")
    return truths_of(t).select("id", *[F.coalesce(v.cast("string"), F.lit("u")).alias(n) for n, v in (("a", x), ("b", y), ("both", x & y), ("one", x | y), ("negated", ~x))])


CANDIDATES = "cand AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 7 = 0 THEN 'EUR' ELSE 'USD' END AS unit FROM customer)"
IN_RANGE = "CASE WHEN v IS NOT NULL AND unit = 'USD' THEN (v >= 0 AND v < 1000) OR (v > 5000 AND v <= 9000) END"


def candidates_of(t: Tables) -> DataFrame:
    """id, v, unit: balances, some missing and some in another unit."""
    return t.customer.select(F.col("c_custkey").alias("id"), F.expr("if(c_custkey % 10 = 0, null, c_acctbal)").alias("v"), F.expr("if(c_custkey % 7 = 0, 'EUR', 'USD')").alias("unit"))


@query(f"WITH {CANDIDATES}, d AS (SELECT id, v, unit, {IN_RANGE} AS p FROM cand) SELECT id, {DECIDE.format('p')} AS decision, CASE WHEN v IS NULL THEN 'MissingCandidate' WHEN unit <> 'USD' THEN 'NoBoundInUnit' END AS diagnostic FROM d")
def elig_interval(t: Tables) -> DataFrame:
    v, unit = F.col("v"), F.col("unit")
    return candidates_of(t).select("id", kleene.decision(eligibility.interval(v, unit, RANGES)).alias("decision"), eligibility.interval_diagnostic(v, unit, RANGES).alias("diagnostic"))


@query(f"WITH {CANDIDATES} SELECT id, unit IN ('USD') AS applicable FROM cand")
def elig_interval_unit(t: Tables) -> DataFrame:
    return candidates_of(t).select("id", F.col("unit").isin("USD").alias("applicable"))


@query("""WITH e AS (SELECT o_custkey AS id, count(DISTINCT o_orderstatus) AS n, count(*) AS answers, min(o_totalprice) AS v FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, CASE WHEN n IS NULL THEN 'MissingEvidence' WHEN answers > 1 AND n > 1 THEN 'SeveralCandidates' ELSE 'decided' END AS diagnostic,
CASE WHEN n IS NULL OR (answers > 1 AND n > 1) THEN 'Undetermined' WHEN v >= 100000 THEN 'Permitted' ELSE 'Denied' END AS decision FROM customer LEFT JOIN e ON id = c_custkey""")
def elig_interval_bound(t: Tables) -> DataFrame:
    e = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count_distinct("o_orderstatus").alias("n"), F.count("*").alias("answers"), F.min("o_totalprice").alias("v"))
    j = t.customer.select(F.col("c_custkey").alias("id")).join(e, "id", "left")
    several = (F.col("answers") > 1) & (F.col("n") > 1)
    value = F.when(F.col("n").isNotNull() & ~several, F.col("v") >= 100000)
    return j.select("id", F.when(F.col("n").isNull(), "MissingEvidence").when(several, "SeveralCandidates").otherwise("decided").alias("diagnostic"), kleene.decision(value).alias("decision"))


@query(f"""WITH d AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN false WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN true ELSE false END AS p FROM customer)
SELECT id, {DECIDE.format('p')} AS decision FROM d""")
def elig_flat(t: Tables) -> DataFrame:
    value = eligibility.flat(F.col("c_mktsegment"), F.lit(True), ["MACHINERY", "BUILDING"], ["BUILDING"])
    return t.customer.select(F.col("c_custkey").alias("id"), kleene.decision(value).alias("decision"))


@query(f"""WITH d AS (SELECT c_custkey AS id, 'N' || c_nationkey AS c, 'R' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT -r_regionkey - 1, 'R' || r_regionkey, 'R' || r_regionkey FROM region),
p AS (SELECT id, CASE WHEN c IN ('N3', 'N8') THEN false WHEN c IN (SELECT 'R' || n_regionkey FROM nation WHERE n_nationkey IN (3, 8)) THEN NULL WHEN r IN ('R3', 'R1') THEN true ELSE false END AS p FROM d)
SELECT id, {DECIDE.format('p')} AS decision FROM p""")
def elig_hier(t: Tables) -> DataFrame:
    edges = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    cand = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("concept")).unionByName(t.region.select((-F.col("r_regionkey") - 1).cast("long").alias("id"), F.concat(F.lit("R"), "r_regionkey").alias("concept")))
    d = eligibility.hierarchical(cand, "concept", graph.closure(edges), ["R3", "R1"], ["N3", "N8"])
    return d.select("id", kleene.decision(F.col("value")).alias("decision"))


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Permitted' WHEN c_mktsegment = 'FURNITURE' THEN 'Denied' ELSE 'Undetermined' END AS decision FROM customer")
def elig_no_hierarchy(t: Tables) -> DataFrame:
    """Only named concepts decide."""
    c = F.col("c_mktsegment")
    return t.customer.select(F.col("c_custkey").alias("id"), kleene.decision(F.when(c == "BUILDING", True).when(c == "FURNITURE", False)).alias("decision"))


@query("SELECT p_partkey AS id, CASE WHEN p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48) THEN 'Undetermined' ELSE 'Permitted' END AS decision, CASE WHEN p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48) THEN 'OutsideScheme' END AS diagnostic FROM part")
def elig_outside_scheme(t: Tables) -> DataFrame:
    scheme = t.part.where("p_size > 48").select(F.col("p_brand").alias("b"), F.lit(True).alias("known")).distinct()
    j = t.part.join(scheme, F.col("p_brand") == F.col("b"), "left")
    return j.select(F.col("p_partkey").alias("id"), kleene.decision(F.col("known")).alias("decision"), F.when(F.col("known").isNull(), "OutsideScheme").alias("diagnostic"))


SETS = """v AS (SELECT o_custkey AS id, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS p FROM orders WHERE o_totalprice > 200000),
s AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS closed, count(*) FILTER (WHERE p) AS y, count(*) FILTER (WHERE NOT p) AS n, count(v.id) FILTER (WHERE p IS NULL) AS u FROM customer LEFT JOIN v ON v.id = c_custkey GROUP BY ALL)"""


def sets_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = F.col("o_orderstatus")
    values = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("id"), F.when(s == "O", True).when(s == "F", False).alias("value"))
    return values, t.customer.select(F.col("c_custkey").alias("id"))


@query(f"WITH {SETS} SELECT id, CASE WHEN y > 0 THEN 'Permitted' WHEN u = 0 AND closed THEN 'Denied' ELSE 'Undetermined' END AS decision FROM s")
def elig_some_value(t: Tables) -> DataFrame:
    return eligibility.read_set(*sets_of(t), "id", "SomeValue", F.col("id") % 2 == 0).select("id", kleene.decision(F.col("value")).alias("decision"))


@query(f"WITH {SETS} SELECT id, CASE WHEN n > 0 THEN 'Denied' WHEN u = 0 AND closed THEN 'Permitted' ELSE 'Undetermined' END AS decision FROM s")
def elig_every_value(t: Tables) -> DataFrame:
    return eligibility.read_set(*sets_of(t), "id", "EveryValue", F.col("id") % 2 == 0).select("id", kleene.decision(F.col("value")).alias("decision"))


@query(f"WITH {SETS} SELECT id, CASE WHEN n > 0 THEN 'Permitted' WHEN u = 0 AND closed THEN 'Denied' ELSE 'Undetermined' END AS decision FROM s")
def elig_negated(t: Tables) -> DataFrame:
    """Negation swaps the decided values after the reading."""
    return eligibility.read_set(*sets_of(t), "id", "EveryValue", F.col("id") % 2 == 0).select("id", kleene.decision(~F.col("value")).alias("decision"))


@query("""WITH ref AS (SELECT DISTINCT s_nationkey AS nk, p_brand AS b FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'),
own AS (SELECT DISTINCT o_custkey AS id, p_brand AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
j AS (SELECT c_custkey AS id, count(*) AS n, count(ref.b) AS hit FROM customer JOIN own ON own.id = c_custkey LEFT JOIN ref ON nk = c_nationkey AND ref.b = own.b GROUP BY 1)
SELECT id, CASE WHEN n = hit THEN 'Subset' WHEN hit > 0 THEN 'Overlaps' ELSE 'Disjoint' END AS relation FROM j""")
def elig_set_compare(t: Tables) -> DataFrame:
    """A subject's set against a reference set: subset, overlapping or disjoint."""
    line = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_suppkey", "l_returnflag", "p_brand")
    ref = line.where("l_returnflag = 'R'").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", F.col("p_brand").alias("rb")).distinct()
    own = line.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "p_brand").distinct()
    j = own.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(ref, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("rb") == F.col("p_brand")), "left")
    g = j.groupBy(F.col("c_custkey").alias("id")).agg(F.count("*").alias("n"), F.count("rb").alias("hit"))
    return g.select("id", F.when(F.col("n") == F.col("hit"), "Subset").when(F.col("hit") > 0, "Overlaps").otherwise("Disjoint").alias("relation"))


CONDITIONS = f"""{CANDIDATES}, cond AS (SELECT id, {IN_RANGE} AS p FROM cand UNION ALL SELECT c_custkey, c_mktsegment <> 'BUILDING' FROM customer
UNION ALL SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END FROM orders WHERE o_totalprice > 300000)"""


def conditions_of(t: Tables) -> DataFrame:
    a = candidates_of(t).select("id", eligibility.interval(F.col("v"), F.col("unit"), RANGES).alias("value"))
    b = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") != "BUILDING").alias("value"))
    s = F.col("o_orderstatus")
    c = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"), F.when(s == "O", True).when(s == "F", False).alias("value"))
    return a.unionByName(b).unionByName(c)


@query(f"WITH {CONDITIONS} SELECT id, CASE WHEN count(*) FILTER (WHERE NOT p) > 0 THEN 'Denied' WHEN count(*) FILTER (WHERE p IS NULL) > 0 THEN 'Undetermined' ELSE 'Permitted' END AS decision FROM cond GROUP BY id")
def profile_all_required(t: Tables) -> DataFrame:
    return eligibility.profile(conditions_of(t), ["id"], "AllRequired").select("id", kleene.decision(F.col("value")).alias("decision"))


@query(f"WITH {CONDITIONS} SELECT id, CASE WHEN count(*) FILTER (WHERE p) > 0 THEN 'Permitted' WHEN count(*) FILTER (WHERE p IS NULL) > 0 THEN 'Undetermined' ELSE 'Denied' END AS decision FROM cond GROUP BY id")
def profile_any_sufficient(t: Tables) -> DataFrame:
    return eligibility.profile(conditions_of(t), ["id"], "AnySufficient").select("id", kleene.decision(F.col("value")).alias("decision"))


@query(f"WITH {CANDIDATES} SELECT 'interval' AS rule, id AS focus, CASE WHEN {IN_RANGE} IS NULL THEN 'Warning' ELSE 'Violation' END AS severity FROM cand WHERE NOT coalesce({IN_RANGE}, false)")
def elig_violations(t: Tables) -> DataFrame:
    value = eligibility.interval(F.col("v"), F.col("unit"), RANGES)
    return candidates_of(t).select(F.lit("interval").alias("rule"), F.col("id").alias("focus"), value.alias("p")).where("NOT coalesce(p, false)").select("rule", "focus", F.when(F.col("p").isNull(), "Warning").otherwise("Violation").alias("severity"))


@query("SELECT c_custkey AS question, 'Undetermined' AS decision, 'MissingCandidate' AS diagnostic FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rule_undetermined(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("question"), F.lit("Undetermined").alias("decision"), F.lit("MissingCandidate").alias("diagnostic"))


# ---- bindings ----

BINDINGS = [
    ("b1", "k1", "s1", ["A"], "1995-01-01", "1999-01-01"), ("b2", "k1", "s2", ["A", "O"], "1996-01-01", None), ("b3", "k1", "s3", ["O"], "1995-01-01", None),
    ("b4", "k2", "s4", [], "1995-01-01", None), ("b5", "k2", "s5", ["B", "F"], "1997-01-01", "2000-01-01"), ("b6", "k2", "s6", ["B", "P"], "1995-01-01", None),
]
CLOSURES = [("b1", "1998-06-01"), ("b1", "1998-09-01"), ("b5", "2001-01-01")]
BIND = """b(node, contract, scheme, scopes, vf, vt0) AS (VALUES ('b1', 'k1', 's1', ['A'], TIMESTAMP '1995-01-01', TIMESTAMP '1999-01-01'),
('b2', 'k1', 's2', ['A', 'O'], TIMESTAMP '1996-01-01', NULL), ('b3', 'k1', 's3', ['O'], TIMESTAMP '1995-01-01', NULL), ('b4', 'k2', 's4', CAST([] AS VARCHAR[]), TIMESTAMP '1995-01-01', NULL),
('b5', 'k2', 's5', ['B', 'F'], TIMESTAMP '1997-01-01', TIMESTAMP '2000-01-01'), ('b6', 'k2', 's6', ['B', 'P'], TIMESTAMP '1995-01-01', NULL)),
cl(node, closed) AS (VALUES ('b1', TIMESTAMP '1998-06-01'), ('b1', TIMESTAMP '1998-09-01'), ('b5', TIMESTAMP '2001-01-01')),
e AS (SELECT b.node, contract, scheme, scopes, vf, CASE WHEN min(closed) IS NULL THEN vt0 WHEN vt0 IS NULL THEN min(closed) ELSE least(vt0, min(closed)) END AS vt FROM b LEFT JOIN cl USING (node) GROUP BY b.node, contract, scheme, scopes, vf, vt0),
c AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'k1' WHEN 1 THEN 'k2' ELSE 'k3' END AS contract, [CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END, o_orderstatus] AS ctx, o_orderdate AS moment FROM orders),
ap AS (SELECT c.id, e.node, e.scheme, e.scopes FROM c JOIN e ON e.contract = c.contract AND list_has_all(ctx, scopes) AND c.moment >= vf AND (vt IS NULL OR c.moment < vt)),
mx AS (SELECT * FROM ap WHERE NOT EXISTS (SELECT 1 FROM ap o WHERE o.id = ap.id AND list_has_all(o.scopes, ap.scopes) AND len(o.scopes) > len(ap.scopes)))"""


def bindings_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    b = t.values(BINDINGS, "node string, contract string, scheme string, scopes array<string>, valid_from string, valid_to string")
    b = b.withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})
    closures = t.values(CLOSURES, "binding string, closed_at string").withColumn("closed_at", F.col("closed_at").cast("timestamp"))
    contexts = t.orders.select(
        F.col("o_orderkey").alias("id"), F.expr("case o_orderkey % 3 when 0 then 'k1' when 1 then 'k2' else 'k3' end").alias("contract"),
        F.array(F.expr("if(o_orderkey % 2 = 0, 'A', 'B')"), "o_orderstatus").alias("context"), F.col("o_orderdate").alias("at"),
    )
    return bindings.effective(b, closures), contexts


@query(f"WITH {BIND} SELECT node, vt AS valid_to FROM e")
def bind_effective_end(t: Tables) -> DataFrame:
    return bindings_of(t)[0].select("node", "valid_to")


@query(f"WITH {BIND} SELECT id, node FROM ap")
def bind_applicable(t: Tables) -> DataFrame:
    return bindings.applicable(*bindings_of(t)).select("id", "node")


@query(f"WITH {BIND} SELECT id, node FROM mx")
def bind_maximal(t: Tables) -> DataFrame:
    return bindings.maximal(bindings.applicable(*bindings_of(t))).select("id", "node")


@query(f"""WITH {BIND}, g AS (SELECT id, count(DISTINCT scheme) AS n, min(scheme) AS s FROM mx GROUP BY id)
SELECT c.id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'conflict' WHEN contract = 'k2' OR contract = 'k1' THEN 'fallback' ELSE 'none' END AS outcome,
CASE WHEN n = 1 THEN s WHEN n IS NULL AND contract = 'k1' THEN 'f1' WHEN n IS NULL AND contract = 'k2' THEN 'f2' END AS scheme FROM c LEFT JOIN g USING (id)""")
def bind_resolve(t: Tables) -> DataFrame:
    return bindings.resolve(*bindings_of(t), t.values([("k1", "f1"), ("k2", "f2")], "contract string, scheme string"))


@query("""WITH r AS (SELECT c_nationkey AS target, c_mktsegment AS dim, max(c_custkey % 5) AS top FROM customer GROUP BY ALL),
n AS (SELECT target, dim, count(*) AS n, min(c_custkey) AS one FROM r JOIN customer ON c_nationkey = target AND c_mktsegment = dim AND c_custkey % 5 = top GROUP BY ALL)
SELECT target, dim, CASE WHEN n = 1 THEN 'chosen' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN one END AS candidate FROM n""")
def profile_resolve(t: Tables) -> DataFrame:
    """The candidate of the highest priority for each target and dimension; a tie is ambiguous."""
    c = t.customer.select(F.col("c_nationkey").alias("target"), F.col("c_mktsegment").alias("dim"), "c_custkey", (F.col("c_custkey") % 5).alias("p"))
    g = c.groupBy("target", "dim", "p").agg(F.count("*").alias("n"), F.min("c_custkey").alias("one")).groupBy("target", "dim").agg(F.max_by(F.struct("n", "one"), "p").alias("t"))
    return g.select("target", "dim", F.when(F.col("t.n") == 1, "chosen").otherwise("ambiguous").alias("outcome"), F.when(F.col("t.n") == 1, F.col("t.one")).alias("candidate"))


@query("""SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'exact' WHEN starts_with(p_name, 'red ') THEN 'prefix' WHEN p_type = 'ECONOMY' THEN 'class' ELSE 'none' END AS matched FROM part""")
def profile_scope_match(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", F.when(n == "red widget", "exact").when(n.startswith("red "), "prefix").when(F.col("p_type") == "ECONOMY", "class").otherwise("none").alias("matched"))


@query("SELECT user_id, event_type AS node, event_id AS mapping FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE r = 1")
def mapping_effective(t: Tables) -> DataFrame:
    """The version of each mapping in force at an instant."""
    e = t.events.where(F.col("ts") <= F.lit("2024-01-15").cast("timestamp"))
    return e.groupBy("user_id", F.col("event_type").alias("node")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("mapping"))


TESTED = """tested AS (SELECT DISTINCT o_custkey AS id, s_nationkey AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey),
v AS (SELECT id, CASE WHEN x.n % 6 = 5 THEN NULL WHEN b.n_regionkey = a.n_regionkey THEN true WHEN id % 3 <> 0 THEN false END AS v, x.n % 6 = 5 AS out
 FROM tested x JOIN customer ON c_custkey = id JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = x.n),
k AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS closed, count(v.id) AS n, count(*) FILTER (WHERE v) AS p, count(*) FILTER (WHERE NOT v) AS d, count(v.id) FILTER (WHERE v IS NULL) AS u, count(*) FILTER (WHERE out) AS out FROM customer LEFT JOIN v ON v.id = c_custkey GROUP BY ALL)"""
READ = {
    "Subset": ("CASE WHEN d > 0 THEN false WHEN n > 0 AND u = 0 AND closed THEN true END", "d > 0", "d = 0 AND u = 0 AND n > 0 AND closed"),
    "Intersects": ("CASE WHEN p > 0 THEN true WHEN n > 0 AND u = 0 AND closed THEN false END", "p = 0 AND u = 0 AND n > 0 AND closed", "p = 0 AND u = 0 AND n > 0 AND closed"),
}


def compare_sql(comparison: str) -> str:
    read, reference, tested = READ["Subset" if comparison == "Subset" else "Intersects"]
    swap = "NOT " if comparison == "Disjoint" else ""
    return f"""WITH {TESTED}, r AS (SELECT *, {read} AS r FROM k) SELECT id, {DECIDE.format(f'({swap}r)')} AS decision,
CASE WHEN n = 0 THEN 'MissingCandidate' WHEN r IS NULL AND out > 0 THEN 'OutsideScheme' WHEN r IS NULL THEN 'NoClosureLicence' END AS diagnostic,
concat_ws(' ', CASE WHEN {reference} THEN 'reference' END, CASE WHEN {tested} THEN 'tested' END) AS closures FROM r"""


def compared(t: Tables, comparison: str) -> DataFrame:
    """The nations that a customer's suppliers are in against the customer's region, along the nations' hierarchy."""
    nation = F.concat(F.lit("N"), F.col("s_nationkey"))
    tested = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("o_custkey").alias("id"), nation.alias("offered"))
    of = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("desc"), F.concat(F.lit("R"), "n_regionkey").alias("anc"), "n_nationkey")
    reference = t.customer.join(of, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("anc").alias("reference"))
    scheme = of.where("n_nationkey % 6 <> 5").select(F.col("desc").alias("concept"))
    subjects = t.customer.select(F.col("c_custkey").alias("id"))
    found = eligibility.compare_sets(tested, reference, subjects, "id", comparison, below=of.select("desc", "anc"), scheme=scheme, tested_closed=F.col("id") % 2 == 0, reference_closed=F.col("id") % 3 != 0)
    return found.select("id", kleene.decision(F.col("value")).alias("decision"), "diagnostic", "closures")


@query(compare_sql("Subset"))
def elig_subset(t: Tables) -> DataFrame:
    return compared(t, "Subset")


@query(compare_sql("Intersects"))
def elig_intersects(t: Tables) -> DataFrame:
    return compared(t, "Intersects")


@query(compare_sql("Disjoint"))
def elig_disjoint(t: Tables) -> DataFrame:
    return compared(t, "Disjoint")


@query(f"WITH {TESTED}, r AS (SELECT *, {READ['Subset'][0]} AS r, {READ['Subset'][1]} AS a, {READ['Subset'][2]} AS b FROM k) SELECT * FROM (SELECT 'reference' AS closure, count(*) AS decisions FROM r WHERE a UNION ALL SELECT 'tested', count(*) FROM r WHERE b) WHERE decisions > 0")
def elig_closures(t: Tables) -> DataFrame:
    """How many decisions rely on each closure."""
    return compared(t, "Subset").select(F.explode(F.split("closures", " ")).alias("closure")).where("closure <> ''").groupBy("closure").agg(F.count("*").alias("decisions"))


@query("""WITH v AS (SELECT o_custkey AS id, min(o_orderdate) AS since, count(*) FILTER (WHERE o_orderstatus = 'O') AS y, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS u FROM orders GROUP BY 1)
SELECT id, CASE WHEN y > 0 THEN 'Permitted' WHEN u = 0 AND id % 5 <> 0 AND (id % 7 = 0 OR since <= TIMESTAMP '1996-01-01') THEN 'Denied' ELSE 'Undetermined' END AS decision FROM v""")
def elig_closure_in_force(t: Tables) -> DataFrame:
    """A set is closed from the day that its closure's source takes effect; without a closure it stays open."""
    s = F.col("o_orderstatus")
    values = t.orders.select(F.col("o_custkey").alias("id"), F.when(s == "O", True).when(s == "F", False).alias("value"))
    first = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("first"))
    closures = first.select("id", F.expr("if(id % 5 = 0, null, 'c' || id)").alias("closure"), F.expr("if(id % 7 = 0, null, first)").alias("valid_from"))
    closed = closures.select("id", eligibility.in_force(closures, F.lit("1996-01-01").cast("timestamp")).alias("closed"))
    return eligibility.read_set(values, closed, "id", "SomeValue", F.col("closed")).select("id", kleene.decision(F.col("value")).alias("decision"))


@query("""WITH c AS (SELECT p_brand AS profile, CASE p_size % 3 WHEN 0 THEN 'AllRequired' WHEN 1 THEN 'AnySufficient' ELSE 'Weighted' END AS aggregation, p_type AS subject, p_partkey % 2 = 0 AS has FROM part WHERE p_size % 10 < 2 OR p_brand < 'Brand#3'),
g AS (SELECT profile, count(*) FILTER (WHERE aggregation = 'Weighted') > 0 OR count(DISTINCT aggregation) > 1 AS a, count(*) FILTER (WHERE has) = 0 AS b, count(DISTINCT subject) FILTER (WHERE has) > 1 AS c FROM c GROUP BY 1)
SELECT profile, 'RefusedOperation' AS reason FROM g WHERE a UNION ALL SELECT profile, 'NoCondition' FROM g WHERE b UNION ALL SELECT profile, 'MixedSubjects' FROM g WHERE c""")
def profile_refused(t: Tables) -> DataFrame:
    """Profiles that no evaluation can read: unknown or mixed aggregation, no condition, subjects of two classes."""
    kind = F.expr("case p_size % 3 when 0 then 'AllRequired' when 1 then 'AnySufficient' else 'Weighted' end")
    rows = t.part.where("p_size % 10 < 2 or p_brand < 'Brand#3'").select(F.col("p_brand").alias("profile"), kind.alias("aggregation"), F.expr("if(p_partkey % 2 = 0, p_partkey, null)").alias("condition"), F.col("p_type").alias("subject"))
    return eligibility.profile_refusals(rows)


@query(f"WITH {CANDIDATES} SELECT 'interval' AS rule, id FROM cand WHERE {IN_RANGE} UNION ALL SELECT 'segment', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def elig_rules(t: Tables) -> DataFrame:
    """Positive rules: what they derive is what the conditions permit."""
    facts = candidates_of(t).join(t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_acctbal"), "id")
    rules = [("interval", [F.coalesce(eligibility.interval(F.col("v"), F.col("unit"), RANGES), F.lit(False))], False), ("segment", [F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 0], False)]
    return eligibility.positive_rules(facts, rules).select("rule", "id")


SPANS = "span AS (SELECT p_type AS c, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1 UNION ALL SELECT p_brand, min(p_size), max(p_size) FROM part WHERE p_size BETWEEN 10 AND 30 GROUP BY 1)"


@query(f"""WITH {SPANS} SELECT a.c AS a, b.c AS b, CASE WHEN a.lo = b.lo AND a.hi = b.hi THEN 'equal' WHEN a.lo >= b.lo AND a.hi <= b.hi THEN 'within' WHEN a.lo <= b.lo AND a.hi >= b.hi THEN 'contains'
WHEN a.hi < b.lo OR b.hi < a.lo THEN 'disjoint' ELSE 'overlaps' END AS relation FROM span a JOIN span b ON a.c < b.c""")
def elig_subsumption(t: Tables) -> DataFrame:
    """Design-time check of declared interval conditions against each other: which subsumes which, which never meet."""
    types = t.part.groupBy(F.col("p_type").alias("c")).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    brands = t.part.where("p_size between 10 and 30").groupBy(F.col("p_brand").alias("c")).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    span = types.unionByName(brands)
    j = span.alias("a").join(span.alias("b"), F.col("a.c") < F.col("b.c"))
    return j.select(F.col("a.c").alias("a"), F.col("b.c").alias("b"), eligibility.relation_of(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi")).alias("relation"))


@query(f"WITH {TRUTH} SELECT id, coalesce(CAST(x AS VARCHAR), 'u') AS a, coalesce(CAST(y AS VARCHAR), 'u') AS b, x IS NULL OR coalesce(x = y, false) AS below FROM truth")
def kleene_information(t: Tables) -> DataFrame:
    """The information order: undetermined lies below everything, and a decided value below itself only."""
    u = F.lit("u")
    return truths_of(t).select("id", F.coalesce(F.col("x").cast("string"), u).alias("a"), F.coalesce(F.col("y").cast("string"), u).alias("b"), kleene.at_least_as_known(F.col("x"), F.col("y")).alias("below"))


@eligibility.composition("Majority")
def majority(value):
    """Decided by more than half of all conditions, undetermined ones included in the whole."""
    p, d, n = F.count_if(value), F.count_if(~value), F.count("*")
    return F.when(2 * p > n, True).when(2 * d > n, False)


@query(f"WITH {CONDITIONS} SELECT id, CASE WHEN 2 * count(*) FILTER (WHERE p) > count(*) THEN 'Permitted' WHEN 2 * count(*) FILTER (WHERE NOT p) > count(*) THEN 'Denied' ELSE 'Undetermined' END AS decision FROM cond GROUP BY id")
def profile_custom(t: Tables) -> DataFrame:
    """A profile composed in a way that the caller has registered."""
    return eligibility.profile(conditions_of(t), ["id"], "Majority").select("id", kleene.decision(F.col("value")).alias("decision"))
