"""Mapping of records to triples, derived data, streaming-shaped folds and the remaining modules."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import digest
from graphloom.operators import cover, fold, graph
from graphloom.sources.tables import EDGES, PATHS, Tables

from .registry import query


@query("SELECT p_partkey AS root FROM part WHERE p_type = 'ECONOMY' OR p_size > 40")
def etl_root(t: Tables) -> DataFrame:
    return t.part.where("p_type = 'ECONOMY' OR p_size > 40").select(F.col("p_partkey").alias("root"))


@query("SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, length(unnest(string_split(text, chr(10)))) AS n FROM documents WHERE text IS NOT NULL")
def etl_child(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).select("doc_id", "place", F.length("line").alias("n"))


@query("""SELECT p_partkey, 'urn:part/' || replace(p_name, ' ', '%20') AS by_template, 'urn:h/' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 16) AS by_hash, 'urn:pos/' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS by_position FROM part""")
def etl_identity(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return t.part.select("p_partkey", F.concat(F.lit("urn:part/"), digest.encode_for_uri(F.col("p_name"))).alias("by_template"), F.concat(F.lit("urn:h/"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 16)).alias("by_hash"), F.concat(F.lit("urn:pos/"), place.cast("string")).alias("by_position"))


@query("SELECT c_custkey, 'Customer ' || c_name || ' of ' || c_mktsegment || ' in ' || n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def etl_template(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", F.format_string("Customer %s of %s in %s", "c_name", "c_mktsegment", "n_name").alias("label"))


ASSERT = """SELECT 'P' || p_partkey AS s, 'type' AS p, 'Part' AS o FROM part UNION ALL SELECT 'P' || p_partkey, 'brand', p_brand FROM part
UNION ALL SELECT p_brand, 'brandOf', 'P' || p_partkey FROM part UNION ALL SELECT 'P' || p_partkey, 'source', 'catalogue' FROM part"""


def triples_of(t: Tables) -> DataFrame:
    """Typing, a property, its inverse and a constant, from one pass over the rows."""
    s, b = F.concat(F.lit("P"), "p_partkey"), F.col("p_brand")
    rows = [(s, "type", F.lit("Part")), (s, "brand", b), (b, "brandOf", s), (s, "source", F.lit("catalogue"))]
    made = F.explode(F.array(*[F.struct(x.alias("s"), F.lit(p).alias("p"), o.alias("o")) for x, p, o in rows]))
    return t.part.select(made.alias("t")).select("t.*")


@query(ASSERT)
def etl_assert(t: Tables) -> DataFrame:
    return triples_of(t)


@query(f"WITH a AS ({ASSERT}) SELECT p AS mapping, count(*) AS n FROM a GROUP BY 1")
def etl_attribution(t: Tables) -> DataFrame:
    return triples_of(t).groupBy(F.col("p").alias("mapping")).agg(F.count("*").alias("n"))


@query("SELECT p_type AS class, string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS members FROM part GROUP BY 1")
def etl_schema_from_data(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("class")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), " ").alias("members"))


@query(f"WITH a AS ({ASSERT}) SELECT DISTINCT a.o AS brand, 'hasPartsIn' AS p, p_type AS o FROM a JOIN part ON 'P' || p_partkey = a.s WHERE a.p = 'brand'")
def etl_strata(t: Tables) -> DataFrame:
    """A second stratum reads what the first wrote."""
    first = triples_of(t).where("p = 'brand'").select("s", F.col("o").alias("brand"))
    return t.part.withColumn("s", F.concat(F.lit("P"), "p_partkey")).join(first, "s").select("brand", F.lit("hasPartsIn").alias("p"), F.col("p_type").alias("o")).distinct()


@query("""WITH m(raw) AS (VALUES ('ECONOMY'), ('STANDARD')) SELECT 'UnmappedValue' AS code, p_type AS focus, count(*) AS n FROM part WHERE p_type NOT IN (SELECT raw FROM m) GROUP BY ALL
UNION ALL SELECT 'IdentityAmbiguous', p_name, count(*) FROM part GROUP BY ALL HAVING count(*) > 30 UNION ALL SELECT 'LookupUnresolved', CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def etl_findings(t: Tables) -> DataFrame:
    unmapped = t.part.where("p_type NOT IN ('ECONOMY', 'STANDARD')").groupBy(F.col("p_type").alias("focus")).agg(F.count("*").alias("n")).select(F.lit("UnmappedValue").alias("code"), "focus", "n")
    many = t.part.groupBy(F.col("p_name").alias("focus")).agg(F.count("*").alias("n")).where("n > 30").select(F.lit("IdentityAmbiguous").alias("code"), "focus", "n")
    lost = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("LookupUnresolved").alias("code"), F.col("c_custkey").cast("string").alias("focus"), F.lit(1).cast("long").alias("n"))
    return unmapped.unionByName(many).unionByName(lost)


@query("SELECT event_id, 'k' AS path, CAST(json_extract_string(props, '$.k') AS INTEGER) AS value FROM events")
def etl_json_plan(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("path", "value"))


@query("""WITH c AS (SELECT user_id, event_type, round(min(value) / 1000, 6) AS local FROM events GROUP BY ALL) SELECT user_id, round(min(local), 6) AS confidence FROM c GROUP BY 1""")
def dag_confidence(t: Tables) -> DataFrame:
    """A node's confidence is bounded by the least of its children."""
    c = t.events.groupBy("user_id", "event_type").agg(F.round(F.min("value") / 1000, 6).alias("local"))
    return c.groupBy("user_id").agg(F.round(F.min("local"), 6).alias("confidence"))


@query("SELECT p_partkey, round(p_retailprice * 1.2 + p_size, 4) AS priced, upper(p_brand) || ':' || p_type AS label FROM part")
def etl_dag_eval(t: Tables) -> DataFrame:
    """Mapping nodes as column expressions in the order of their dependencies; Catalyst collapses the chain."""
    d = t.part.withColumn("taxed", F.col("p_retailprice") * 1.2).withColumn("priced", F.round(F.col("taxed") + F.col("p_size"), 4))
    return d.withColumn("brand", F.upper("p_brand")).select("p_partkey", "priced", F.concat_ws(":", "brand", "p_type").alias("label"))


@query("""SELECT n_nationkey, '{"@id":"N' || n_nationkey || '","name":"' || n_name || '","in":"R' || n_regionkey || '"}' AS frame FROM nation""")
def egress_json(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.to_json(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("@id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("in"))).alias("frame"))


@query("""WITH leaf AS (SELECT o_orderkey AS id, o_custkey, sha256(o_orderstatus || '|' || o_orderpriority) AS h FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, h ORDER BY id) AS k FROM leaf)
SELECT id, 'b' || substr(sha256('C' || o_custkey || '|placed|' || h || '|' || k), 1, 16) AS name FROM n""")
def skolem_tree(t: Tables) -> DataFrame:
    """Names of blank nodes in a tree: parent, predicate, hash of the description and the number among equal siblings."""
    h = F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256)
    k = F.row_number().over(Window.partitionBy("o_custkey", "h").orderBy("o_orderkey"))
    return t.orders.withColumn("h", h).withColumn("k", k).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("b"), F.substring(F.sha2(F.concat(F.lit("C"), "o_custkey", F.lit("|placed|"), "h", F.lit("|"), "k"), 256), 1, 16)).alias("name"))


# ---- derived data ----


@query("SELECT c_custkey, r_name AS promoted FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def surf_promotion(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("promoted"))


@query("SELECT p_size AS value, count(*) AS n, string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS carriers FROM part GROUP BY 1")
def surf_index(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_size").alias("value")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), " ").alias("carriers"))


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT child AS "desc", parent AS anc FROM edge WHERE child[1:1] <> 'C' UNION SELECT r."desc", e.parent FROM r JOIN edge e ON e.child = r.anc) SELECT * FROM r""")
def surf_closure(t: Tables) -> DataFrame:
    return graph.closure(t.account_edges().where("child NOT LIKE 'C%'"))


@query("""WITH rec AS (SELECT o_custkey AS k, sum(o_orderkey) AS d FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1), cur AS (SELECT o_custkey AS k, sum(o_orderkey) AS d FROM orders GROUP BY 1)
SELECT cur.k, CASE WHEN rec.d IS NULL THEN 'missing' WHEN rec.d IS DISTINCT FROM cur.d THEN 'stale' ELSE 'fresh' END AS state FROM cur LEFT JOIN rec USING (k)""")
def surf_freshness(t: Tables) -> DataFrame:
    rec = t.orders.where("o_orderkey % 50 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_orderkey").alias("was"))
    cur = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_orderkey").alias("now"))
    return cur.join(rec, "k", "left").select("k", F.when(F.col("was").isNull(), "missing").when(~F.col("was").eqNullSafe(F.col("now")), "stale").otherwise("fresh").alias("state"))


@query("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1")
def surf_incremental(t: Tables) -> DataFrame:
    """Only carriers touched by new rows are computed again; the rest comes from the state before."""
    old, new = t.orders.where("o_orderkey % 50 <> 0"), t.orders.where("o_orderkey % 50 = 0").select("o_custkey").distinct()
    before = old.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    again = t.orders.join(new, "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return before.join(again.select("k"), "k", "left_anti").unionByName(again)


@query("SELECT c_mktsegment AS part, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 UNION ALL SELECT 'BUILDING', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def surf_refresh(t: Tables) -> DataFrame:
    """One partition overwritten, the others kept."""
    kept = t.customer.where("c_mktsegment <> 'BUILDING'").groupBy(F.col("c_mktsegment").alias("part")).agg(F.count("*").alias("n"))
    return kept.unionByName(t.customer.where("c_mktsegment = 'BUILDING' AND c_acctbal >= 0").agg(F.lit("BUILDING").alias("part"), F.count("*").alias("n")))


@query("SELECT DISTINCT l_partkey AS asset, s_nationkey AS location, l_returnflag AS peril FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def derive_units(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("asset"), F.col("s_nationkey").alias("location"), F.col("l_returnflag").alias("peril")).distinct()


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 11 = 0 THEN 'own' END, CASE WHEN n_nationkey % 4 = 0 THEN 'nation' END, CASE WHEN n_regionkey % 2 = 0 THEN 'region' END, 'root') AS nearest FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def derive_nearest(t: Tables) -> DataFrame:
    """The nearest override up the tree, by the least depth that has one."""
    key = F.substring("anc", 2, 20).try_cast("long")
    kind = F.substring("anc", 1, 1)
    value = F.when((kind == "C") & (key % 11 == 0), "own").when((kind == "N") & (key % 4 == 0), "nation").when((kind == "R") & (key % 2 == 0), "region").when(F.col("anc") == "ALL", "root")
    p = t.account_paths().where("desc LIKE 'C%'").withColumn("v", value).where("v is not null")
    return p.groupBy("desc").agg(F.min_by("v", "depth").alias("nearest")).select(F.substring("desc", 2, 20).cast("long").alias("c_custkey"), "nearest")


@query("""WITH sig AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS sig FROM orders GROUP BY 1) SELECT sig, count(*) AS n, min(o_custkey) AS shared FROM sig GROUP BY 1""")
def derive_cover(t: Tables) -> DataFrame:
    sig = t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("sig"))
    return sig.groupBy("sig").agg(F.count("*").alias("n"), F.min("o_custkey").alias("shared"))


@query(f"""WITH RECURSIVE {PATHS}, m AS (SELECT o_orderpriority AS owner, 'C' || o_custkey AS node FROM orders WHERE o_totalprice > 300000
UNION SELECT o_orderpriority, 'N' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 380000 AND o_orderkey % 3 = 0)
SELECT owner, node FROM m WHERE NOT EXISTS (SELECT 1 FROM path p JOIN m x ON x.node = p.anc WHERE p."desc" = m.node AND p.anc <> m.node AND x.owner = m.owner)""")
def derive_topmost(t: Tables) -> DataFrame:
    """Accounts of large orders for each priority, without those below another one of them."""
    large = t.orders.where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("owner"), F.concat(F.lit("C"), "o_custkey").alias("node"))
    nations = t.orders.where("o_totalprice > 380000 AND o_orderkey % 3 = 0").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderpriority").alias("owner"), F.concat(F.lit("N"), "c_nationkey").alias("node"))
    return cover.topmost(large.unionByName(nations), t.account_paths())


@query("""WITH i AS (SELECT DISTINCT o_custkey AS owner, left(o_orderpriority, 1) || o_orderstatus AS item FROM orders), s AS (SELECT owner, list_sort(list(item)) AS items FROM i GROUP BY 1),
k AS (SELECT items, min(owner) AS shared FROM s GROUP BY 1), top AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE len(x.items) > len(k.items) AND list_has_all(x.items, k.items)))
SELECT owner, shared FROM s JOIN top USING (items)""")
def derive_maximal(t: Tables) -> DataFrame:
    """Customers whose set of kinds of orders no other set exceeds, with the first customer of the same set."""
    return cover.maximal_sets(t.orders.select(F.col("o_custkey").alias("owner"), F.concat(F.substring("o_orderpriority", 1, 1), "o_orderstatus").alias("item")))


@query("SELECT 'C' || c_custkey AS element FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2 AND n_nationkey % 3 <> 0 AND c_acctbal > 0")
def assemble_tree(t: Tables) -> DataFrame:
    """Walk down included elements only: an excluded node hides all below it."""
    kept_n = t.nation.where("n_regionkey <> 2 AND n_nationkey % 3 <> 0").select("n_nationkey")
    return t.customer.where("c_acctbal > 0").join(kept_n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.concat(F.lit("C"), "c_custkey").alias("element"))


# ---- the remaining modules ----


@query("""WITH a AS (SELECT doc_id, quality AS v FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS v FROM labels WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN a.v IS NULL THEN 'only declared' WHEN b.v IS NULL THEN 'only read' ELSE 'disagree' END AS finding FROM a FULL JOIN b USING (doc_id) WHERE a.v IS DISTINCT FROM b.v""")
def fact_diff(t: Tables) -> DataFrame:
    a = t.labels.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("a"))
    b = t.labels.where("doc_id % 5 <> 0").select("doc_id", F.expr("if(doc_id % 10 = 0, 1 - quality, quality)").alias("b"))
    j = a.join(b, "doc_id", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select("doc_id", F.when(F.col("a").isNull(), "only declared").when(F.col("b").isNull(), "only read").otherwise("disagree").alias("finding"))


@query("SELECT d.doc_id, sha256(CASE WHEN l.doc_id IS NULL THEN 'absent' WHEN quality IS NULL THEN 'unknown' ELSE 'value:' || quality END) AS digest FROM documents d LEFT JOIN labels l USING (doc_id)")
def fact_digest(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality", F.lit(True).alias("said")), "doc_id", "left")
    state = F.when(F.col("said").isNull(), "absent").when(F.col("quality").isNull(), "unknown").otherwise(F.concat(F.lit("value:"), F.col("quality").cast("string")))
    return j.select("doc_id", F.sha2(state, 256).alias("digest"))


@query("SELECT p_brand, CAST(sum(p_size * 10) // gcd(min(p_size * 10), max(p_size * 10)) AS BIGINT) AS weight FROM part GROUP BY 1")
def share_weights(t: Tables) -> DataFrame:
    """Shares scaled to whole numbers and divided by a common divisor (of the least and the largest), by Euclid's steps."""
    g = t.part.groupBy("p_brand").agg(F.sum(F.col("p_size") * 10).alias("s"), F.min(F.col("p_size") * 10).cast("long").alias("lo"), F.max(F.col("p_size") * 10).cast("long").alias("hi"))
    euclid = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))))
    return g.withColumn("d", euclid["a"]).select("p_brand", F.expr("s div d").alias("weight"))


@query("""WITH a AS (SELECT DISTINCT regexp_replace(url, '[0-9]+', '#', 'g') AS p FROM pages WHERE page_id % 2 = 0), b AS (SELECT DISTINCT regexp_replace(url, '[0-9]+', '#', 'g') AS p FROM pages WHERE page_id % 2 = 1)
SELECT (SELECT count(*) FROM (SELECT p FROM a INTERSECT SELECT p FROM b)) AS shared, round((SELECT count(*) FROM (SELECT p FROM a INTERSECT SELECT p FROM b)) / (SELECT count(*) FROM (SELECT p FROM a UNION SELECT p FROM b)), 6) AS agreement""")
def pattern_agreement(t: Tables) -> DataFrame:
    """Patterns of names with their minted numbers taken out, and the share that two halves have in common."""
    g = t.pages.select(F.regexp_replace("url", "[0-9]+", "#").alias("p"), (F.col("page_id") % 2).alias("half")).groupBy("p").agg(F.count_distinct("half").alias("n"))
    return g.agg(F.count_if(F.col("n") == 2).alias("shared"), F.round(F.count_if(F.col("n") == 2) / F.count("*"), 6).alias("agreement"))


# ---- ordered logs in batch form ----


@query("SELECT event_id, user_id % 8 AS part, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS position FROM events")
def stream_partition(t: Tables) -> DataFrame:
    part = F.col("user_id") % 8
    return t.events.select("event_id", part.alias("part"), (F.row_number().over(Window.partitionBy(part).orderBy("event_id")) - 1).alias("position"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, i, event_id, sha256('' || '|' || event_id || '|' || event_type) AS hash FROM o WHERE i = 1 UNION ALL
SELECT o.user_id, o.i, o.event_id, sha256(r.hash || '|' || o.event_id || '|' || o.event_type) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT event_id, hash FROM r""")
def journal_hash_chain(t: Tables) -> DataFrame:
    """Each entry's hash covers the one before: an ordered fold over the session's entries."""

    def step(before: str, row: tuple) -> tuple:
        entry, kind = row
        now = hashlib.sha256(f"{before}|{entry}|{kind}".encode()).hexdigest()
        return now, (entry, now)

    return fold.ordered_fold(t.events, ["user_id"], ["event_id"], ["event_id", "event_type"], lambda row: "", step, "event_id long, hash string")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def journal_order(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("position"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS undo FROM events WHERE event_type IN ('purchase', 'signup')")
def compensation_order(t: Tables) -> DataFrame:
    return t.events.where("event_type IN ('purchase', 'signup')").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc())).alias("undo"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND value > 80 THEN 'permanent' WHEN event_type = 'error' THEN 'transient' ELSE 'none' END AS class FROM events")
def error_class(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when((F.col("event_type") == "error") & (F.col("value") > 80), "permanent").when(F.col("event_type") == "error", "transient").otherwise("none").alias("class"))


@query("""WITH e AS (SELECT user_id, event_id, ts, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events WHERE event_type = 'error')
SELECT event_id, CAST(least(60, power(2, attempt - 1)) AS INTEGER) AS wait_s FROM e""")
def stream_backoff(t: Tables) -> DataFrame:
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.where("event_type = 'error'").withColumn("a", attempt).select("event_id", F.least(F.lit(60), F.pow(F.lit(2), F.col("a") - 1)).cast("int").alias("wait_s"))


@query("SELECT DISTINCT p.event_id AS signal, v.event_id AS subscription FROM events p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'signup' AND v.event_id < p.event_id WHERE p.event_type = 'purchase'")
def stream_correlate(t: Tables) -> DataFrame:
    """Each signal with every subscription of its key before it."""
    e = t.events.select("event_id", "user_id", "event_type")
    p, v = e.where("event_type = 'purchase'").alias("p"), e.where("event_type = 'signup'").alias("v")
    return p.join(v, (F.col("v.user_id") == F.col("p.user_id")) & (F.col("v.event_id") < F.col("p.event_id"))).select(F.col("p.event_id").alias("signal"), F.col("v.event_id").alias("subscription")).distinct()


@query("SELECT o_orderkey, coalesce(relational.n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) relational ON l_orderkey = o_orderkey")
def summary_counts(t: Tables) -> DataFrame:
    """Aggregate before the join: one row for each key meets the orders."""
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t.orders.join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"))
