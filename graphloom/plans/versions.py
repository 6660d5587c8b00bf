"""Versioned writes, audits, keys and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import digest
from graphloom.operators import relational, versions
from graphloom.sources.shared import scratch
from graphloom.sources.store import GraphStore, MemorySink, digest_tree, digest_tree_sql, published
from graphloom.sources.tables import QUADS, Tables

from .registry import query


@query("SELECT o_custkey AS root, o_orderkey AS txn, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders")
def ver_append(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("txn"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("seq"))


@query("SELECT DISTINCT user_id AS root FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def ver_create(t: Tables) -> DataFrame:
    """Only roots that are absent are created."""
    return t.events.select(F.col("user_id").alias("root")).distinct().join(t.orders.where("o_orderstatus = 'P'"), F.col("root") == F.col("o_custkey"), "left_anti")


@query("""WITH h AS (SELECT o_custkey AS root, count(*) AS seq FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), w AS (SELECT o_orderkey AS txn, o_custkey AS root, o_orderkey % 8 AS expected FROM orders WHERE o_orderstatus <> 'F'),
j AS (SELECT w.*, coalesce(seq, 0) AS seq, row_number() OVER (PARTITION BY root, expected ORDER BY txn) AS k FROM w LEFT JOIN h USING (root))
SELECT txn, root, CASE WHEN expected <> seq THEN 'conflict' WHEN k = 1 THEN 'applied' ELSE 'lost' END AS outcome, CASE WHEN expected = seq AND k = 1 THEN seq + 1 END AS seq FROM j""")
def ver_cas_replace(t: Tables) -> DataFrame:
    heads = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("root")).agg(F.count("*").alias("seq"))
    writes = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("txn"), F.col("o_custkey").alias("root"), (F.col("o_orderkey") % 8).alias("expected"))
    return versions.compare_and_set(heads, writes)


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS s, l_returnflag AS o FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_orderkey AS s, l_returnflag AS o FROM lineitem WHERE l_linenumber >= 3)
SELECT *, 'del' AS op FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'add' AS op FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def ver_delta_replace(t: Tables) -> DataFrame:
    line = t.lineitem.select(F.col("l_orderkey").alias("s"), F.col("l_returnflag").alias("o"), "l_linenumber")
    return relational.signed_difference(line.where("l_linenumber <= 4").drop("l_linenumber").distinct(), line.where("l_linenumber >= 3").drop("l_linenumber").distinct())


@query("SELECT o_custkey AS root, max(o_orderkey) AS seq FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) <> 'P'")
def ver_tombstone(t: Tables) -> DataFrame:
    """Roots whose last version is not a tombstone."""
    g = t.orders.groupBy(F.col("o_custkey").alias("root")).agg(F.max("o_orderkey").alias("seq"), F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    return g.where("s <> 'P'").select("root", "seq")


@query("SELECT c_custkey, CASE WHEN c_acctbal = round(c_acctbal, 2) AND c_mktsegment = 'BUILDING' THEN 'written' ELSE 'refused' END AS outcome, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS value FROM customer")
def ver_value_guard(t: Tables) -> DataFrame:
    ok = (F.col("c_acctbal") == F.round("c_acctbal", 2)) & (F.col("c_mktsegment") == "BUILDING")
    return t.customer.select("c_custkey", F.when(ok, "written").otherwise("refused").alias("outcome"), F.when(ok, "HOUSING").otherwise(F.col("c_mktsegment")).alias("value"))


@query("SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS member FROM orders WHERE o_custkey = 11 UNION ALL SELECT 'line', l_orderkey || '/' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 11")
def ver_composite(t: Tables) -> DataFrame:
    """An aggregate's members along the paths it owns."""
    own = t.orders.where("o_custkey = 11")
    lines = t.lineitem.join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    return own.select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("member")).unionByName(lines.select(F.lit("line").alias("kind"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("member")))


@query("SELECT o_orderkey AS version, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS head FROM orders")
def ver_append_version(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return t.orders.select(F.col("o_orderkey").alias("version"), F.lag("o_orderkey").over(w.orderBy("o_orderkey")).alias("previous"), (F.col("o_orderkey") == F.max("o_orderkey").over(w)).alias("head"))


EVENTS = "ev AS (SELECT user_id AS root, event_id AS seq, CASE WHEN event_type IN ('error', 'click') THEN 'drop' ELSE 'add' END AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS member FROM events)"


def events_of(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("root"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("error", "click"), "drop").otherwise("add").alias("kind"), F.from_json("props", "k int")["k"].alias("member"))


@query(f"WITH {EVENTS} SELECT root, member FROM ev WHERE seq <= (SELECT max(seq) FROM ev) GROUP BY ALL HAVING arg_max(kind, seq) = 'add'")
def ver_members(t: Tables) -> DataFrame:
    """Members at the head from a checkpoint, every hundredth part of the log, and the deltas after it."""
    ev = events_of(t)
    head = ev.agg(F.max("seq")).first()[0] or 0
    at = head - head % 100
    keys = ["root", "member"]
    checkpoint = ev.where(f"seq <= {at}").groupBy(*keys).agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
    deltas = ev.where(f"seq > {at}").select(*keys, "kind", "seq")
    return versions.last_event(checkpoint.unionByName(deltas), keys, ["seq"], "kind", "drop")


@query(f"WITH {EVENTS} SELECT root, member FROM ev GROUP BY ALL HAVING arg_max(kind, seq) = 'add'")
def ver_patch_replay(t: Tables) -> DataFrame:
    return versions.last_event(events_of(t), ["root", "member"], ["seq"], "kind", "drop")


@query("SELECT DISTINCT l_orderkey AS subject FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0)")
def ver_outside_bound(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("subject")).distinct().join(t.orders.where("o_custkey % 2 = 0"), F.col("subject") == F.col("o_orderkey"), "left_anti")


@query("SELECT o_custkey AS root, o_orderkey AS seq, o_orderstatus FROM orders WHERE o_custkey IN (3, 5, 8)")
def ver_rows_of(t: Tables) -> DataFrame:
    return t.orders.join(F.broadcast(t.values([(3,), (5,), (8,)], "o_custkey long")), "o_custkey", "left_semi").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("seq"), "o_orderstatus")


CLAIMS = "claim AS (SELECT DISTINCT p_name AS k, p_brand AS owner FROM part WHERE p_size > 40)"


def claims_of(t: Tables) -> DataFrame:
    return t.part.where("p_size > 40").select(F.col("p_name").alias("k"), F.col("p_brand").alias("owner")).distinct()


@query(f"WITH {CLAIMS}, w AS (SELECT DISTINCT p_name AS k, p_brand AS owner FROM part WHERE p_size < 5) SELECT w.k, w.owner FROM w WHERE NOT EXISTS (SELECT 1 FROM claim c WHERE c.k = w.k AND c.owner <> w.owner)")
def key_claim(t: Tables) -> DataFrame:
    """New claims that no other owner holds."""
    w = t.part.where("p_size < 5").select(F.col("p_name").alias("k"), F.col("p_brand").alias("owner")).distinct()
    held = claims_of(t).select(F.col("k").alias("_k"), F.col("owner").alias("_o"))
    return w.join(held, (F.col("k") == F.col("_k")) & (F.col("owner") != F.col("_o")), "left_anti")


@query(f"WITH {CLAIMS} SELECT k, count(*) AS owners, string_agg(owner, ' ' ORDER BY owner) AS who FROM claim GROUP BY k HAVING count(*) > 1")
def key_claim_duplicates(t: Tables) -> DataFrame:
    return claims_of(t).groupBy("k").agg(F.count("*").alias("owners"), F.array_join(F.array_sort(F.collect_list("owner")), " ").alias("who")).where("owners > 1")


@query(f"WITH {CLAIMS} SELECT k, min(owner) AS owner FROM claim GROUP BY k")
def key_claim_merge(t: Tables) -> DataFrame:
    return claims_of(t).groupBy("k").agg(F.min("owner").alias("owner"))


@query("SELECT l_orderkey AS rev, count(DISTINCT l_suppkey) AS txns FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def audit_fork(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("rev")).agg(F.count_distinct("l_suppkey").alias("txns")).where("txns > 1")


@query("SELECT l_suppkey AS txn, count(DISTINCT l_orderkey) AS revs FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def audit_txn(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("txn")).agg(F.count_distinct("l_orderkey").alias("revs")).where("revs > 1")


@query("SELECT l_orderkey AS target, min(l_linenumber) AS low, max(l_linenumber) AS high, max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS missing FROM lineitem GROUP BY 1 HAVING max(l_linenumber) - min(l_linenumber) + 1 <> count(DISTINCT l_linenumber)")
def audit_gap(t: Tables) -> DataFrame:
    return versions.gaps(t.lineitem.withColumnRenamed("l_orderkey", "target"), "target", "l_linenumber")


@query("WITH " + digest_tree_sql("SELECT o_custkey AS root, o_orderkey || chr(9) || o_orderstatus AS row FROM orders", ["root"]) + " SELECT root, digest FROM tree")
def state_digest(t: Tables) -> DataFrame:
    """A digest of each root's state, as a tree over its rows' hashes: no group is gathered whole."""
    rows = t.orders.select(F.col("o_custkey").alias("root"), F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("row"))
    return digest_tree(rows, ["root"], "row").select("root", "digest")


@query("WITH " + digest_tree_sql("SELECT o_orderpriority AS k, o_orderkey || chr(9) || o_orderstatus || chr(9) || o_totalprice AS row FROM orders", ["k"]) + " SELECT k, 'urn:v/' || digest AS version, n FROM tree")
def surf_version_iri(t: Tables) -> DataFrame:
    """A version named by the digest of its content, written to a folder of that name once: a second publication finds it there."""
    rows = t.orders.select(F.col("o_orderpriority").alias("k"), F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string")).alias("row"))
    folder = scratch(t.spark)
    first, second = published(rows, folder, "row"), published(rows, folder, "row")
    if first != second:
        raise RuntimeError("equal content has two names")
    return digest_tree(t.spark.read.parquet(first), ["k"], "row").select("k", F.concat(F.lit("urn:v/"), "digest").alias("version"), F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey, sha256(strlen(o_orderstatus) || ':' || o_orderstatus || strlen(o_orderpriority) || ':' || o_orderpriority) AS digest FROM orders")
def request_digest(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", digest.tuple_digest(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("digest"))


@query("SELECT doc_id, sha256(strlen(lang) || ':' || lang || strlen(source) || ':' || source || strlen(text) || ':' || text) AS digest FROM documents")
def digest_tuple(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", digest.tuple_digest(F.col("lang"), F.col("source"), F.col("text")).alias("digest"))


@query("SELECT p_partkey, sha256(p_name) AS hex, rtrim(translate(to_base64(unhex(sha256(p_name))), '+/', '-_'), '=') AS b64 FROM part")
def digest_encode(t: Tables) -> DataFrame:
    hex_ = F.sha2("p_name", 256)
    return t.part.select("p_partkey", hex_.alias("hex"), digest.base64url(hex_).alias("b64"))


@query("SELECT p_partkey, 'urn:part/' || replace(p_name, ' ', '%20') || '/' || substr(sha256(strlen(p_brand) || ':' || p_brand), 1, 12) AS iri FROM part")
def mint_iri(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("urn:part/"), digest.encode_for_uri(F.col("p_name")), F.lit("/"), F.substring(digest.tuple_digest(F.col("p_brand")), 1, 12)).alias("iri"))


@query("""WITH h AS (SELECT p_partkey, substr(sha256(p_name), 1, 32) AS h FROM part) SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' ||
substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def mint_uuid(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", digest.uuid4(F.sha2("p_name", 256)).alias("uuid"))


@query("SELECT page_id, regexp_extract(url, '([^/#]*)$', 1) AS name FROM pages")
def local_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", digest.local_name(F.col("url")).alias("name"))


@query("""WITH a AS (SELECT o_custkey % 10 AS audit, count(*) AS seen, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 400000) AS bad FROM orders GROUP BY 1), n AS (SELECT unnest(range(0, 12)) AS audit)
SELECT n.audit, CASE WHEN seen IS NULL THEN 'nothing examined' WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM n LEFT JOIN a USING (audit)""")
def audit_outcome(t: Tables) -> DataFrame:
    a = t.orders.groupBy((F.col("o_custkey") % 10).alias("audit")).agg(F.count("*").alias("seen"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)).alias("bad"))
    return t.spark.range(12).withColumnRenamed("id", "audit").join(a, "audit", "left").select("audit", F.when(F.col("seen").isNull(), "nothing examined").when(F.col("bad") > 0, "fail").otherwise("pass").alias("outcome"))


@query("""SELECT 'latest' AS branch, o_custkey AS root, max(o_orderkey) AS seq FROM orders GROUP BY ALL UNION ALL SELECT 'default', c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'urgent', o_custkey, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL UNION ALL SELECT 'live', c_custkey, c_nationkey FROM customer WHERE c_acctbal >= 0""")
def summary_union(t: Tables) -> DataFrame:
    o, c = t.orders, t.customer
    latest = o.groupBy(F.col("o_custkey").alias("root")).agg(F.max("o_orderkey").alias("seq")).select(F.lit("latest").alias("branch"), "root", "seq")
    default = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("default").alias("branch"), F.col("c_custkey").alias("root"), F.lit(0).cast("long").alias("seq"))
    urgent = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("root")).agg(F.count("*").alias("seq")).select(F.lit("urgent").alias("branch"), "root", "seq")
    live = c.where("c_acctbal >= 0").select(F.lit("live").alias("branch"), F.col("c_custkey").alias("root"), F.col("c_nationkey").cast("long").alias("seq"))
    return latest.unionByName(default).unionByName(urgent).unionByName(live)


@query("SELECT o_orderkey AS job, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey % 3 = 0")
def jobs_unfinished(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus IN ('O', 'P') AND o_custkey % 3 = 0").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey AS job FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01'")
def jobs_expired(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))).select(F.col("o_orderkey").alias("job"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), lower('RED')) ORDER BY p_name, p_brand, p_partkey LIMIT 50")
def search_terms(t: Tables) -> DataFrame:
    return t.part.where(F.lower("p_name").contains("red")).orderBy("p_name", "p_brand", "p_partkey").limit(50).select("p_partkey", "p_name", "p_brand")


@query(f"WITH {QUADS} SELECT g, count(*) AS n, count(DISTINCT s) AS subjects FROM quad GROUP BY g")
def store_graphs(t: Tables) -> DataFrame:
    """Graphs put into a store, one replaced and one dropped again, listed and read back."""
    store = GraphStore(t.spark)
    q = t.quads()
    for name in ("geo", "party"):
        store.put(name, q.where(F.col("g") == name).drop("g").limit(1))
        store.put(name, q.where(F.col("g") == name).drop("g"))
    store.put("gone", q.drop("g").limit(1))
    store.drop("gone")
    return store.dataset().groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query(f"WITH {QUADS} SELECT p, count(*) AS n FROM quad GROUP BY p")
def sink_memory(t: Tables) -> DataFrame:
    """Triples written to the sink in memory and read from its view."""
    sink = MemorySink(t.spark)
    return sink.write("quads", t.quads()).groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 3 <> 0 OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus = 'P'")
def ver_rows_replace(t: Tables) -> DataFrame:
    """A payload of rows replaces all rows of the keys that it names."""
    payload = t.orders.where("o_custkey % 3 = 0 AND o_orderstatus = 'P'").select("o_orderkey", "o_custkey", F.lit("new").alias("o_orderstatus"))
    return versions.replace_rows(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), payload, ["o_custkey"])


@query("""WITH s AS (SELECT conv_id, string_agg(role || ':' || length(text), '>' ORDER BY turn) AS signature FROM conversations GROUP BY 1), v AS (SELECT conv_id, signature, lag(signature) OVER (ORDER BY conv_id) AS was FROM s)
SELECT conv_id, CASE WHEN was IS NULL THEN 'first' WHEN was = signature THEN 'kept' ELSE 'new version' END AS outcome FROM v""")
def assemble_diff(t: Tables) -> DataFrame:
    """An assembly becomes a new version only if its signature differs from that of the one before, here the conversation before."""
    form = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("x")))), lambda x: x["x"])
    own = t.conversations.groupBy("conv_id").agg(F.sha2(F.array_join(form, ">"), 256).alias("signature"))
    before = own.select((F.col("conv_id") + 1).alias("conv_id"), F.col("signature").alias("was"))  # ids are a sequence: no window over all rows
    j = own.join(before, "conv_id", "left")
    return j.select("conv_id", F.when(F.col("was").isNull(), "first").when(F.col("was") == F.col("signature"), "kept").otherwise("new version").alias("outcome"))
