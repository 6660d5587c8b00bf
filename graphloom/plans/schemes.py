"""Mapping schemes: reading, roles, templates, confidence, stored plans, compiled shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text, ucd
from graphloom.operators import schemes
from graphloom.operators.schemes import Bound, Spec
from graphloom.sources.tables import Tables

from .registry import query

NODES = """node AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 5 > 1 THEN p_partkey - p_partkey % 5 END AS parent, CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 3 END AS template,
CASE p_size % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'broad' END AS tbox, CASE p_size % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'inverse' WHEN 2 THEN 'broad' END AS rbox, CASE p_size % 11 WHEN 0 THEN 'exact' WHEN 1 THEN 'narrow' END AS abox,
CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_name END AS data_ref, CASE WHEN p_size % 13 = 0 THEN p_brand END AS data_inline, CASE WHEN p_size % 17 = 0 THEN p_brand END AS lookup_path,
CASE WHEN p_size % 6 = 0 THEN 'yes' END AS deferred, CASE WHEN p_size % 3 > 0 THEN p_size / 50.0 END AS confidence FROM part)"""
MERGED = """merged AS (SELECT n.node, n.parent, n.template, n.confidence, """ + ", ".join(f"coalesce(n.{c}, t.{c}) AS {c}" for c in schemes.INHERITED) + " FROM node n LEFT JOIN node t ON t.node = n.template)"


def nodes_of(t: Tables) -> DataFrame:
    """Mapping nodes, one for each part: every fourth instantiates the node three before it, most have a parent."""
    e = F.expr
    return t.part.select(
        F.col("p_partkey").alias("node"), e("if(p_partkey % 5 > 1, p_partkey - p_partkey % 5, null)").alias("parent"), e("if(p_partkey % 4 = 3, p_partkey - 3, null)").alias("template"),
        e("case p_size % 5 when 0 then 'exact' when 1 then 'broad' end").alias("tbox"), e("case p_size % 7 when 0 then 'exact' when 1 then 'inverse' when 2 then 'broad' end").alias("rbox"), e("case p_size % 11 when 0 then 'exact' when 1 then 'narrow' end").alias("abox"),
        e("if(p_type in ('ECONOMY', 'STANDARD'), p_name, null)").alias("data_ref"), e("if(p_size % 13 = 0, p_brand, null)").alias("data_inline"), e("if(p_size % 17 = 0, p_brand, null)").alias("lookup_path"),
        e("if(p_size % 6 = 0, 'yes', null)").alias("deferred"), e("if(p_size % 3 > 0, p_size / 50.0D, null)").alias("confidence"),
    )


@query(f"WITH {NODES}, {MERGED} SELECT node, {', '.join(schemes.INHERITED)} FROM merged")
def scheme_merge(t: Tables) -> DataFrame:
    return schemes.merged(nodes_of(t)).select("node", *schemes.INHERITED)


@query(f"""WITH {NODES}, {MERGED}, f AS (SELECT *, coalesce(rbox IN ('exact', 'inverse', 'broad'), false) AS joins, coalesce(data_ref, data_inline) IS NOT NULL OR coalesce(abox IN ('exact', 'broad'), false) AS has FROM merged)
SELECT node, CASE WHEN coalesce(tbox = 'narrow', false) OR coalesce(rbox = 'narrow', false) OR coalesce(abox = 'narrow', false) THEN 'refused' WHEN lookup_path IS NOT NULL THEN 'lookup'
WHEN deferred IS NOT NULL AND parent IS NOT NULL AND joins AND NOT has THEN 'contextual' WHEN joins AND has AND tbox IS NULL AND deferred IS NULL AND parent IS NOT NULL THEN 'assertion' WHEN deferred IS NOT NULL THEN 'datum'
WHEN tbox = 'broad' THEN 'class creation' WHEN tbox = 'exact' AND NOT joins THEN 'class reference' WHEN rbox = 'broad' AND parent IS NULL AND NOT has THEN 'property creation' WHEN joins THEN 'assertion'
WHEN abox IS NOT NULL THEN 'correspondence' ELSE 'unclassified' END AS role FROM f""")
def scheme_roles(t: Tables) -> DataFrame:
    return schemes.merged(nodes_of(t)).select("node", schemes.role().alias("role"))


@query(f"WITH {NODES} SELECT n.node, round(coalesce(n.confidence, 1) * coalesce(p.confidence, 1), 6) AS effective FROM node n LEFT JOIN node p ON p.node = n.parent WHERE coalesce(n.confidence, 1) * coalesce(p.confidence, 1) >= 0.5")
def scheme_confident(t: Tables) -> DataFrame:
    return schemes.confident(nodes_of(t), 0.5).select("node", F.round("effective", 6).alias("effective"))


PLAN = [
    Spec("customer-type", "customer", "urn:c/{c_custkey}", "a", "Customer"),
    Spec("customer-segment", "customer", "urn:c/{c_custkey}", "segment", "{c_mktsegment}", "c_acctbal > 0"),
    Spec("order-of", "orders", "urn:o/{o_orderkey}", "of", "urn:c/{o_custkey}", "o_orderstatus <> 'P'", 0.9),
    Spec("order-guess", "orders", "urn:o/{o_orderkey}", "urgent", "{o_orderpriority}", None, 0.2),
]
TRIPLES = """triple AS (SELECT 'urn:c/' || c_custkey AS s, 'type' AS p, 'Customer' AS o, 'customer-type' AS mapping FROM customer UNION ALL SELECT 'urn:c/' || c_custkey, 'segment', c_mktsegment, 'customer-segment' FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'urn:o/' || o_orderkey, 'of', 'urn:c/' || o_custkey, 'order-of' FROM orders WHERE o_orderstatus <> 'P')"""


@query(f"WITH {TRIPLES} SELECT * FROM triple")
def scheme_run(t: Tables) -> DataFrame:
    """A declared scheme run over its sources; mappings below the least confidence write nothing."""
    return schemes.run(PLAN, lambda name: getattr(t, name), 0.5)


@query(f"WITH {TRIPLES} SELECT mapping, count(*) AS triples, sha256('{schemes.canonical_json([vars(s) for s in PLAN]).replace(chr(39), chr(39) * 2)}') AS plan FROM triple GROUP BY mapping")
def scheme_stored(t: Tables) -> DataFrame:
    """The compiled mapping written as a table, read back, held against its digest and run."""
    text, digest = schemes.stored(PLAN)
    row = t.spark.read.parquet(t.stored(f"plan-{digest}", lambda: t.values([(text, digest)], "plan string, digest string"))).first()
    found = schemes.run(schemes.read_back(row["plan"], row["digest"]), lambda name: getattr(t, name), 0.5)
    return found.groupBy("mapping").agg(F.count("*").alias("triples")).withColumn("plan", F.lit(digest))


@query("""SELECT 'part' AS shape, 'most' AS kind, p_partkey AS focus FROM part WHERE p_size > 45 UNION ALL SELECT 'part', 'one_of', p_partkey FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO')
UNION ALL SELECT 'name', 'pattern', p_partkey FROM part WHERE NOT regexp_matches(p_name, '^[a-m]')""")
def shapes_compiled(t: Tables) -> DataFrame:
    """Constraint frames compiled from a table of parameters."""
    bounds = [Bound("part", "p_name", "required"), Bound("part", "p_size", "most", 45), Bound("part", "p_type", "one_of", ("ECONOMY", "STANDARD", "PROMO")), Bound("name", "p_name", "pattern", "^[a-m]")]
    return schemes.violations(t.part, "p_partkey", bounds)


# A scheme as rows: a mapping for each nation, some of them broken.
SCHEME = """(SELECT 'in-' || n_nationkey AS mapping, unnest(['logicalSource', 'subjectTemplate', 'predicate', 'objectTemplate', 'condition', 'confidence', 'note']) AS term, n_nationkey AS k, n_name FROM nation)"""
SCHEME_ROWS = f"""scheme AS (SELECT mapping, term, CASE term WHEN 'logicalSource' THEN 'customer' WHEN 'subjectTemplate' THEN 'urn:c/' || '{{c_custkey}}' WHEN 'predicate' THEN 'livesIn' WHEN 'objectTemplate' THEN n_name || '/' || '{{c_mktsegment}}'
 WHEN 'condition' THEN 'c_nationkey = ' || k WHEN 'confidence' THEN CASE WHEN k % 8 = 3 THEN '1.5' WHEN k % 6 = 1 THEN '0.4' ELSE '0.9' END END AS value FROM {SCHEME} WHERE NOT (term = 'note' AND k % 10 <> 7) AND NOT (term = 'objectTemplate' AND k % 9 = 5)
 UNION ALL SELECT 'in-' || n_nationkey, 'predicate', 'dwellsIn' FROM nation WHERE n_nationkey % 12 = 6)"""


def scheme_rows(t: Tables) -> DataFrame:
    """mapping, term, value of the scheme, as it would be read from a table that others write."""
    k = F.col("n_nationkey")
    terms = {
        "logicalSource": F.lit("customer"), "subjectTemplate": F.lit("urn:c/{c_custkey}"), "predicate": F.lit("livesIn"), "objectTemplate": F.when(k % 9 != 5, F.concat("n_name", F.lit("/{c_mktsegment}"))),
        "condition": F.concat(F.lit("c_nationkey = "), k), "confidence": F.when(k % 8 == 3, "1.5").when(k % 6 == 1, "0.4").otherwise("0.9"), "note": F.when(k % 10 == 7, F.lit("")),
    }
    rows = t.nation.select(F.concat(F.lit("in-"), k).alias("mapping"), "n_nationkey", F.inline(F.array(*[F.struct(F.lit(term).alias("term"), v.alias("value")) for term, v in terms.items()]))).where("value is not null")
    return rows.drop("n_nationkey").unionByName(t.nation.where("n_nationkey % 12 = 6").select(F.concat(F.lit("in-"), k).alias("mapping"), F.lit("predicate").alias("term"), F.lit("dwellsIn").alias("value")))


BROKEN = f"""{SCHEME_ROWS}, broken AS (SELECT DISTINCT mapping, 'UnknownTerm' AS finding, term FROM scheme WHERE term = 'note' UNION SELECT mapping, 'BadConfidence', term FROM scheme WHERE term = 'confidence' AND value = '1.5'
 UNION SELECT mapping, 'RepeatedTerm', term FROM scheme GROUP BY mapping, term HAVING count(DISTINCT value) > 1 UNION SELECT mapping, 'MissingTerm', 'objectTemplate' FROM scheme GROUP BY mapping HAVING count(*) FILTER (WHERE term = 'objectTemplate') = 0)"""


@query(f"WITH {BROKEN} SELECT * FROM broken")
def scheme_findings(t: Tables) -> DataFrame:
    """What keeps mappings of a stored scheme from being compiled."""
    return schemes.findings(scheme_rows(t))


@query(f"WITH {BROKEN} SELECT DISTINCT mapping, term, value FROM scheme WHERE value IS NOT NULL AND mapping NOT IN (SELECT mapping FROM broken)")
def scheme_exchange(t: Tables) -> DataFrame:
    """The sound mappings of a scheme imported from its rows and exported again."""
    return t.values(schemes.exported(schemes.compiled(scheme_rows(t))), "mapping string, term string, value string")


@query(f"""WITH {BROKEN} SELECT 'urn:c/' || c_custkey AS s, 'livesIn' AS p, n_name || '/' || c_mktsegment AS o, 'in-' || n_nationkey AS mapping FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE n_nationkey % 6 <> 1 AND 'in-' || n_nationkey NOT IN (SELECT mapping FROM broken)""")
def scheme_from_rows(t: Tables) -> DataFrame:
    """A scheme read from rows of a table: sound and confident mappings are compiled and run in one read of each source."""
    return schemes.run_by_source(schemes.compiled(scheme_rows(t)), lambda name: getattr(t, name), 0.5)


@query("SELECT 'o-' || o_orderkey AS s, 'by' AS p, 'c-' || o_custkey AS o FROM orders")
def scheme_parse(t: Tables) -> DataFrame:
    """A scheme whose values are written in a caller's path language, here prefix$column."""

    def parse(text: str) -> Column:
        prefix, _, name = text.partition("$")
        return F.concat(F.lit(prefix), F.col(name).cast("string"))

    return schemes.run([Spec("by", "orders", "o-$o_orderkey", "by", "c-$o_custkey")], lambda name: getattr(t, name), parse=parse).drop("mapping")


@query("""SELECT event_id, '{"item":{"key":' || (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) || ',"kind":"' || upper(event_type) || '"},"source":"log"}' AS json FROM events""")
def json_chain(t: Tables) -> DataFrame:
    """Records through a chain of steps: shift, modify, default, remove."""
    fields = {"k": F.from_json("props", "k int")["k"], "type": F.col("event_type"), "user": F.col("user_id")}
    steps = [("shift", {"k": "item.key", "type": "item.kind"}), ("modify", {"item.key": lambda c: c + 1, "item.kind": F.upper}), ("default", {"source": "log"}), ("remove", ["user"])]
    return t.events.select("event_id", schemes.json_chain(fields, steps).alias("json"))


@query("""WITH a AS (SELECT c_custkey, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) SELECT region, c_mktsegment AS segment, count(*) AS n, true AS composes FROM a JOIN customer USING (c_custkey) GROUP BY ALL""")
def surf_stacked(t: Tables) -> DataFrame:
    """A surface over a surface: promoted regions, then counts by them; one step after the other gives what both at once give."""
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    promoted = place.select("c_custkey", F.col("r_name").alias("region"))
    stacked = promoted.join(t.customer, "c_custkey").groupBy("region", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    at_once = place.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("m"))
    return stacked.join(at_once, ["region", "segment"], "full").select("region", "segment", "n", F.col("n").eqNullSafe(F.col("m")).alias("composes"))


@query(r"""SELECT doc_id, sha256(nfc_normalize(text)) AS nfc, sha256(nfc_normalize(text)) AS nfkc, sha256(nfc_normalize(replace(lower(regexp_replace(text, '\p{Cf}', '', 'g')), 'ß', 'ss'))) AS folded,
sha256(regexp_replace(text, '\p{Cf}', '', 'g')) AS stripped, sha256(upper(replace(text, 'ß', 'SS'))) AS upper, sha256(lower(text)) AS lower FROM documents WHERE text IS NOT NULL""")
def text_unicode_forms(t: Tables) -> DataFrame:
    """Normal forms, toNFKC_Casefold, the text without format characters and full case maps of all texts, by Unicode 16.0. SQL has the same for letters as the documents have."""
    return text.form_digests(t.documents.where("text is not null"), "doc_id", "text", ucd.FORMS)