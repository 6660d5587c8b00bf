"""Typed operations: refusals, parameters, SQL text, capabilities, write shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import operations
from graphloom.operators.operations import BUILDERS, Operation
from graphloom.sources.shared import scratch
from graphloom.sources.tables import QUADS, Tables

from .registry import query

DECLARED = [
    Operation("fix_clock", "replace", "orders", "id", {"id": "long", "seq": "long"}, ("id", "seq"), "t.due < now()", True),
    Operation("blind", "replace", "orders", "id", {"id": "long"}, ("id",)),
    Operation("odd key", "upsert", "orders", "id", {"total": "money"}, ("total", "id")),
    Operation("bury", "tombstone", "orders", "id", {"id": "long", "note": "string"}, (), "t.owner = :who"),
    BUILDERS["replace"]("good", "orders", "id", {"total": "double"}),
]

# Operations by the remainder of a part's key: what each differs in from one that no rule refuses, and the rules that it breaks.
SOUND = {"operation": "'op_' || p_partkey", "kind": "'replace'", "table": "'orders'", "key": "'id'", "params": "map('id', 'long', 'total', 'double', 'seq', 'long')", "required": "array('id', 'total', 'seq')", "guard": "'t.total < :total'", "expects_seq": "true"}
VARIED = [
    ({}, ()), ({"kind": "'upsert'"}, ("UnknownKind",)), ({"operation": "'op ' || p_partkey"}, ("BadName",)), ({"operation": "'op_twice'"}, ("DuplicateOperation",)), ({"key": "'code'"}, ("KeyIsNoParameter",)), ({"required": "array('total', 'seq')"}, ("KeyNotRequired",)),
    ({"params": "map('id', 'double', 'total', 'double', 'seq', 'long')"}, ("KeyType",)), ({"params": "map('id', 'long', 'total', 'money', 'seq', 'long')"}, ("UnknownType",)), ({"params": "map('id', 'long', 'total', 'double', 'seq', 'long', 'a-b', 'long')"}, ("BadParameterName",)), ({"params": "map('id', 'long', 'total', 'double', 'seq', 'long', 'deleted', 'long')"}, ("ReservedParameter",)),
    ({"params": "map('id', 'long', 'total', 'double', 'seq', 'long', 'Total', 'double')"}, ("CaseClash",)), ({"required": "array('id', 'total', 'seq', 'who')"}, ("RequiredUndeclared",)), ({"required": "array('id', 'total', 'seq', 'id')"}, ("RequiredTwice",)), ({"params": "map('id', 'long', 'total', 'double')", "required": "array('id', 'total')"}, ("SeqUndeclared",)),
    ({"params": "map('id', 'long', 'total', 'double', 'seq', 'string')"}, ("SeqNotLong",)), ({"required": "array('id', 'total')"}, ("SeqNotRequired",)), ({"kind": "'create'"}, ("SeqOnCreate", "RowInGuardOfCreate")), ({"kind": "'append'", "guard": "':total > 0'"}, ("SeqOnAppend",)), ({"expects_seq": "false"}, ("ReplaceWithoutSeq",)),
    ({"kind": "'tombstone'", "expects_seq": "false", "params": "map('id', 'long')", "required": "array('id')", "guard": "null"}, ("TombstoneWithoutSeq",)), ({"kind": "'tombstone'"}, ("PayloadOnTombstone",)), ({"params": "map('id', 'long', 'seq', 'long')", "required": "array('id', 'seq')", "guard": "null"}, ("NoPayload",)), ({"guard": "' '"}, ("EmptyGuard",)),
    ({"guard": "'t.due < now()'"}, ("ClockInGuard",)), ({"guard": "'t.owner = :who'"}, ("UnboundInGuard",)), ({"params": "map('id', 'long', 'total', 'double', 'seq', 'long', 'least', 'double')", "guard": "'t.total > :least'"}, ("OptionalInGuard",)), ({"guard": "'true; drop'"}, ("StatementInGuard",)), ({"guard": "'t.id in (select 1)'"}, ("QueryInGuard",)),
    ({"guard": "'(t.total < :total'"}, ("UnbalancedGuard",)), ({"kind": "'rows'"}, ("GuardOnRows",)), ({"guard": "null"}, ()), ({"kind": "'create'", "expects_seq": "false", "guard": "null"}, ()),
]
EXPECTED = " UNION ALL ".join(f"SELECT {change.get('operation', SOUND['operation'])} AS operation, '{rule}' AS rule FROM part WHERE p_partkey % {len(VARIED)} = {k}" for k, (change, rules) in enumerate(VARIED) for rule in rules)


def stored_operations(t: Tables) -> DataFrame:
    """Operations as rows of a table, one for each part."""
    kinds = {"params": "map<string, string>", "required": "array<string>", "expects_seq": "boolean"}
    cases = {}
    for f, sound in SOUND.items():
        whens = " ".join(f"when {k} then {change[f]}" for k, (change, _) in enumerate(VARIED) if f in change)
        cases[f] = f"case p_partkey % {len(VARIED)} {whens} else {sound} end" if whens else sound
    return t.part.select(*[F.expr(e).cast(kinds.get(f, "string")).alias(f) for f, e in cases.items()])


@query(EXPECTED)
def typed_static_checks(t: Tables) -> DataFrame:
    """The static rules that stored operations break: each rule by operations made to break it."""
    return operations.refused_operations(stored_operations(t))


READY = [BUILDERS["create"]("open_order", "orders", "id", {"total": "double"}), BUILDERS["replace"]("reprice", "orders", "id", {"total": "double"}, "t.total < :total"), BUILDERS["append"]("note", "notes", "id", {"text": "string"}), BUILDERS["tombstone"]("close", "orders", "id"), BUILDERS["rows"]("relist", "lines", "id")]
TEXTS = {
    "open_order": "MERGE INTO orders t USING (SELECT :id AS id) s ON t.id = s.id WHEN NOT MATCHED THEN INSERT (id, total, seq) VALUES (:id, :total, 1)",
    "reprice": "MERGE INTO orders t USING (SELECT :id AS id) s ON t.id = s.id WHEN MATCHED AND t.seq = :seq AND (t.total < :total) THEN UPDATE SET t.total = :total, t.seq = t.seq + 1",
    "note": "INSERT INTO notes (id, text) SELECT :id, :text",
    "close": "MERGE INTO orders t USING (SELECT :id AS id) s ON t.id = s.id WHEN MATCHED AND t.seq = :seq THEN UPDATE SET t.deleted = TRUE, t.seq = t.seq + 1",
    "relist": "DELETE FROM lines WHERE id = :id; INSERT INTO lines SELECT * FROM payload WHERE id = :id",
}


GOOD = {0: "MERGE INTO orders t USING (SELECT :id AS id) s ON t.id = s.id WHEN MATCHED AND t.seq = :seq AND (t.total < :total) THEN UPDATE SET t.total = :total, t.seq = t.seq + 1",
        30: "MERGE INTO orders t USING (SELECT :id AS id) s ON t.id = s.id WHEN MATCHED AND t.seq = :seq THEN UPDATE SET t.total = :total, t.seq = t.seq + 1",
        31: "MERGE INTO orders t USING (SELECT :id AS id) s ON t.id = s.id WHEN NOT MATCHED THEN INSERT (id, total, seq) VALUES (:id, :total, 1)"}


@query(" UNION ALL ".join(f"SELECT 'op_' || p_partkey AS name, {len(text)} AS n, sha256('{text}') AS digest FROM part WHERE p_partkey % {len(VARIED)} = {k}" for k, text in GOOD.items()))
def typed_rendered(t: Tables) -> DataFrame:
    """The SQL texts of all stored operations that no rule refuses, written as rows of a folder and read back."""
    stored = stored_operations(t)
    sound = stored.join(operations.refused_operations(stored).select("operation").distinct(), "operation", "left_anti")
    folder = scratch(t.spark)
    sound.select(F.col("operation").alias("name"), operations.rendered_text().alias("text")).write.parquet(folder)
    return t.spark.read.parquet(folder).select("name", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


SET_VALUE = Operation("set_value", "replace", "events", "id", {"id": "long", "value": "double", "at": "timestamp", "source": "iri", "seq": "long"}, ("id", "value", "seq"), None, True)
ASKED = """asked AS (SELECT event_id AS request, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'much' ELSE CAST(event_id AS VARCHAR) || '.5' END AS value,
CASE WHEN event_id % 7 = 0 THEN 'no iri' ELSE 'urn:u/' || user_id END AS source, CASE WHEN event_id % 9 = 0 THEN '1x' ELSE '1' END AS seq, event_id % 11 = 0 AS extra FROM events)"""


def asked_of(t: Tables) -> DataFrame:
    """request and its parameters as a map of texts, some missing, mistyped or unknown."""
    e = F.expr
    pairs = F.array(
        F.struct(F.lit("id"), F.col("event_id").cast("string")), F.struct(F.lit("value"), e("case when event_id % 10 = 0 then null when event_id % 10 = 1 then 'much' else event_id || '.5' end")),
        F.struct(F.lit("source"), e("if(event_id % 7 = 0, 'no iri', 'urn:u/' || user_id)")), F.struct(F.lit("seq"), e("if(event_id % 9 = 0, '1x', '1')")), F.struct(F.lit("zone"), e("if(event_id % 11 = 0, 'west', null)")),
    )
    return t.events.select(F.col("event_id").alias("request"), F.map_filter(F.map_from_entries(pairs), lambda k, v: v.isNotNull()).alias("params"))


@query(f"""WITH {ASKED} SELECT request, 'value' AS parameter, CASE WHEN value IS NULL THEN 'missing' ELSE 'no double' END AS reason FROM asked WHERE value IS NULL OR value = 'much'
UNION ALL SELECT request, 'source', 'no iri' FROM asked WHERE source = 'no iri' UNION ALL SELECT request, 'seq', 'no long' FROM asked WHERE seq = '1x' UNION ALL SELECT request, 'zone', 'undeclared' FROM asked WHERE extra""")
def typed_parameters(t: Tables) -> DataFrame:
    """Parameters of requests that the operation's declaration refuses."""
    return operations.broken_parameters(asked_of(t), "request", F.col("params"), SET_VALUE)


@query("""SELECT o_orderkey AS key, 'ClosedNeedsDate' AS rule FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '2000-06-01' UNION ALL SELECT o_orderkey, 'UrgentNeedsTotal' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 50000
UNION ALL SELECT o_orderkey, 'SegmentStore' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'P'""")
def typed_cross_axis(t: Tables) -> DataFrame:
    """Rules that hold between the fields of a request, as a configuration's axes."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rules = {
        "ClosedNeedsDate": (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") > F.lit("2000-06-01").cast("timestamp")),
        "UrgentNeedsTotal": (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") < 50000),
        "SegmentStore": (F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderstatus") == "P"),
    }
    return operations.refused_rows(rows, "o_orderkey", rules)


@query("""WITH axis(axis, v) AS (VALUES ('segment', 'BUILDING'), ('segment', 'MACHINERY'), ('segment', 'FURNITURE'), ('status', 'F'), ('status', 'O')), used AS (SELECT 'segment' AS axis, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2)
SELECT used.axis, used.v AS value, n FROM used LEFT JOIN axis USING (axis, v) WHERE axis.axis IS NULL""")
def config_enumerations(t: Tables) -> DataFrame:
    """Values of a configuration's axes that its enumerations do not know, with how often they are used."""
    known = t.values([("segment", "BUILDING"), ("segment", "MACHINERY"), ("segment", "FURNITURE"), ("status", "F"), ("status", "O")], "axis string, value string")
    used = t.customer.groupBy(F.lit("segment").alias("axis"), F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n")).unionByName(t.orders.groupBy(F.lit("status").alias("axis"), F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n")))
    return used.join(F.broadcast(known), ["axis", "value"], "left_anti")  # known: an inline table


LEVELS = "(VALUES ('none', 'none'), ('none', 'best'), ('none', 'strong'), ('none', 'audit'), ('best', 'best'), ('best', 'strong'), ('strong', 'strong'), ('audit', 'audit'))"


@query(f"""WITH need AS (SELECT p_partkey AS subject, CASE WHEN p_size % 2 = 0 THEN 'writes' ELSE 'reads' END AS axis, CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'best' WHEN 2 THEN 'strong' ELSE 'audit' END AS level FROM part),
offer(axis, offered) AS (VALUES ('writes', 'best'), ('reads', 'strong')), o(low, high) AS {LEVELS}
SELECT subject, axis, level, offered FROM need LEFT JOIN offer USING (axis) WHERE NOT EXISTS (SELECT 1 FROM o WHERE low = level AND high = offered)""")
def capability_shortfalls(t: Tables) -> DataFrame:
    """Requirements that a store's declared levels do not reach; levels are partly ordered."""
    need = t.part.select(F.col("p_partkey").alias("subject"), F.expr("if(p_size % 2 = 0, 'writes', 'reads')").alias("axis"), F.expr("case p_size % 4 when 0 then 'none' when 1 then 'best' when 2 then 'strong' else 'audit' end").alias("level"))
    offer = t.values([("writes", "best"), ("reads", "strong")], "axis string, offered string")
    order = t.values([("none", "none"), ("none", "best"), ("none", "strong"), ("none", "audit"), ("best", "best"), ("best", "strong"), ("strong", "strong"), ("audit", "audit")], "low string, high string")
    return operations.shortfalls(need, F.broadcast(offer), F.broadcast(order))  # inline tables


@query(f"""WITH {QUADS}, shape(class, p) AS (VALUES ('Customer', 'type'), ('Customer', 'segment'), ('Customer', 'email'), ('Nation', 'type'), ('Nation', 'label'), ('Nation', 'partOf'), ('Region', 'type')),
seen AS (SELECT c.o AS class, q.p, count(*) AS n FROM quad q JOIN quad c ON c.s = q.s AND c.p = 'type' GROUP BY ALL)
SELECT coalesce(seen.class, shape.class) AS class, coalesce(seen.p, shape.p) AS p, CASE WHEN shape.p IS NULL THEN 'written, not in the shape' ELSE 'in the shape, never written' END AS gap, coalesce(n, 0) AS n
FROM seen FULL JOIN shape ON seen.class = shape.class AND seen.p = shape.p WHERE seen.p IS NULL OR shape.p IS NULL""")
def write_shape_gaps(t: Tables) -> DataFrame:
    """What is written but in no shape, and what shapes have but nothing writes."""
    shape = t.values([("Customer", "type"), ("Customer", "segment"), ("Customer", "email"), ("Nation", "type"), ("Nation", "label"), ("Nation", "partOf"), ("Region", "type")], "class string, p string").withColumn("declared", F.lit(True))
    q = t.quads()
    classes = q.where("p = 'type'").select("s", F.col("o").alias("class"))
    seen = q.select("s", "p").join(classes, "s").groupBy("class", "p").agg(F.count("*").alias("n"))
    j = seen.join(shape, ["class", "p"], "full").where("n is null or declared is null")
    return j.select("class", "p", F.when(F.col("declared").isNull(), "written, not in the shape").otherwise("in the shape, never written").alias("gap"), F.coalesce("n", F.lit(0)).alias("n"))
