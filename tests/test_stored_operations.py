from graphloom.operators import operations
from graphloom.plans.operations import DECLARED, READY, TEXTS

SCHEMA = "operation string, kind string, table string, key string, params map<string, string>, required array<string>, guard string, expects_seq boolean"


def stored(spark, ops):
    return spark.createDataFrame([(o.name, o.kind, o.table, o.key, o.params, list(o.required), o.guard, o.expects_seq) for o in ops], SCHEMA)


def test_rules_of_declared_operations_hold_for_stored_ones(spark):
    got = {(r.operation, r.rule) for r in operations.refused_operations(stored(spark, DECLARED)).collect()}
    assert {(o.name, rule) for o in DECLARED for rule in operations.refusals(o)} <= got


def test_what_builders_make_is_not_refused(spark):
    ready = [o for o in READY if o.guard is None]
    assert operations.refused_operations(stored(spark, ready)).collect() == []


def test_what_cannot_be_decided_is_refused(spark):
    rows = spark.createDataFrame([("x", None, "t", "id", {"id": "long", "a": "long"}, ["id", "a"], None, None)], SCHEMA)
    assert {"UnknownKind", "ReplaceWithoutSeq"} <= {r.rule for r in operations.refused_operations(rows).collect()}


def test_texts_of_rows_are_those_of_declared_operations(spark):
    rows = stored(spark, READY).select("operation", operations.rendered_text().alias("text")).collect()
    assert {r.operation: r.text for r in rows} == {o.name: operations.rendered(o) for o in READY} == TEXTS
