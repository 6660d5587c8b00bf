import pytest
from graphloom.operators import schemes
from graphloom.plans.schemes import PLAN
from graphloom.sources.tables import Tables


def test_one_read_of_a_source_gives_what_many_give(spark, sf_dir):
    t = Tables(spark, sf_dir)
    once, each = (f(PLAN, lambda name: getattr(t, name), 0.1) for f in (schemes.run_by_source, schemes.run))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, each.collect()))
    assert once._jdf.queryExecution().toString().count("FileScan") < each._jdf.queryExecution().toString().count("FileScan")
    with pytest.raises(ValueError, match="confident"):
        schemes.run_by_source(PLAN, lambda name: getattr(t, name), 2.0)


def test_findings_and_compiling(spark, monkeypatch):
    rows = schemes.exported(PLAN) + [("x", "logicalSource", "orders"), ("x", "logicalSource", "orders"), ("x", "colour", "red"), ("y", "predicate", " "), ("y", "confidence", "often"), ("z", "predicate", "a"), ("z", "predicate", "b")]
    df = spark.createDataFrame(rows, "mapping string, term string, value string")
    got = {tuple(r) for r in schemes.findings(df).collect()}
    missing = {(m, "MissingTerm", t) for m, held in (("x", {"logicalSource"}), ("y", {"predicate"}), ("z", {"predicate"})) for t in schemes.NEEDED if t not in held}
    assert got == missing | {("x", "UnknownTerm", "colour"), ("y", "EmptyValue", "predicate"), ("y", "BadConfidence", "confidence"), ("z", "RepeatedTerm", "predicate")}
    assert schemes.compiled(df) == sorted(PLAN, key=lambda s: s.name)
    monkeypatch.setattr(schemes, "MOST", 2)
    with pytest.raises(ValueError, match="more than 2"):
        schemes.compiled(df)
