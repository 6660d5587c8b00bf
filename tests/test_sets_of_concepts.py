"""What depends on a section's concepts only is worked out once for each set of concepts."""

import __spark_entry__
import pytest
from graphloom.operators import community


@pytest.mark.parametrize("name", ["template_coverage", "comm_match_sum", "section_resolution"])
def test_queries_work_once_for_each_set(spark, sf_dir, name, monkeypatch):
    held = []
    alike = community.alike
    monkeypatch.setattr(community, "alike", lambda sections: held.append(alike(sections)) or held[-1])
    __spark_entry__.queries()[name](spark, sf_dir)
    (sets, concepts), = held
    assert concepts.select("set").distinct().count() == sets.select("set").distinct().count() < sets.count()
    assert concepts.count() == concepts.distinct().count()


def test_equal_sections_get_equal_rows_and_names_break_ties(spark):
    sections = spark.createDataFrame([(s, c) for s in range(40) for c in "abc"[: 1 + s % 3]] + [(99, "z")], "s long, c string")
    templates = spark.createDataFrame([(t, c) for t in ("y", "x") for c in "abcd"] + [("w", "a"), ("w", "b"), ("w", "c"), ("w", "e"), ("w", "f")], "template string, c string")
    found = {r.s: (r.template, r.coverage, r.missing) for r in community.template_coverage(sections, templates, 0.2).collect()}
    assert found == {s: ("x", 0.25 * (1 + s % 3), 3 - s % 3) for s in range(40)}
    profiles = spark.createDataFrame([("m", "a", 0.5), ("n", "a", 0.5), ("o", "a", 0.125), ("o", "b", 0.5)], "comm string, c string, p double")
    got = {}
    for r in community.matched(sections, profiles, 2).collect():
        got.setdefault(r.s, []).append((r.comm, r.score))
    assert {s: sorted(x) for s, x in got.items()} == {s: [("m", 0.5), ("n", 0.5)] if s % 3 == 0 else [("m", 0.5), ("o", 0.625)] for s in range(40)}
