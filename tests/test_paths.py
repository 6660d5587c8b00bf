import pytest
from graphloom.sources import paths


@pytest.mark.parametrize(("text", "want"), [("$.a", ["a"]), ("a.b", ["a", "b"]), ("$[*].x-y", [None, "x-y"]), ("$.a[*].b[*]", ["a", None, "b", None]), (" a[*][*] ", ["a", None, None])])
def test_json_steps(text, want):
    assert paths.json_steps(text) == want


@pytest.mark.parametrize("text", ["", "$", "$.", "$.a[0]", "$..a", "a b", "$.a[*", ".a.", "$.1a"])
def test_refused_json_paths(text):
    with pytest.raises(ValueError):
        paths.json_steps(text)


def test_one_schema_for_all_paths():
    tree = paths.path_tree({"x": "$.a[*].b", "y": "$.a[*].c[*]", "z": "$.d.e"})
    assert tree.schema() == "struct<`a`: array<struct<`b`: string, `c`: array<string>>>, `d`: struct<`e`: string>>"
    for crossing in ({"x": "$.a", "y": "$.a.b"}, {"x": "$.a[*]", "y": "$.a.b"}, {"x": "$.a[*]", "y": "$.a[*].b"}):
        with pytest.raises(ValueError):
            paths.path_tree(crossing)


TEXTS = [
    (1, '{"id": 7, "lines": [{"part": "p1", "tags": ["a", "b"]}, {"part": "p2", "tags": []}, {"part": "p3"}], "who": {"name": "x"}}'),
    (2, '{"id": 8, "lines": [], "who": null}'), (3, '{"id": {"deep": [1, 2]}, "lines": "none"}'), (4, "no json {"), (5, None), (6, "[1, 2]"), (7, '{"lines": [{"part": 1.50, "tags": ["c"]}]}'), (7, '{"lines": [{"part": true}]}'),
]


def test_nested_repeats_and_missing_branches(spark):
    df = spark.createDataFrame([(*r, "kept") for r in TEXTS], "k int, text string, pos string")
    got = paths.read_json(df, "text", {"id": "$.id", "part": "$.lines[*].part", "tag": "$.lines[*].tags[*]", "name": "who.name"})
    assert got.columns == ["k", "text", "id", "part", "tag", "name", "pos"]
    rows = sorted(((r.k, r.id, r.part, r.tag, r.name, tuple(r.pos)) for r in got.collect()), key=repr)
    want = [
        (1, "7", "p1", "a", "x", (0, 0)), (1, "7", "p1", "b", "x", (0, 1)), (1, "7", "p2", None, "x", (1, None)), (1, "7", "p3", None, "x", (2, None)), (2, "8", None, None, None, (None, None)),
        (3, '{"deep":[1,2]}', None, None, None, (None, None)), (7, None, "1.5", "c", None, (0, 0)), (7, None, "true", None, None, (0, None)), *[(k, None, None, None, None, (None, None)) for k in (4, 5, 6)],
    ]
    assert rows == sorted(want, key=repr)
    assert paths.read_json(df.limit(0), "text", {"id": "$.id"}).count() == 0


def test_arrays_at_the_root_and_levels_beside_each_other(spark):
    df = spark.createDataFrame([(1, '[{"a": [[1, 2], [3]]}, {"a": []}]')], "k int, text string")
    got = sorted(((r.v, tuple(r.pos)) for r in paths.read_json(df, "text", {"v": "$[*].a[*][*]"}).collect()), key=repr)
    assert got == sorted([("1", (0, 0, 0)), ("2", (0, 0, 1)), ("3", (0, 1, 0)), (None, (1, None, None))], key=repr)
    with pytest.raises(ValueError, match="neither within"):
        paths.read_json(df, "text", {"x": "$.a[*]", "y": "$.b[*]"})


@pytest.mark.parametrize("text", ["", "a//b", "@a/b", "a/", "x:a", "a/1b", "/"])
def test_refused_xml_paths(text):
    with pytest.raises(ValueError):
        paths.xml_path(text)


def test_xml(spark):
    text = '<o xmlns:n="urn:n" id="1"><line part="p1"><tag>a</tag><tag>b <i>c</i></tag></line><line/><n:line part="p2"><tag/></n:line><other part="x"/></o>'
    df = spark.createDataFrame([(1, text), (2, "<o><line"), (3, None), (4, "<p><line/></p>")], "k int, text string")

    def read(iterate, wanted):
        return [tuple(r) for r in paths.read_xml(df, "k", "text", iterate, wanted, {"n": "urn:n"}).orderBy("k", "pos").collect()]

    assert read("/o/line", {"part": "@part", "tags": "tag", "all": "."}) == [(1, 0, ["p1"], ["a", "b c"], ["ab c"]), (1, 1, [], [], [""])]
    assert read("/o/n:line", {"part": "@part", "tag": "*"}) == [(1, 0, ["p2"], [""])]
    assert read("/*/*", {"part": "@part"}) == [(1, 0, ["p1"]), (1, 1, []), (1, 2, ["p2"]), (1, 3, ["x"]), (4, 0, [])]
    assert read("/o", {"parts": "line/@part", "id": "@id"}) == [(1, 0, ["p1"], ["1"])]
    with pytest.raises(ValueError):
        read("/o/@id", {"x": "."})
