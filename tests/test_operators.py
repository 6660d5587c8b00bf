"""Operators on small cases with known answers, positive and negative."""

import itertools
import random
import unicodedata

import pytest
from graphloom.__main__ import main as command
from graphloom.functions import digest, kleene, text
from graphloom.operators import bindings, constraints, eligibility, fold, graph, ledger, matching, operations, paths, relational, schemes, versions
from graphloom.sources import terms
from graphloom.sources.store import digest_tree
from graphloom.streaming import log
from pyspark.sql import functions as F


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_closure_cycles_levels_components(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    assert pairs(graph.closure(e)) == [("b", "a"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]
    assert pairs(graph.cyclic(e)) == [("x",), ("y",)]
    tree = e.where("child < 'x'")
    assert pairs(graph.levels(tree)) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    with pytest.raises(ValueError):
        graph.levels(e)
    assert pairs(graph.components(e, "child", "parent")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    assert pairs(graph.reachable(e, spark.createDataFrame([("c",)], "node string"), "child", "parent")) == [("a", 2), ("b", 1), ("c", 0)]
    assert graph.closure(e.limit(0)).count() == graph.components(e.limit(0), "child", "parent").count() == 0


def test_long_path_component(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.component for r in graph.components(e, "a", "b").collect()} == {0}


def test_stepwise_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [(a, k, rng.randint(-50, 60)) for a in range(5) for k in range(30)]
    got = ledger.stepwise(spark.createDataFrame(rows, "a int, k int, d int"), ["a"], ["k"], "d", F.lit(20), F.lit(100))
    want, have = {}, dict.fromkeys(range(5), 20)
    for a, k, d in rows:
        have[a] = min(100, have[a] + d)
        want[a, k] = have[a]
    assert {(r.a, r.k): r.after for r in got.collect()} == want


def test_rationing(spark):
    r = spark.createDataFrame([("p", 1, 5), ("p", 2, 5), ("p", 3, 5)], "k string, id int, w int")
    assert [x.granted for x in ledger.ration_by_rank(r, ["k"], [F.col("id")], "w", F.lit(7)).orderBy("id").collect()] == [5, 2, 0]
    assert [x.granted for x in ledger.largest_remainder(r, ["k"], "w", F.lit(10), [F.col("id")]).orderBy("id").collect()] == [4, 3, 3]


def test_kleene_groups(spark):
    values = (True, False, None)
    for n in range(1, 4):
        for case in itertools.product(values, repeat=n):
            r = spark.createDataFrame([(v,) for v in case], "v boolean").agg(kleene.every(F.col("v")).alias("e"), kleene.some(F.col("v")).alias("s")).first()
            assert r.e is (False if False in case else None if None in case else True)
            assert r.s is (True if True in case else None if None in case else False)
        if n == 2:
            break


def test_interval_bounds(spark):
    ranges = [(1.0, True, 2.0, False, "m")]
    d = spark.createDataFrame([(1.0, "m"), (2.0, "m"), (None, "m"), (1.5, "ft")], "v double, u string")
    assert [r[0] for r in d.select(kleene.decision(eligibility.interval(F.col("v"), F.col("u"), ranges))).collect()] == ["Permitted", "Denied", "Undetermined", "Undetermined"]


def test_set_readings(spark):
    values = spark.createDataFrame([(1, True), (1, False), (2, None), (3, False)], "id int, value boolean")
    who = spark.createDataFrame([(k,) for k in range(1, 5)], "id int")
    some = dict(pairs(eligibility.read_set(values, who, "id", "SomeValue", F.lit(True))))
    assert some == {1: True, 2: None, 3: False, 4: False}
    open_ = {r.id: r.value for r in eligibility.read_set(values, who, "id", "EveryValue", F.lit(False)).collect()}
    assert open_ == {1: False, 2: None, 3: False, 4: None}
    with pytest.raises(ValueError):
        eligibility.read_set(values, who, "id", "Most", F.lit(True))


def test_binding_precedence(spark):
    b = spark.createDataFrame([("n1", "k", "s1", ["a"]), ("n2", "k", "s2", ["a", "b"]), ("n3", "k", "s3", ["c"])], "node string, contract string, scheme string, scopes array<string>").withColumns({"valid_from": F.lit("2000-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    c = spark.createDataFrame([(1, "k", ["a", "b"]), (2, "k", ["a", "c"]), (3, "k", []), (4, "z", ["a"])], "id int, contract string, context array<string>").withColumn("at", F.lit("2001-01-01").cast("timestamp"))
    got = {r.id: (r.outcome, r.scheme) for r in bindings.resolve(b, c, spark.createDataFrame([("k", "f")], "contract string, scheme string")).collect()}
    assert got == {1: ("resolved", "s2"), 2: ("conflict", None), 3: ("fallback", "f"), 4: ("none", None)}


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, u int, v string")
    assert {r.id: r.v for r in relational.as_of(left, right, ["k"], "t", "u", ["v"]).collect()} == {1: "y", 2: None, 3: None}


def test_numbered_is_the_global_order(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = relational.numbered(rows.repartition(5), [F.col("k").desc()], "place").collect()
    assert sorted((r.place, r.k) for r in got) == [(n + 1, 999 - n) for n in range(1000)]
    assert relational.numbered(rows.limit(0), [F.col("k")], "place").count() == 0


def test_compare_and_set_has_one_winner(spark):
    heads = spark.createDataFrame([("r", 3)], "root string, seq long")
    writes = spark.createDataFrame([(1, "r", 3), (2, "r", 3), (3, "r", 2), (4, "new", 0)], "txn int, root string, expected long")
    assert {r.txn: (r.outcome, r.seq) for r in versions.compare_and_set(heads, writes).collect()} == {1: ("applied", 4), 2: ("lost", None), 3: ("conflict", None), 4: ("applied", 1)}


def test_constraints(spark):
    d = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1), (2, 2)], "g int, r int")
    assert [r.focus for r in constraints.contiguous(d, "x", ["g"], "r").collect()] == ["1"]
    names = spark.createDataFrame([("ab",), ("abc",), ("b",)], "n string")
    assert [(r.focus, r.value) for r in constraints.prefix_overlap(names, "p", "n").collect()] == [("abc", "ab")]
    assert constraints.unique_key(d, "u", ["g", "r"]).count() == 0


def test_ntriples_round_trip(spark):
    quads = spark.createDataFrame([("s", "p", 'say "hi"\n\\tab\t', "literal", None, "en"), ("s", "p", "o", "iri", None, None), ("s", "q", "1", "literal", "integer", None)], "s string, p string, o string, o_kind string, o_dt string, o_lang string")
    back = terms.from_ntriples(terms.to_ntriples(quads))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, quads.collect()))
    assert terms.from_ntriples(spark.createDataFrame([("not a line",)], "line string")).count() == 0


def test_uri_encoding_of_ascii(spark):
    from urllib.parse import quote

    chars = [chr(c) for c in range(32, 127)] + ["é", "漢"]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select("c", digest.encode_for_uri(F.col("c")).alias("e")).collect()
    assert all(r.e == quote(r.c, safe="-._~") for r in got)


def test_words_and_similarities(spark):
    d = spark.createDataFrame([("The userNames of Cats", "kitten", "sitting")], "t string, a string, b string")
    r = d.select(text.words(F.col("t")).alias("w"), text.edit_similarity(F.col("a"), F.col("b")).alias("e"), text.normal_text(F.lit("é  x ")).alias("n")).first()
    assert r.w == ["user", "name", "cat"] and abs(r.e - (1 - 3 / 7)) < 1e-9 and r.n == "é x"
    vec = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>").select(matching.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert abs(vec[0].c - 0.5**0.5) < 1e-9 and vec[1].c is None


def test_ordered_fold_keeps_order_and_state_by_key(spark):
    rows = [(k % 3, i, i * k) for k in range(7) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = fold.ordered_fold(df, ["k"], ["i"], ["i", "v"], lambda row: [0], lambda s, row: ([s[0] + row[1]], (row[0], s[0] + row[1])), "i long, total long").collect()
    want = []
    for k in range(3):
        total = 0
        for _, i, v in sorted(r for r in rows if r[0] == k):
            total += v
            want.append((i, total))
    assert sorted((r.i, r.total) for r in got) == sorted(want)
    assert fold.ordered_fold(df.limit(0), ["k"], ["i"], ["i"], lambda row: 0, lambda s, row: (s, row), "i long").count() == 0


def test_clamped_folds_by_blocks_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randint(-40, 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, d long")
    plain = ledger.stepwise(df, ["k"], ["i"], "d", F.lit(10), F.lit(60))
    blocks = ledger.stepwise(df, ["k"], ["i"], "d", F.lit(10), F.lit(60), block=F.expr("i div 7"))
    want, now = {}, {}
    for k, i, d in rows:
        now[k] = min(60, now.get(k, 10) + d)
        want[i] = now[k]
    assert {r.i: r.after for r in plain.collect()} == {r.i: r.after for r in blocks.collect()} == want
    before = {r.i: r.before for r in blocks.collect()}
    last = {}
    for k, i, _ in rows:
        assert before[i] == last.get(k, 10)
        last[k] = want[i]


def test_nested_limits_refuse_sets_that_cross(spark):
    df = spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 50)], "k long, p string, id long, wanted long")
    with pytest.raises(ValueError, match="cross"):
        ledger.nested_ration(df, [(["k", "p"], F.lit(10)), (["id"], F.lit(10))], [F.col("id")], "wanted")
    got = ledger.nested_ration(df, [(["k", "p"], F.lit(40)), (["k"], F.lit(60))], [F.col("id")], "wanted")
    assert {r.id: r.granted for r in got.collect()} == {1: 40, 2: 20}


def test_flat_set_comparison(spark):
    tested = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "z")], "k long, offered string")
    reference = spark.createDataFrame([(k, "x") for k in range(1, 5)], "k long, reference string")
    subjects = spark.createDataFrame([(k,) for k in range(1, 5)], "k long")

    def read(comparison, closed, fixed):
        return {r.k: (r.value, r.diagnostic, r.closures) for r in eligibility.compare_sets(tested, reference, subjects, "k", comparison, tested_closed=F.lit(closed), reference_closed=F.lit(fixed)).collect()}

    assert read("Subset", True, True) == {1: (False, None, "reference"), 2: (True, None, "tested"), 3: (False, None, "reference"), 4: (None, "MissingCandidate", "")}
    assert read("Intersects", True, False) == {1: (True, None, ""), 2: (True, None, ""), 3: (None, "NoClosureLicence", ""), 4: (None, "MissingCandidate", "")}
    assert read("Disjoint", True, True)[3] == (True, None, "reference tested")
    with pytest.raises(ValueError, match="unknown"):
        read("Equal", True, True)


def test_stored_plans_are_held_against_their_digest():
    specs = [schemes.Spec("a", "t", "urn:{x}", "a", "T"), schemes.Spec("b", "t", "urn:{x}", "p", "{y}", "y > 0", 0.5)]
    plan, digest = schemes.stored(specs)
    assert schemes.read_back(plan, digest) == specs and schemes.imported(schemes.exported(specs)) == specs
    with pytest.raises(ValueError, match="digest"):
        schemes.read_back(plan + " ", digest)
    with pytest.raises(ValueError, match="term"):
        schemes.imported([("a", "color", "red")])
    with pytest.raises(ValueError, match="lacks"):
        schemes.imported([("a", "predicate", "p")])


def test_operations_that_a_rule_refuses_are_not_rendered():
    for kind, build in operations.BUILDERS.items():
        assert operations.refusals(build("x", "t", "id", {"v": "long"})) == [], kind
    with pytest.raises(ValueError, match="ReplaceWithoutSeq"):
        operations.rendered(operations.Operation("x", "replace", "t", "id", {"id": "long"}, ("id",)))


def test_digest_trees_depend_on_the_rows_and_not_on_their_order(spark):
    rows = [(k % 2, f"row {k}") for k in range(300)]
    one = {r.g: (r.digest, r.n) for r in digest_tree(spark.createDataFrame(rows, "g long, t string"), ["g"], "t").collect()}
    two = {r.g: (r.digest, r.n) for r in digest_tree(spark.createDataFrame(rows[::-1], "g long, t string").repartition(7), ["g"], "t").collect()}
    assert one == two and {n for _, n in one.values()} == {150}
    three = {r.g: r.digest for r in digest_tree(spark.createDataFrame([*rows, (0, "row 0")], "g long, t string"), ["g"], "t").collect()}
    assert three[0] != one[0][0] and three[1] == one[1][0]


def test_paths_by_elimination(spark):
    path = paths.eliminated([("s", "a", "m"), ("m", "b", "m"), ("m", "c", "e"), ("s", "d", "e")], "s", "e")
    df = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "b", 4), (4, "c", 5), (2, "c", 6), (1, "d", 7), (9, "c", 9)], "s long, p string, o long")
    nodes = spark.range(1, 10).withColumnRenamed("id", "node")
    assert sorted((r.a, r.b) for r in paths.pairs(path, df, nodes).where("a = 1").collect()) == [(1, 5), (1, 6), (1, 7)]
    assert paths.eliminated([("s", "a", "m")], "s", "e") is None
    assert paths.text(paths.parsed("a/^b")) == "(a/^b)"


def test_unicode_forms_and_durations(spark):
    texts = ["ﬁne ①²", "Straße İ", "a­b‍c", "ŉ ǰ", "", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, x string")
    rows = df.select("k", text.nfkc("x").alias("n"), text.casefold("x").alias("c"), text.strip_format("x").alias("s"), text.upper_full("x").alias("u"), text.lower_full("x").alias("l")).collect()
    for r in rows:
        x = texts[r.k]
        assert tuple(r)[1:] == ((None,) * 5 if x is None else (unicodedata.normalize("NFKC", x), x.casefold(), "".join(c for c in x if unicodedata.category(c) != "Cf"), x.upper(), x.lower()))


def test_rows_later_than_the_cap_are_dropped_and_others_correct_their_window(spark):
    """Windows of a day in append mode, rows a batch at a time: the watermark is the latest day seen less the cap, a batch before."""
    day = 86_400
    batches = [[0, 1, 2], [5, 5, 6], [5, 9], [1, 2, 9, 20], [30]]  # in the fourth batch days 1 and 2 are past the cap
    rows = [(k, d * day + 10) for k, days in enumerate(batches) for d in days]
    df = spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    folder = log.split(df, F.col("k"), len(batches))
    out = log.collected(log.per_window(log.stream_of_folder(spark, folder, 1), "ts", "1 day", "2 days", []), "append").collect()
    counts = {int(r.start.timestamp()) // day: r.n for r in out}
    assert len(counts) == len(out)  # each window is given once
    assert counts[0] == counts[1] == counts[2] == 1  # the late rows of days 1 and 2 are dropped
    assert counts[5] == 3 and counts[6] == 1 and counts[9] == 2  # a row of day 5 came late within the cap
    assert 30 not in counts  # still open


def test_command_line(spark, sf_dir, tmp_path, capsys):
    assert command(["list", "ledger_se"]) == 0 and capsys.readouterr().out == "ledger_settle\n"
    assert command(["sql", "sort_iri"]) == 0 and "SELECT" in capsys.readouterr().out
    assert command(["run", "agg_global", sf_dir], spark) == 0 and "+" in capsys.readouterr().out
    assert command(["run", "agg_global", sf_dir, "--out", str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(SystemExit):
        command(["run", "no_such_query", sf_dir], spark)


def test_answers_need_all_and_forbid(spark):
    facts = spark.createDataFrame([("a", "X", "p"), ("a", "X", "q"), ("b", "X", "p"), ("c", "Y", "p"), ("b", "X", "p")], "s string, class string, p string")
    got = constraints.answers(facts, [("both", "X", ("p", "q"), ()), ("only", "X", ("p",), ("q",)), ("any", "Y", (), ())])
    assert pairs(got.select("question", "s")) == [("any", "c"), ("both", "a"), ("only", "b")]
