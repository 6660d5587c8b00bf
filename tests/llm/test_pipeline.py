"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
import pytest
from graphloom.llm import langid, line_dedup, simhash
from test_decontam import contained
from test_line_dedup import brute as brute_lines
from test_packing import check
from test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for name, (_, _, columns) in stages.items() if name != "packing")


def test_language(stages):
    before, after, _ = stages["language_id"]
    kept = {r.doc_id for r in after}
    assert {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")} == {r.doc_id for r in before} - kept


def test_lines(stages):
    before, after, _ = stages["line_dedup"]
    want = brute_lines([(r.doc_id, r.source, r.text) for r in before], line_dedup.RATIO, line_dedup.LEAST_PAGES, line_dedup.KEPT_SHARE)
    assert sorted((r.doc_id, r.text) for r in after) == sorted((i, t) for i, t, _, _ in want)
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(stages):
    before, after, _ = stages["near_dedup"]
    fps = {r.doc_id: brute_fingerprint(r.text, 5) for r in before}
    root = brute_components(set(fps.values()), simhash.MOST)
    first = {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    assert len(after) < len(before)


def test_decontamination(stages, spark, sf_dir):
    before, after, _ = stages["decontamination"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    kept = {r.doc_id for r in after}
    leaked = {r.doc_id for r in before if any(contained(i.text, r.text) for i in items)}
    assert leaked and not leaked & kept
    assert len({r.doc_id for r in before} - kept - leaked) <= 0.01 * len(before)


def test_packing(stages):
    before, after, _ = stages["packing"]
    check({r.doc_id: r.text for r in before}, after)


def test_run_gives_the_packed_rows(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() == len(stages["packing"][1])
    assert langid.UNDETERMINED == "und"


def test_stages_take_odd_rows_and_clashing_columns(spark, odd, empty, sf_dir):
    kept = {"language_id": 8, "line_dedup": 11, "near_dedup": 8, "decontamination": 11}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        labelled = odd.na.fill("en", ["lang"])
        got = stage(spark, labelled, sf_dir)
        assert got.columns == odd.columns
        assert len(got.collect()) == kept[name], name
        assert stage(spark, empty, sf_dir).count() == 0
    assert {r.doc_id for r in corpus_pipeline.pack(spark, odd, sf_dir).collect()} == {r.doc_id for r in odd.collect()}
    assert corpus_pipeline.pack(spark, empty, sf_dir).count() == 0


def test_rows_with_equal_ids_and_other_texts_are_judged_one_by_one(spark):
    base = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, base), (5, base + " more"), (5, "a text of its own that nobody else has"), (5, "a text of its own that nobody else has")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:3]) for r in simhash.deduplicated(docs).collect()) == [(1, "w0 "), (5, "a t")]


def test_many_ids_are_joined_without_broadcast(spark, monkeypatch, odd):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    assert sorted(str(r.doc_id) for r in simhash.deduplicated(odd).collect()) == sorted(["None", "1", "3", "4", "6", "7", "8", "9"])
