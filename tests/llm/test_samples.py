"""One id on a third of all rows, in the samples that models are learned from."""

import numpy as np
import pytest
from graphloom.llm import langid, quality, toxicity
from graphloom.llm.common import bounded_sample, sampled_texts
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    """3,000 rows, one id on 1,000 of them (half of these with one text), of two labels."""
    i = F.col("id")
    doc_id = F.when(i % 3 == 0, F.lit(7)).otherwise(i)
    text = F.when(i % 6 == 0, "the same text of many rows").otherwise(F.concat(F.lit("text of its own, "), (i * 7919 % 10007).cast("string"), F.when(i % 2 == 0, " even words here").otherwise(" odd terms there")))
    return spark.range(3000).select(doc_id.alias("doc_id"), text.alias("text"), F.when(i % 2 == 0, "even").otherwise("odd").alias("lang")).cache()


@pytest.mark.parametrize("hot", range(6))
def test_an_id_counts_once(spark, docs, hot):
    rows = docs.withColumn("doc_id", F.when(F.col("doc_id") == 7, F.lit(10_000 + hot)).otherwise(F.col("doc_id")))
    chosen = bounded_sample(rows, "lang", 200)
    assert {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()} == {"even": 200, "odd": 200}
    assert chosen.distinct().count() == 400
    got = sampled_texts(rows.select("doc_id", "lang", "text"), chosen, ["doc_id", "lang"]).collect()
    assert len(got) == 400 and len({(r.doc_id, r.lang) for r in got}) == 400
    texts = {(r.doc_id, r.lang, r.text) for r in rows.collect()}
    assert all((r.doc_id, r.lang, r.text) in texts for r in got)


def seen(monkeypatch, module, name):
    """Numbers of rows that a module's learner gets."""
    sizes, learn = [], getattr(module, name)

    def counted(x, *rest):
        sizes.append(len(rest[-2]) if module is toxicity else len(x))
        return learn(x, *rest)

    monkeypatch.setattr(module, name, counted)
    return sizes


def test_language_id(monkeypatch, docs):
    monkeypatch.setattr(langid, "SAMPLE_PER_LABEL", 100)
    sizes = seen(monkeypatch, langid, "_fit")
    assert langid.fit(docs).labels == ["even", "odd"]
    assert sizes == [2 * 2 * 100]  # each text and its beginning


@pytest.mark.parametrize(("module", "learn"), [(quality, "learn"), (toxicity, "_learn")])
def test_labelled_documents(monkeypatch, spark, docs, module, learn):
    monkeypatch.setattr(module, "SAMPLE_PER_LABEL", 100)
    sizes = seen(monkeypatch, module, learn)
    ids = docs.select("doc_id").distinct()
    labels = ids.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("own")).unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("own")))
    model = module.fit(docs, labels, "own")
    assert sizes == [200] and np.isfinite(model.constant)
