import numpy as np
from graphloom.llm import langid, queries
from graphloom.llm.common import fold
from pyspark.sql import functions as F


def test_query_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op3_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_fold_is_the_crc(spark):
    import zlib

    got = spark.range(200).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_presence_against_brute_force():
    texts = ["Ab c", "", "é1x", "abcabc"]
    raw = [t.lower().encode() for t in texts]
    found = langid.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, one in enumerate(raw):
        alone = langid.presence(np.frombuffer(one, np.uint8), np.array([0, len(one)]))
        assert (alone[0] == found[k]).all()
        folded = bytes(langid._FOLD[b] for b in one)
        assert found[k][:256].sum() == len(set(folded))
    assert found[3].sum() == 3 + 3 + 3 + 3  # three distinct n-grams of each length, no collision among so few


def test_odd_rows(spark, odd, empty, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = langid.classify(odd, model, odd.columns).collect()
    assert len(got) == 11 and set(got[0].asDict()) == {*odd.columns, "lang_pred", "score"}
    by = {(r.doc_id, r.text): r for r in got}
    assert by[1, None].lang_pred == by[2, ""].lang_pred == by[6, "12 34 !? —"].lang_pred == "und"
    assert by[3, "a"].lang_pred in model.labels and by[None, "no id at all"].lang_pred in model.labels
    assert langid.classify(empty, model, ["doc_id"]).count() == 0
    none = langid.fit(odd)
    assert none.labels == [] and {r.lang_pred for r in langid.classify(odd, none, ["doc_id"]).collect()} == {"und"}


def test_folded_weights_against_the_kernel(monkeypatch):
    """Scores by folded weights equal ridge regression with explicit kernels, landmarks and square roots."""
    monkeypatch.setattr(langid, "LANDMARKS_PER_LABEL", 6)
    rng = np.random.default_rng(4)
    n, labels = 60, ["a", "b", "c"]
    y = np.repeat(np.arange(3), n // 3)
    x = rng.random((n, langid.FEATURES)) < 0.002
    for k in range(3):
        x[np.ix_(y == k, range(k * 50, k * 50 + 50))] |= rng.random((n // 3, 50)) < 0.4
    model = langid._fit(np.packbits(x, axis=1), labels, y)

    def kernel(p, q):
        return np.array([[len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for b in q] for a in p])

    sets = [set(np.flatnonzero(r).tolist()) for r in x]
    marks = [sets[i] for k in range(3) for i in np.flatnonzero(y == k)[:6]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    kept = values > 1e-6 * values[-1]
    mapped = kernel(sets, marks) @ (vectors[:, kept] / np.sqrt(values[kept]))
    target = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    centred = mapped - mapped.mean(axis=0)
    beta = np.linalg.solve(centred.T @ centred + langid.RIDGE * n / 100 * np.eye(mapped.shape[1]), centred.T @ (target - target.mean(axis=0)))
    want = centred @ beta + target.mean(axis=0)
    got = x @ model.weights / np.sqrt(x.sum(axis=1, keepdims=True)) + model.bias
    assert np.abs(got - want).max() < 1e-3
    assert (got.argmax(axis=1) == y).mean() > 0.9
