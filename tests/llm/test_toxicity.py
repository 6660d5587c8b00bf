import numpy as np
from graphloom.llm import queries, toxicity
from graphloom.llm.textvec import WORD_BYTES, Tokens


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.op8_toxicity(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.85
    assert np.mean([r.predicted for r in clean]) <= 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)


def test_pairs_of_terms_are_learned():
    """Either word alone is harmless; both together are not: no additive weights can say so without harm to one."""
    rng = np.random.default_rng(3)
    docs, terms, y = [], [], []
    for k in range(1200):
        a, b = rng.random(2) < 0.5
        own = [np.uint32(1)] * int(a) + [np.uint32(2)] * int(b) + list(rng.integers(10, 40, 5).astype(np.uint32))
        docs += [k] * len(set(own))
        terms += sorted(set(own))
        y.append(float(a and b))
    y = np.array(y)
    model = toxicity._learn(np.array(docs), np.array(terms, np.uint32), y, np.ones(len(y)))
    at = {int(t): k for k, t in enumerate(model.terms)}
    pair = model.latent[at[1]] @ model.latent[at[2]]
    assert pair > 0
    assert model.constant + model.linear[at[1]] + model.linear[at[2]] + pair > 0 > model.constant + model.linear[at[1]]


def test_tokens_against_brute_force():
    import re

    texts = ["One two", "", "two—three", "été 4x", "end"]
    raw = [t.encode() for t in texts]
    words = Tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), WORD_BYTES)
    want = [re.findall(rb"[0-9A-Za-z\x80-\xff]+", r) for r in raw]
    assert list(words.counts) == [len(w) for w in want]
    data = b"".join(raw)
    found = [data[a:b] for a, b in zip(words.start, words.end, strict=True)]
    assert found == [w for ws in want for w in ws]
    by = {}
    for w, h in zip(found, words.hash.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (8, 0, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    none = toxicity.fit(odd, labels.limit(0))
    assert all(r.score < 1e-9 for r in toxicity.score(odd, none, ["doc_id"]).collect())


def test_scores_against_the_sum_over_pairs(spark):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(1, "an insult for that group"), (2, "a word, a word and Words again"), (3, ""), (4, None)], "doc_id long, text string")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    raw = [(t or "").lower().encode() for t in texts]
    terms = [set(toxicity.terms_of(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[1].tolist()) for b in raw]
    kinds = np.array(sorted(set().union(*terms))[::2], np.uint32)
    model = toxicity.Model(kinds, rng.normal(size=len(kinds)), rng.normal(size=(len(kinds), toxicity.LATENT)), -0.3)
    for r in toxicity.score(docs, model, ["doc_id"]).collect():
        own = [k for k, t in enumerate(kinds.tolist()) if t in terms[r.doc_id - 1]]
        f = model.constant + sum(model.linear[k] for k in own) + sum(model.latent[a] @ model.latent[b] for i, a in enumerate(own) for b in own[i + 1 :])
        assert abs(r.score - 1 / (1 + np.exp(-f))) < 1e-9


def test_terms_are_chosen_as_one_machine_would(spark):
    rng = np.random.default_rng(10)
    rows, y = [], []
    for _ in range(200):
        y.append(int(rng.random() < 0.3))
        rows.append(np.unique(rng.choice(400, 30) + 200 * y[-1]).astype(np.uint32))
    held = spark.createDataFrame([(k, y[k], r.tobytes()) for k, r in enumerate(rows)], "doc_id long, _label int, terms binary").repartition(5)
    n, pos = np.zeros(600), np.zeros(600)
    for r, label in zip(rows, y, strict=True):
        n[r] += 1
        pos[r] += label
    p, total, yes = n / len(y), len(y), sum(y)
    chi = (pos - p * yes) ** 2 / np.maximum(1e-9, p * (1 - p) * yes * (total - yes) / total)
    good = np.flatnonzero(n >= toxicity.LEAST)
    want = np.sort(good[np.lexsort((good, -chi[good]))[: toxicity.TERMS]])
    assert toxicity._chosen(held).tolist() == want.tolist()
