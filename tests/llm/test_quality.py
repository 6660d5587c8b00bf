import numpy as np
from graphloom.llm import quality, queries


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.op6_quality(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert held and np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)


def brute(text):
    """The statistics of one text, read off plainly."""
    import re

    raw = text.encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    lines = [x for x in re.split(rb"[\n\r]", raw) if x]
    n, w = max(1, len(raw)), max(1, len(words))
    up, low = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    counts = {x: words.count(x) for x in words}
    pairs = list(zip(words, words[1:], strict=False))
    symbols = sum(b < 128 and chr(b) not in "!?,.:;'\"-() \t\n\r" and not chr(b).isalnum() for b in raw)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, up / max(1, up + low), sum(48 <= b <= 57 for b in raw) / n, symbols / n,
        sum(b in b"!?" for b in raw) / n, sum(b in b",.:;'\"-()" for b in raw) / n, sum(b in b" \t" for b in raw) / n, len(counts) / w, max(counts.values(), default=0) / w,
        1 - len(set(pairs)) / max(1, len(pairs)), len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sum(len(x) > 16 for x in words) / w,
    ]


def test_statistics_against_brute_force():
    texts = ["", "a", "The the cat, sat! 12 *** x\nline\nline", "Été extraordinairement — naïve\n\n", "b b b b"]
    raw = [t.encode() for t in texts]
    got = quality.statistics_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = np.array([brute(t) for t in texts])
    want[[0], 11] = got[[0], 11]  # no pairs: defined as 1
    for k in range(len(texts)):
        many = len(raw[k].split()) > 1
        assert np.allclose(np.delete(got[k], 11), np.delete(want[k], 11)), (texts[k], got[k], want[k])
        if many:
            assert np.isclose(got[k][11], want[k][11])


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.4)).astype(float)
    model = quality.learn(x, y)
    assert model.rules and len(model.rules) < 200
    rows = spark.createDataFrame(x[:50].tolist(), ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r.score for r in rows.select("*", model.score().alias("score")).collect()]
    names = {s: k for k, s in enumerate(quality.STATISTICS)}
    for row, score in zip(x[:50], got, strict=True):
        total = model.constant + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all(row[names[s]] <= t if op == "<=" else row[names[s]] > t for s, op, t in rule))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
    assert np.mean((np.array(got) >= 0.5) == y[:50]) > 0.9


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (8, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model, ["doc_id"]).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    none = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, none, ["doc_id"]).collect()} == {0.5}


def test_weights_meet_the_conditions_of_the_lasso():
    """At the optimum the gradient of a rule with a weight is the penalty against its sign, and of others no more than that."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.8) | (x[:, 5] > 1.2)).astype(float)
    model = quality.learn(x, y)
    at = {s: k for k, s in enumerate(quality.STATISTICS)}
    on = np.stack([quality._obeyed(x, [(at[s], op, t) for s, op, t in r]) for r in model.rules], axis=1).astype(float)
    w = np.array(model.weights)
    p = 1 / (1 + np.exp(-(on @ w + model.constant)))
    gradient = on.T @ (p - y) / len(y)
    assert np.abs(gradient + quality.PENALTY * np.sign(w)).max() < 0.5 * quality.PENALTY
    assert ((p >= 0.5) == y).mean() > 0.97
    rules = {tuple(r) for r in model.rules}
    assert len(rules) == len(model.rules)


def test_trees_split_where_brute_force_does(monkeypatch):
    monkeypatch.setattr(quality, "DEPTH", 1)
    rng = np.random.default_rng(6)
    for _ in range(20):
        x = rng.integers(0, 6, size=(80, 4)).astype(float)
        g, h = rng.normal(size=80), rng.random(80) + 0.1
        edges = [np.array([0.5, 1.5, 2.5, 3.5, 4.5])] * 4
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        paths, step = quality._grow(binned, edges, g, h)
        best = (1e-6, None)
        for f in range(4):
            for cut in edges[f]:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) < 5:
                    continue
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
        assert {(f, t) for path in paths for f, _, t in path} == ({best[1]} if best[1] else set())
        if best[1]:
            left = x[:, best[1][0]] <= best[1][1]
            for m in (left, ~left):
                assert np.allclose(step[m], g[m].sum() / (h[m].sum() + 1))
