import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from graphloom.llm import decontam, queries
from graphloom.llm.textvec import Tokens, utf8


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def contained(item, text):
    """Brute force: the item's words in a row."""
    return f" {' '.join(words(item))} " in f" {' '.join(words(text))} "


def test_query_finds_all_exact_items(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if contained(i.text, d.text)}
    got = queries.op2_decontamination(spark, sf_dir).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert want and want <= found
    assert all(r.item_share >= decontam.ITEM_SHARE for r in got)
    # Nothing else holds as much as the shares ask for.
    texts = {d.doc_id: words(d.text) for d in docs}
    for doc_id, item_id in found - want:
        item = words(next(i.text for i in items if i.item_id == item_id))
        assert len(set(item) & set(texts[doc_id])) >= 0.6 * len(set(item))


def test_paraphrases_and_recall(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    def prose(n):
        return [rng.choice(vocabulary[:40]) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randint(20, 55)) for _ in range(60)]
    docs, want = [], set()
    for k in range(300):
        text = prose(rng.randint(30, 400))
        if k % 3 == 0:
            item = rng.randrange(60)
            said = [w for w in items[item] if rng.random() > 0.2]
            for _ in range(4):
                said.insert(rng.randrange(len(said)), rng.choice(vocabulary))
            at = rng.randrange(len(text))
            text[at:at] = said
            want.add((k, item))
        elif k % 3 == 1:
            item = rng.choice(items)
            text[5:5] = item[3:10]
        docs.append((k, " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w) + ".") for k, w in enumerate(items)], "item_id long, text string")
    index = decontam.build(d, b)
    got = {(r.doc_id, f.item_id) for r in decontam.matches(d, index, ["doc_id"]).collect() for f in r.found}
    assert len(got & want) >= 0.9 * len(want)
    assert not got - want


def test_latent_space_is_the_row_space(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    idf = np.full(decontam.TERMS, 1.0)
    rows = list(decontam._rows_of(pa.array([r.text for r in items.collect()]), idf))
    used = np.unique(np.concatenate([t for t, _ in rows]))
    basis = decontam.latent_basis(items, idf, used, decontam.RANK)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)
    for terms, weight in rows:
        assert abs(np.linalg.norm(weight @ basis[np.searchsorted(used, terms)]) - 1) < 1e-3


def test_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, "line one line two line one and some more words here"), (1, "line one line two line one and some more words here"), (2, None), (3, ""), (4, "short"), (None, "a b c d e f g h i j k")], "item_id long, text string")
    rows = decontam.matches(odd, decontam.build(odd, b), odd.columns).collect()
    assert len(rows) == 11 and not any(r.found for r in rows)
    assert decontam.matches(empty, decontam.build(empty, b), ["doc_id"]).count() == 0
    assert decontam.matches(odd, decontam.build(odd, b.limit(0)), ["doc_id"]).count() == 11
    same = spark.createDataFrame([(7, "line one, line two! line one and some more words here."), (8, None)], "doc_id long, text string")
    assert [(r.doc_id, len(r.found)) for r in decontam.matches(same, decontam.build(same, b), ["doc_id"]).orderBy("doc_id").collect()] == [(7, 1), (8, 0)]


def test_items_that_a_large_part_of_all_rows_contain(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    items = [rng.sample(vocabulary, n) for n in (14, 25, 40, 59)]
    docs, want = [], set()
    for k in range(400):
        text = [rng.choice(vocabulary) for _ in range(90)]
        if k % 5 < 2:  # a hot group: all of its rows hold all items
            text = [w for item in items for w in [*item, *rng.sample(vocabulary, 5)]]
            want |= {(k, i) for i in range(4)}
        elif k % 5 == 2:
            item = rng.randrange(4)
            at = rng.randrange(90)
            text[at:at] = items[item]
            want.add((k, item))
        docs.append((k, " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    index = decontam.build(d, b)
    assert (index.idf > 0).all()
    assert {(r.doc_id, f.item_id) for r in decontam.matches(d, index, ["doc_id"]).collect() for f in r.found} == want


def test_recall_does_not_fall_with_the_number_of_items(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(14, 59))] for _ in range(1200)]
    docs = []
    for item in items:
        text = [rng.choice(vocabulary) for _ in range(120)]
        at = rng.randrange(120)
        text[at:at] = item
        docs.append((len(docs), " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    index = decontam.build(d, b)
    assert all(len(x.items) <= decontam.RANK for x in index.spaces) and sum(len(x.items) for x in index.spaces) == 1200
    got = {(r.doc_id, f.item_id) for r in decontam.matches(d, index, ["doc_id"]).collect() for f in r.found}
    assert got == {(k, k) for k in range(1200)}


def test_exact_copies_of_long_items(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (65, 97, 300, 1000, 1500, 2500, 5000)]
    docs, want = [], set()
    for k in range(40):
        text = [rng.choice(vocabulary) for _ in range(200)]
        if k % 4:
            item = k % len(items)
            at = rng.randrange(200)
            text[at:at] = items[item]
            want.add((k, item))
        docs.append((k, " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w) + ".") for k, w in enumerate(items)], "item_id long, text string")
    index = decontam.build(d, b)
    rows = [(r.doc_id, f.item_id, f.item_share) for r in decontam.matches(d, index, ["doc_id"]).collect() for f in r.found]
    assert {r[:2] for r in rows} == want and all(r[2] == 1 for r in rows)


def test_common_words_against_dynamic_programming():
    rng = random.Random(12)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 16))] for _ in "ab")
        skip = rng.randrange(len(a))
        best = [[0] * (len(b) + 1) for _ in range(len(a) - skip + 1)]
        for i, x in enumerate(a[skip:]):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontam.common_words(decontam.places_of(np.array(a, np.uint64)), len(a), b, skip) == best[-1][-1]


def test_candidates_against_brute_force(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(60)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = decontam.build(docs, items)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(120).collect()]
    data, offsets = utf8(pa.array([t.lower() for t in texts], pa.string()))
    words = Tokens(data, offsets)
    terms = decontam._terms(words)
    passages = [Counter(t.tolist()) for t in index.terms]
    lengths = [np.sqrt(sum((n * index.idf[t]) ** 2 for t, n in p.items())) for p in passages]
    want, near, start = {}, set(), 0
    for n in words.counts:
        for a in range(start, start + n, decontam.BLOCK):
            window = Counter(terms[a : min(a + decontam.BLOCK * decontam.WINDOW, start + n)].tolist())
            flat = np.sqrt(sum(c * index.idf[t] ** 2 for t, c in window.items()))  # of the words as if none were repeated
            for k, (p, length) in enumerate(zip(passages, lengths, strict=True)):
                inner = sum(c * p[t] * index.idf[t] ** 2 for t, c in window.items() if t in p) / length
                bound = min(decontam.CANDIDATE * flat, decontam.CONTAINED * length)
                if inner >= bound:
                    want[a, k] = inner / flat
                if abs(inner - bound) < 1e-3 * bound:
                    near.add((a, k))
        start += n
    at, item, cosine = decontam.candidates(words, index)
    got = {(a, k): c for a, k, c in zip(at.tolist(), item.tolist(), cosine.tolist(), strict=True)}
    assert want and got.keys() ^ want.keys() <= near
    assert all(abs(got[x] - want[x]) < 1e-3 for x in got.keys() & want.keys())


def test_recall_of_items_with_words_swapped(spark):
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(14, 59))] for _ in range(300)]
    docs = []
    for item in items:
        swapped = [rng.choice(vocabulary) if rng.random() < 0.25 else w for w in item]
        text = [rng.choice(vocabulary) for _ in range(120)]
        at = rng.randrange(120)
        text[at:at] = swapped
        docs.append((len(docs), " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, f.item_id) for r in decontam.matches(d, decontam.build(d, b), ["doc_id"]).collect() for f in r.found}
    assert len(got & {(k, k) for k in range(300)}) >= 0.9 * 300
    assert all(a == b for a, b in got)


def test_items_spread_out_are_found_by_their_latent_cosine(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    items = [rng.sample(vocabulary, rng.randint(35, 50)) for _ in range(150)]
    others = ["".join(rng.choice("qrstuvwxyz") for _ in range(rng.randint(5, 9))) for _ in range(40_000)]
    docs = [(k, " ".join(x for w in item for x in [w, *rng.sample(others, 4)])) for k, item in enumerate(items)]
    docs += [(k, " ".join(rng.sample(vocabulary, 60) + rng.sample(others, 140))) for k in range(150, 300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, f.item_id) for r in decontam.matches(d, decontam.build(d, b), ["doc_id"]).collect() for f in r.found}
    assert len(got) >= 0.95 * 150 and all(a == b for a, b in got)


def test_latent_candidates_against_projection(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(60)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = decontam.build(docs, items)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(120).collect()]
    data, offsets = utf8(pa.array([t.lower() for t in texts], pa.string()))
    words = Tokens(data, offsets)
    terms = decontam._terms(words)
    rows = np.array([np.bincount(t, minlength=decontam.TERMS) * index.idf for t in index.terms])
    lengths = np.linalg.norm(rows, axis=1)
    rows /= lengths[:, None]
    span = np.linalg.qr(rows.T)[0]
    want, near, start = set(), set(), 0
    for n in words.counts:
        for a in range(start, start + n, decontam.BLOCK):
            window = np.bincount(terms[a : min(a + decontam.BLOCK * decontam.WINDOW, start + n)], minlength=decontam.TERMS) * index.idf
            inner, size = rows @ window, np.linalg.norm(window @ span)
            share, cosine = inner / lengths, inner / max(size, 1e-12)
            want |= {(a, k) for k in np.flatnonzero((share >= decontam.SPREAD) & (cosine >= decontam.LATENT))}
            near |= {(a, k) for k in np.flatnonzero((abs(share - decontam.SPREAD) < 1e-3) | (abs(cosine - decontam.LATENT) < 1e-3))}
        start += n
    plain, got = ({(a, k) for a, k in zip(*(x.tolist() for x in decontam.candidates(words, index, latent=latent)[:2]), strict=True)} for latent in (False, True))
    assert plain < got and (got - plain) ^ (want - plain) <= near
