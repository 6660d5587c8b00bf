import hashlib
from collections import Counter

import numpy as np
from graphloom.llm import fingerprint, queries


def brute_counts(data):
    """Bucket counts of one text, a window at a time."""
    out, n = [0] * fingerprint.BUCKETS, len(data)
    for i in range(n):
        w = [data[(i + k) % n] for k in range(5)]
        for salt, (b, c) in enumerate(fingerprint.TRIPLETS, 1):
            h = (w[0] * 0x9E3779B1 + w[b] * 0x85EBCA77 + w[c] * 0xC2B2AE3D + salt) * 0x27D4EB2F % (1 << 32)
            out[h >> 25] += 1
    return out


def brute_codes(data):
    c = brute_counts(data)
    r = sorted(c)
    return [sum(x > r[k] for k in (31, 63, 95)) for x in c]


def test_digests_against_brute_force():
    texts = [b"", b"a", b"abcd", "Été naïve".encode(), b"the quick brown fox " * 9]
    d = fingerprint.digests(texts)
    assert [list(x) for x in d.codes] == [brute_codes(t) for t in texts]
    again = fingerprint.parse(d.hex())
    assert (again.codes == d.codes).all() and (again.length == d.length).all() and (again.ratios == d.ratios).all() and (again.check == d.check).all()
    assert (fingerprint.difference(d, d) == 0).all() and (fingerprint.likeness(d, d) == 1).all()
    assert (fingerprint.difference(d.take(slice(0, 1)), d.take(slice(4, 5))) <= fingerprint.BOUND).all()


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        mine, theirs, next_ = fingerprint.digests([text.encode(), edited.encode(), after.encode()]).hex()
        assert (r.fingerprint, r.edited_fingerprint) == (mine, theirs)
        a = fingerprint.parse([mine, mine])
        near = fingerprint.likeness(a, fingerprint.parse([theirs, next_]))
        assert np.allclose([r.near_edited, r.near_next], near)
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1


def test_odd_rows(odd, empty):
    got = fingerprint.fingerprints_with_edits(odd).collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 1}
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == fingerprint.digests([b""]).hex()[0]
    assert by[9].edited_text.endswith("no id at all")  # after the last comes the first: the null id
    assert by[4].fingerprint == by[5].fingerprint and by[4].near_next == 1
    assert fingerprint.fingerprints_with_edits(empty).count() == fingerprint.fingerprints(empty).count() == 0
    assert fingerprint.fingerprints_with_edits(odd.where("doc_id = 4")).first().near_next == 1
    assert sorted(r.fingerprint for r in fingerprint.fingerprints(odd).collect()) == sorted(r.fingerprint for r in got)


def test_differences_against_brute_force():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100 + k % 20, size=int(rng.integers(0, 3000)), dtype=np.uint8)) for k in range(40)]
    found = fingerprint.digests(texts)
    again = fingerprint.parse(found.hex())
    score = {0: 0, 1: 1, 2: 2, 3: 6}
    for i in range(0, 40):
        for j in (0, (i * 7 + 3) % 40, 39 - i):
            body = sum(score[abs(int(a) - int(b))] for a, b in zip(found.codes[i], found.codes[j], strict=True))
            head = min(40, abs(int(found.length[i]) - int(found.length[j]))) + sum(abs(int(a) - int(b)) for a, b in zip(found.ratios[i], found.ratios[j], strict=True)) + (found.check[i] != found.check[j])
            want = min(fingerprint.BOUND, body + head)
            pair = slice(i, i + 1), slice(j, j + 1)
            assert fingerprint.difference(found.take(pair[0]), found.take(pair[1]))[0] == want
            assert fingerprint.difference(again.take(pair[0]), again.take(pair[1]))[0] == want
            assert abs(fingerprint.likeness(found.take(pair[0]), found.take(pair[1]))[0] - (1 - want / fingerprint.BOUND)) < 1e-12
            assert i != j or want == 0
