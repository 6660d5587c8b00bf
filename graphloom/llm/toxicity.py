"""Toxicity by a factorization machine over hashed terms.

Terms are lowered words, words that come at least twice, and the first bytes of words; each
counts once for a document, as 32 bits of its hash. The terms that go best with either label in a
bounded sample get a linear weight and a latent vector, so that pairs of terms add to the score
beside single ones. The sample's terms are counted in Spark; the driver gets the chosen ones only.

Results for odd inputs: a null text is an empty one; a text without a known term gets the
constant's score; without any labelled row every score is 0; repeated rows get equal scores; a
null id is kept; an empty table gives no rows; other columns are ignored. The longest text bounds
a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpointed, map_text, sampled_texts
from .textvec import Tokens, chunks, lowered, mix, span_hash, utf8

#: Labelled rows for each label that are learned from.
SAMPLE_PER_LABEL = 4000
#: Hashed terms that are kept, documents that one needs, bytes of words' beginnings.
TERMS, LEAST, STEMS = 4096, 4, (4, 5, 6, 8)
LATENT, STEPS, BATCH, RATE, DECAY = 8, 600, 256, 0.02, 1e-5


@dataclass
class Model:
    """Sorted term hashes with weights and latent vectors, and the constant."""

    terms: np.ndarray
    linear: np.ndarray
    latent: np.ndarray
    constant: float


def terms_of(data: np.ndarray, offsets: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, term hash), each once; of terms in ``only`` (sorted) if given."""
    words = Tokens(data, offsets)
    stems = [mix(span_hash(words.sums, words.start[m], words.start[m] + n) + np.uint64(n)) for n in STEMS for m in [words.end - words.start >= n]]
    doc = np.concatenate([words.doc, *(words.doc[words.end - words.start >= n] for n in STEMS)])
    whole = np.concatenate([words.hash, *stems])
    term, twice = (whole >> np.uint64(32)).astype(np.uint32), (mix(whole + np.uint64(2)) >> np.uint64(32)).astype(np.uint32)
    if only is not None:
        hit = _within(term, only) | _within(twice, only)
        doc, term, twice = doc[hit], term[hit], twice[hit]
    order = np.lexsort((term, doc))
    doc, term, twice = doc[order], term[order], twice[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (term[1:] == term[:-1])
    second = same.copy()
    second[1:] &= ~same[:-1]
    doc, term = np.concatenate([doc[~same], doc[second]]), np.concatenate([term[~same], twice[second]])
    if only is not None:
        hit = _within(term, only)
        doc, term = doc[hit], term[hit]
    return doc, term


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _learn(docs: np.ndarray, terms: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """``docs`` and ``terms``: pairs; ``y`` and ``weight`` of each document."""
    kinds, at = np.unique(terms, return_inverse=True)
    pos = np.bincount(at, y[docs], len(kinds))
    n = np.bincount(at, minlength=len(kinds)).astype(float)
    p, total, yes = n / len(y), len(y), y.sum()
    chi = (pos - p * yes) ** 2 / np.maximum(1e-9, p * (1 - p) * yes * (total - yes) / total)
    good = np.flatnonzero(n >= LEAST)
    good = np.sort(good[np.lexsort((kinds[good], -chi[good]))[:TERMS]])
    place = np.full(len(kinds), -1)
    place[good] = np.arange(len(good))
    keep = place[at] >= 0
    docs, cols = docs[keep], place[at][keep]
    order = np.argsort(docs, kind="stable")
    docs, cols = docs[order], cols[order]
    first = np.searchsorted(docs, np.arange(len(y) + 1))
    rng = np.random.default_rng(17)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    params = [np.array([np.log(share / (1 - share))]), np.zeros(len(good)), rng.normal(0, 0.01, (len(good), LATENT))]
    m1, m2 = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    step, epochs = 0, -(-STEPS * BATCH // len(y))
    for epoch in range(epochs):
        turn = rng.permutation(len(y))
        for b in range(0, len(y), BATCH):
            rows = turn[b : b + BATCH]
            x = np.zeros((len(rows), len(good)), np.float64)
            for k, r in enumerate(rows):
                x[k, cols[first[r] : first[r + 1]]] = 1
            s = x @ params[2]
            f = params[0][0] + x @ params[1] + 0.5 * (s * s - x @ params[2] ** 2).sum(axis=1)
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y[rows]) / len(rows)
            gx = g @ x
            grads = [np.array([g.sum()]), gx + DECAY * params[1], x.T @ (g[:, None] * s) - gx[:, None] * params[2] + DECAY * params[2]]
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for q, d, a, v in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (d - a)
                v += 0.001 * (d * d - v)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(kinds[good], params[1], params[2], float(params[0][0]))


def _chosen(held: DataFrame) -> np.ndarray:
    """The TERMS terms (sorted) of LEAST documents or more that differ most between the labels, counted in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(t.as_py(), np.uint32) for t in batch["terms"]]
            y = np.repeat(np.asarray(batch["_label"].to_pylist(), np.int64), [len(t) for t in found])
            kinds, at = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(np.bincount(at, minlength=len(kinds))), pa.array(np.bincount(at, y, len(kinds)).astype(np.int64))], ["term", "n", "pos"])

    size = held.agg(F.count("*").alias("total"), F.coalesce(F.sum("_label"), F.lit(0)).alias("yes")).first()
    if not size["total"]:
        return np.zeros(0, np.uint32)
    total, yes = float(size["total"]), float(size["yes"])
    p = F.col("n") / total
    chi = F.pow(F.col("pos") - p * yes, 2) / F.greatest(F.lit(1e-9), p * (1 - p) * (yes * (total - yes) / total))
    sums = held.mapInArrow(count, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= LEAST)
    best = sums.select("term", chi.alias("chi")).orderBy(F.col("chi").desc(), "term").limit(TERMS).toPandas()
    return np.sort(best["term"].to_numpy().astype(np.uint32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn ``label`` (0 or 1) of labelled documents from a bounded sample.

    Executors send the hashes of chosen terms, not texts. Rows are weighted so that the scores follow the share
    of the labels before sampling.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    chosen = bounded_sample(known, "_label", SAMPLE_PER_LABEL)
    texts = sampled_texts(docs.select("doc_id", "text"), chosen, ["doc_id"])

    def hashed(text: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(lowered(text))
        out = []
        for i, j in chunks(offsets):
            doc, term = terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            order = np.argsort(doc, kind="stable")
            out += [t.tobytes() for t in np.split(term[order], np.searchsorted(doc[order], np.arange(1, j - i)))]
        return [pa.array(out, pa.binary())]

    held = checkpointed(map_text(texts, ["doc_id", "_label"], "terms binary", hashed))
    chosen_terms = _chosen(held)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(t.as_py(), np.uint32) for t in batch["terms"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_label"], pa.array([t[_within(t, chosen_terms)].tobytes() for t in found], pa.binary())], ["doc_id", "_label", "terms"])

    table = held.mapInArrow(kept, held.schema).toPandas().sort_values(["doc_id", "_label", "terms"])
    if table.empty:
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, LATENT)), -30.0)
    counts = {r["_label"]: r["count"] for r in known.where("doc_id is not null").groupBy("_label").count().collect()}
    y = table["_label"].to_numpy().astype(float)
    weight = np.array([counts[k] / (y == k).sum() for k in y])
    weight *= len(y) / weight.sum()
    rows = [np.frombuffer(t, np.uint32) for t in table["terms"]]
    return _learn(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows), y, weight)


def score(docs: DataFrame, model: Model, keep: list[str | Column]) -> DataFrame:
    """``keep`` columns of docs and the score of the column text; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(text: pa.Array) -> list[pa.Array]:
        model = sent.value
        data, offsets = utf8(lowered(text))
        out = np.zeros(len(offsets) - 1)
        for i, j in chunks(offsets):
            doc, term = terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.terms)
            at, n = np.searchsorted(model.terms, term), j - i
            f = model.constant + np.bincount(doc, model.linear[at], n)
            for k in range(model.latent.shape[1]):
                v = model.latent[at, k]
                f = f + 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
            out[i:j] = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return [pa.array(out, pa.float64())]

    return map_text(docs, keep, "score double", of)
