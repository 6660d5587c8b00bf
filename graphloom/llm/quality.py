"""Quality by a sparse rule ensemble over text statistics.

Boosted trees are grown on statistics of a bounded labelled sample. Each path from a root to a
node is a rule, a conjunction of comparisons; a lasso logistic regression gives most rules the
weight 0. The rest are compiled into one Spark column expression over the statistics.

Results for odd inputs: null and empty texts have all statistics 0 and are scored; without any
labelled row every score is 0.5; with one label only, its share decides; repeated rows get equal
scores; a null id is kept; an empty table gives no rows; other columns are ignored. The longest
text bounds a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, column, map_text, sampled_texts
from .textvec import Tokens, chunks, mix, utf8

#: Labelled rows for each label that are learned from.
SAMPLE_PER_LABEL = 4000
TREES, DEPTH, BINS, SHRINKAGE = 40, 3, 32, 0.2
PENALTY, STEPS = 0.002, 400

STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "shouts", "stops", "blanks", "distinct", "top_word", "repeated_pairs", "line_words", "distinct_lines", "long_words")

# Classes of bytes that are counted.
_UPPER, _LOWER, _DIGIT, _SYMBOL, _SHOUT, _STOP, _BLANK, _BREAK, _HIGH = range(9)
_CLASS = np.full(256, _SYMBOL, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[33, 63]], _CLASS[[44, 46, 58, 59, 39, 34, 45, 40, 41]], _CLASS[[32, 9]], _CLASS[[10, 13]] = _SHOUT, _STOP, _BLANK, _BREAK
_LINE_BYTES = np.ones(256, bool)
_LINE_BYTES[[10, 13]] = False


def _spread(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the most frequent key) of each document."""
    codes, unique = pd.factorize(mix(key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    own = np.zeros(len(unique), np.int64)
    own[codes] = doc
    most = np.zeros(n, np.int64)
    np.maximum.at(most, own, np.bincount(codes, minlength=len(unique)))
    return np.bincount(own, minlength=n), most


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics (columns, see STATISTICS) of UTF-8 documents (rows)."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    c = np.bincount(doc * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    words, lines = Tokens(data, offsets), Tokens(data, offsets, _LINE_BYTES)
    length = words.end - words.start
    letters = np.maximum(1, c[:, _UPPER] + c[:, _LOWER])
    n_bytes, n_words, n_lines = (np.maximum(1, x) for x in (sizes, words.counts, lines.counts))
    distinct, top = _spread(words.hash, words.doc, n)
    same = words.doc[1:] == words.doc[:-1]
    pairs = np.bincount(words.doc[1:][same], minlength=n)
    pair_kinds, _ = _spread(mix(words.hash[1:] * np.uint64(3) + words.hash[:-1])[same], words.doc[1:][same], n)
    line_kinds, _ = _spread(lines.hash, lines.doc, n)
    return np.stack(
        [
            np.log1p(sizes),
            np.log1p(words.counts),
            np.bincount(words.doc, weights=length, minlength=n) / n_words,
            c[:, _UPPER] / letters,
            c[:, _DIGIT] / n_bytes,
            c[:, _SYMBOL] / n_bytes,
            c[:, _SHOUT] / n_bytes,
            c[:, _STOP] / n_bytes,
            c[:, _BLANK] / n_bytes,
            distinct / n_words,
            top / n_words,
            1 - pair_kinds / np.maximum(1, pairs),
            words.counts / n_lines,
            line_kinds / n_lines,
            np.bincount(words.doc[length > 16], minlength=n) / n_words,
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame, keep: list[str | Column]) -> DataFrame:
    """``keep`` columns of docs and the statistics of the column text; no shuffle."""

    def of(text: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(text)
        parts = [statistics_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
        table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        return [pa.array(table[:, k], pa.float64()) for k in range(len(STATISTICS))]

    return map_text(docs, keep, ", ".join(f"{s} double" for s in STATISTICS), of)


@dataclass(frozen=True)
class Model:
    """Weighted rules, each a tuple of (statistic, "<=" or ">", threshold), and the constant."""

    rules: tuple[tuple[tuple[str, str, float], ...], ...]
    weights: tuple[float, ...]
    constant: float

    def score(self) -> Column:
        """The score as a Spark column expression over the statistics."""
        total = F.lit(self.constant)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [F.col(s) <= t if op == "<=" else F.col(s) > t for s, op, t in rule]
            both = tests[0]
            for t in tests[1:]:
                both = both & t
            total = total + F.when(both, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """A regression tree: the paths to its nodes and its step for each row."""
    paths, step = [], np.zeros(len(binned))
    todo = [((), np.arange(len(binned)), 0)]
    while todo:
        path, rows, depth = todo.pop()
        g, h = gradient[rows], curvature[rows]
        if path:
            paths.append(path)
        best, choice = 1e-6, None
        if depth < DEPTH and len(rows) >= 20:
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, f], g, len(cuts) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], h, len(cuts) + 1))[:-1]
                ns = np.cumsum(np.bincount(binned[rows, f], minlength=len(cuts) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(ns < 5) | (len(rows) - ns < 5)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, choice = gain[k], (f, k)
        if choice is None:
            step[rows] = g.sum() / (h.sum() + 1)
            continue
        f, k = choice
        left = binned[rows, f] <= k
        todo.append(((*path, (f, "<=", float(edges[f][k]))), rows[left], depth + 1))
        todo.append(((*path, (f, ">", float(edges[f][k]))), rows[~left], depth + 1))
    return paths, step


def _obeyed(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, t in rule:
        out &= x[:, f] <= t if op == "<=" else x[:, f] > t
    return out


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules from boosted trees, weighted by lasso logistic regression."""
    if not len(y):
        return Model((), (), 0.0)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    f0 = np.log(share / (1 - share))
    f, rules = np.full(len(y), f0), {}
    rng = np.random.default_rng(11)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        part = rng.random(len(y)) < 0.5
        paths, step = _grow(binned, edges, np.where(part, y - p, 0), np.where(part, p * (1 - p), 0))
        f = f + SHRINKAGE * step
        rules |= dict.fromkeys(tuple(sorted(p)) for p in paths)
    rules = list(rules)
    if not rules:
        return Model((), (), f0)
    on = np.stack([_obeyed(x, r) for r in rules], axis=1).astype(np.float64)
    w, b = np.zeros(len(rules)), f0
    v, c, t = w.copy(), b, 1.0
    rate = 4 / max(1e-9, np.linalg.norm(on.T @ on / len(y), 2) + 1)
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(on @ v + c))) - y
        new = v - rate * (on.T @ r) / len(y)
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * PENALTY)
        new_b, new_t = c - rate * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(tuple(tuple((STATISTICS[f], op, t) for f, op, t in rules[k]) for k in kept), tuple(float(w[k]) for k in kept), float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn ``label`` (0 or 1) of labelled documents from a bounded sample; numbers go to the driver, not texts."""
    chosen = bounded_sample(labels.select("doc_id", F.col(label).cast("int").alias("_label")), "_label", SAMPLE_PER_LABEL)
    known = sampled_texts(docs.select("doc_id", "text"), chosen, ["doc_id"])
    table = with_statistics(known, ["doc_id", "_label"]).toPandas().sort_values(["doc_id", *STATISTICS])
    return learn(table[list(STATISTICS)].to_numpy(), table["_label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, keep: list[str | Column]) -> DataFrame:
    """``keep`` columns of docs and the score of the column text; a kept column named score gives way. No shuffle."""
    names = [c for c in docs.select(*keep).columns if c.lower() != "score"]
    table = with_statistics(docs.select(F.struct(*keep).alias("kept"), "text"), ["kept"])
    return table.select(*[column(c, "kept").alias(c) for c in names], model.score().alias("score"))
