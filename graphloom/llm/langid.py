"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (n = 1 to 4, letters lowered, everything
else a space) present in both, over the geometric mean of their own numbers: a blended-spectrum
presence kernel. A Nystroem map over landmark documents and one-versus-rest kernel ridge
regression are fitted on a bounded sample of labelled rows. For scoring, the landmarks' presence
rows and their dual weights fold into one weight for each n-gram and label, so that a batch of
documents is one matrix product of its presence rows with that matrix.

Results for odd inputs: a null text or one without a letter is ``und`` with score 0; without any
labelled row everything is ``und``; equal texts get equal results; a null id is kept; an empty
table gives no rows; other columns are ignored. The longest text bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_text, sampled_texts
from .textvec import WORD_BYTES, chunks, lowered, utf8

UNDETERMINED = "und"
#: Labelled rows for each label that are learned from, in the order of a hash of their id.
SAMPLE_PER_LABEL = 700
LANDMARKS_PER_LABEL = 48
RIDGE = 1e-2
#: Sharpness of the scores: they are the softmax of so many times the ridge outputs.
SHARPNESS = 8.0

#: Features of each n: hashed beyond single bytes.
_WIDTHS = {1: 256, 2: 4096, 3: 8192, 4: 8192}
FEATURES = sum(_WIDTHS.values())
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_FOLD = np.where(WORD_BYTES, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 32
#: Documents scored in one product.
_ROWS = 64


@dataclass
class Model:
    """Labels, the weight of each n-gram for each label, and the constant of each label."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence of each n-gram feature in each of some documents (rows)."""
    found = np.zeros((len(offsets) - 1, FEATURES), bool)
    folded = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    flat, base = found.reshape(-1), 0
    for n, width in _WIDTHS.items():
        m = len(folded) - n + 1
        if m > 0:
            h = folded[:m] * np.uint32(1)
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ folded[k : k + m]
            if n > 1:
                h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - (width.bit_length() - 1))
            whole = doc[:m] == doc[n - 1 :]
            flat[(doc[:m] * FEATURES + base + h.astype(np.int64))[whole]] = True
        base += width
    return found


def _fit(bits: np.ndarray, labels: list[str], y: np.ndarray) -> Model:
    """Kernel ridge regression on a Nystroem map of packed presence rows, a few rows unpacked at a time."""

    def unit(part: np.ndarray) -> np.ndarray:
        x = np.unpackbits(part, axis=1)[:, :FEATURES].astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    z = unit(bits[np.concatenate([np.flatnonzero(y == k)[:LANDMARKS_PER_LABEL] for k in range(len(labels))])])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    kept = values > 1e-6 * max(values[-1], 1e-12)
    root = vectors[:, kept] / np.sqrt(values[kept])
    mapped = np.concatenate([unit(bits[k : k + 256]) @ z.T for k in range(0, len(bits), 256)]).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(labels)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(labels))[y]
    weight *= len(y) / weight.sum()
    mean = (weight[:, None] * mapped).sum(axis=0) / weight.sum()
    middle = (weight[:, None] * target).sum(axis=0) / weight.sum()
    centred = mapped - mean
    gram = (centred * weight[:, None]).T @ centred + RIDGE * len(y) / 100 * np.eye(mapped.shape[1])
    beta = np.linalg.solve(gram, (centred * weight[:, None]).T @ (target - middle))
    return Model(labels, (z.T.astype(np.float64) @ (root @ beta)).astype(np.float32), middle - mean @ beta)


def fit(labelled: DataFrame, label: str = "lang") -> Model:
    """Learn from the columns text, doc_id (only to choose the sample) and ``label`` of ``labelled``.

    The sample is SAMPLE_PER_LABEL ids for each label with one text each (of the label) and, of each, the
    whole text and its first 100 bytes. Executors send presence bits, not texts, to the driver.
    """
    known = labelled.select("doc_id", F.col(label).alias("label"), "text").where("text is not null")
    chosen = bounded_sample(known, "label", SAMPLE_PER_LABEL)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(lowered(batch["text"]))
            for i, j in chunks(offsets):
                for cut in (None, 100):
                    ends = offsets[i + 1 : j + 1] if cut is None else np.minimum(offsets[i + 1 : j + 1], offsets[i:j] + cut)
                    part = np.concatenate([data[a:b] for a, b in zip(offsets[i:j], ends, strict=True)] or [data[:0]])
                    found = presence(part, np.concatenate([[0], np.cumsum(ends - offsets[i:j])]))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["label"].slice(i, j - i), pa.array([np.packbits(r).tobytes() for r in found], pa.binary())], ["doc_id", "label", "bits"])

    got = sampled_texts(known, chosen, ["doc_id", "label"]).mapInArrow(bits, "doc_id long, label string, bits binary").toPandas()
    got = got.sort_values(["label", "doc_id", "bits"])
    labels = sorted(set(got["label"]))
    if not labels:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    bits = np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1)
    return _fit(bits, labels, np.searchsorted(np.array(labels, object), got["label"].to_numpy()))


def classify(docs: DataFrame, model: Model, keep: list[str | Column], at: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of docs with lang_pred and score from the column text; no shuffle.

    ``text`` is passed on only if ``keep`` has it; ``at`` says where, as for map_text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(text: pa.Array) -> list[pa.Array]:
        model = sent.value
        names = [*model.labels, UNDETERMINED]
        column = lowered(text)
        data, offsets = utf8(column)
        best, sure = np.full(len(column), len(model.labels)), np.zeros(len(column))
        for i, j in ((a, b) for c, d in chunks(offsets) for a in range(c, d, _ROWS) for b in [min(a + _ROWS, d)]):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            doc = np.repeat(np.arange(j - i), np.diff(at))
            letters = np.bincount(doc[_LETTERS[part]], minlength=j - i) > 0
            for k in np.flatnonzero(~letters):
                letters[k] = any(c.isalpha() for c in column[i + int(k)].as_py() or "")
            if not model.labels or not letters.any():
                continue
            x = presence(part, at).astype(np.float32)
            f = (x @ model.weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) + model.bias
            p = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            best[i:j] = np.where(letters, f.argmax(axis=1), len(model.labels))
            sure[i:j] = np.where(letters, p.max(axis=1), 0)
        return [pa.array([names[k] for k in best], pa.string()), pa.array(sure, pa.float64())]

    return map_text(docs, keep, "lang_pred string, score double", score, at)
