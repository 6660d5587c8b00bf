"""Document fingerprints: a quartile bucket digest and a bounded difference score.

Every text is slid over with a cyclic window of five bytes. Six triplets of each window are
hashed into 128 buckets; a bucket's code is the quartile of the document's bucket counts that
its own count lies in. The digest is ``Q1``, a checksum byte, a logarithmic length code, two
quartile ratios and the 128 two-bit codes, in lowercase hex (72 characters).

Results for odd inputs: a null text is an empty one; empty text has the digest of all zero
counts; texts shorter than a window are read cyclically; equal texts have equal digests;
documents with the same id follow one another in the order of their texts; a null id comes
first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import AFTER, BEFORE, ordered_with_edges
from .textvec import CHUNK

BUCKETS = 128
#: Offsets in the window of the bytes of each triplet; all begin with the first byte.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
WINDOW = 5
#: Difference scores are cut at this bound, which gives a likeness of 0.
BOUND = 300

_K1, _K2, _K3, _M = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))
#: Score for two bits codes that differ by 0, 1, 2 or 3 quartiles.
_CODE_SCORE = np.array([0, 1, 2, 6])


class Digests:
    """Digests of some texts in parts: codes (n x 128), length, ratios (n x 2) and checksum."""

    def __init__(self, codes: np.ndarray, length: np.ndarray, ratios: np.ndarray, check: np.ndarray) -> None:
        self.codes, self.length, self.ratios, self.check = codes, length, ratios, check

    def take(self, which: np.ndarray | slice) -> Digests:
        return Digests(self.codes[which], self.length[which], self.ratios[which], self.check[which])

    def hex(self) -> list[str]:
        packed = np.zeros((len(self.codes), BUCKETS // 4), np.uint8)
        for k in range(4):
            packed |= self.codes[:, k::4].astype(np.uint8) << np.uint8(6 - 2 * k)
        head = np.stack([self.check, self.length, self.ratios[:, 0] << 4 | self.ratios[:, 1]], axis=1).astype(np.uint8)
        return ["Q1" + row.tobytes().hex() for row in np.concatenate([head, packed], axis=1)]


def parse(fingerprints: list[str]) -> Digests:
    """The parts of digests in hex."""
    raw = np.frombuffer(bytes.fromhex("".join(f[2:] for f in fingerprints)), np.uint8).reshape(len(fingerprints), 3 + BUCKETS // 4)
    codes = np.stack([raw[:, 3:] >> np.uint8(6 - 2 * k) & 3 for k in range(4)], axis=2).reshape(len(raw), BUCKETS)
    return Digests(codes, raw[:, 1].astype(int), np.stack([raw[:, 2] >> 4, raw[:, 2] & 15], axis=1).astype(int), raw[:, 0].astype(int))


def digests(texts: list[bytes]) -> Digests:
    """Digests of UTF-8 texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= CHUNK):
            total += len(texts[j])
            j += 1
        _count(texts[i:j], sizes[i:j], counts[i:j])
        i = j
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, k * BUCKETS // 4 - 1 : k * BUCKETS // 4] for k in (1, 2, 3))
    codes = (counts > q1).astype(np.int8) + (counts > q2) + (counts > q3)
    length = np.minimum(255, np.round(8 * np.log2(1 + sizes))).astype(int)
    over = np.maximum(q3, 1)
    ratios = np.concatenate([15 * q1 // over, 15 * q2 // over], axis=1)
    check = np.array([zlib.crc32(t) & 255 for t in texts], int)
    return Digests(codes, length, ratios, check)


def _count(texts: list[bytes], sizes: np.ndarray, out: np.ndarray) -> None:
    """Add the bucket counts of the texts to ``out``."""
    tail = WINDOW - 1
    data = np.frombuffer(b"".join([t + (t * tail)[:tail] for t in texts]), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts)) * BUCKETS, sizes + tail * (sizes > 0))
    ends = np.cumsum(sizes + tail * (sizes > 0))[sizes > 0]
    keep = np.ones(len(data), bool)
    for k in range(1, tail + 1):
        keep[ends - k] = False
    at = np.flatnonzero(keep)
    if not len(at):
        return
    n, row = len(data) - tail, row[at]
    first = data[:n] * _K1
    for salt, (b, c) in enumerate(TRIPLETS, 1):
        h = (first + data[b : b + n] * _K2 + data[c : c + n] * _K3 + np.uint32(salt)) * _M
        out += np.bincount(row + (h >> np.uint32(25))[at].astype(np.int64), minlength=out.size).reshape(out.shape)


def difference(a: Digests, b: Digests) -> np.ndarray:
    """Difference scores of digests, row by row: 0 for equal ones, BOUND at most."""
    body = _CODE_SCORE[np.abs(a.codes.astype(int) - b.codes)].sum(axis=1)
    head = np.minimum(40, np.abs(a.length - b.length)) + np.abs(a.ratios - b.ratios).sum(axis=1) + (a.check != b.check)
    return np.minimum(BOUND, body + head)


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """1 for equal digests, 0 at the bound of the difference score."""
    return 1 - difference(a, b) / BOUND


_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each own row of a sorted partition: its digest and the likeness to its edited text and to the next row."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["role"].to_pylist(), strict=True):
            if row[2] == BEFORE:
                continue
            if len(held) > 1 and held[-1][2] == AFTER:
                break
            held.append(row)
            if len(held) >= 512 or len(held) > 1 and sum(len(r[1] or "") for r in held[-8:]) > CHUNK:
                yield from _compared(held)
                held = held[-1:]
    yield from _compared(held)


def _compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """All rows but the last, each against the one after it."""
    if len(rows) < 2:
        return
    texts = [r[1] or "" for r in rows]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
    plain, changed = digests([t.encode() for t in texts]), digests([t.encode() for t in edited])
    a, b = plain.take(slice(0, -1)), plain.take(slice(1, None))
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(([r[0] for r in rows[:-1]], [len(t) for t in texts[:-1]], edited, a.hex(), changed.hex(), likeness(a, changed), likeness(a, b)), _EDITED, strict=True)],
        schema=_EDITED,
    )


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has its last half replaced by the beginning of the next document by id, the
    last document's by that of the first. One range shuffle of the texts.
    """
    # Rows of one id, or without one, are dealt by their texts, so that they don't make one partition.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"), F.xxhash64("text").alias("tie"), F.col("doc_id").cast("long"), "text")
    laid = ordered_with_edges(rows, ["at", "tie"], ["text"], wrap=True)
    return laid.select("doc_id", "text", "role").mapInArrow(_against_next, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document; no shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digests(texts).hex() if texts else [], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, fingerprint string")
