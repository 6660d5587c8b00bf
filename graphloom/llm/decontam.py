"""Benchmark decontamination by latent semantic retrieval.

Document frequencies of hashed words are counted over all documents. The benchmark's passages
become TF-IDF rows with them, and a randomised SVD, whose sums over rows run in Spark, gives the
latent space of each block of RANK passages; an item's inner products with any text depend on that
space only. Projection and product fold into one weight of each term for each passage, an index
from terms to passages, by which every window of every document meets the passages that it shares
terms with. Items whose cosine passes a low bound are candidates, as are items of whose own weight
the window holds a share, whatever stands beside it. An item that is spread out, with other words put
between its own, passes neither in any window: it is a candidate by the cosine in the latent space,
where what the basis does not span of a window, as words put in, does not count. Every word has a
positive weight, so that an item counts as well where a large part of all documents hold it. A
candidate is confirmed by the longest common subsequence of words of the item and of the text around
the window, for the whole item and for its answer, its last sentence. So reworded items, with words
left out, put in or replaced, count as well as exact ones, and shared phrases do not.

Items of more than LONGEST words are cut into passages of about a window's length, and an item is a
candidate where any of its passages is, so that recall does not depend on an item's length either.
A block's latent space holds its row space whole, so that recall does not depend on the number of
passages; time and the index grow in proportion to it.

Results for odd inputs: null and empty texts, and texts without words, match nothing; items of
fewer than LEAST_WORDS words are left out, as chance would match them; without items nothing
matches; repeated rows get equal results, and repeated items count as one each; a null id is
kept; an empty table gives no rows; extra columns pass. The longest text bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text
from .textvec import Tokens, chunks, lowered, utf8

#: Hashed words of the TF-IDF rows, and the passages of a block: the most dimensions of its latent space.
TERMS, RANK, OVERSAMPLE = 1 << 15, 256, 16
#: Words of a block; a window is WINDOW blocks, and the next one begins a block later.
BLOCK, WINDOW = 16, 3
#: Most words of a passage: items of more are cut into equal parts of a window's length at most.
LONGEST = 4 * BLOCK
#: Cosine from which an item is a candidate.
CANDIDATE = 0.3
#: Share of a passage's squared TF-IDF length in a window from which it is one too: of a passage of LONGEST
#: words at most that a text holds whole, some window has half at least.
CONTAINED = 0.4
#: Cosine in the latent space from which an item is one too, and the share of the passage's squared length that
#: the window must have for it: one shared word is all that the space sees of many a window.
LATENT, SPREAD = 0.5, 0.15
#: Shares of the words of an item, and of its answer, that the text must have in their order.
ITEM_SHARE, ANSWER_SHARE = 0.6, 0.5
LEAST_WORDS = 8
#: Passages with a term from which on it counts as a common one, whose weights are added by a product
#: with its counts; cells of the table of counts that is held at once.
_COMMON, _CELLS = 8, 1 << 21
#: Share of the largest weight below which a weight that comes back from the latent space is rounding.
_ROUNDING = 1e-6
#: Terms whose sums one row of a partial result holds.
_GROUP = 256


@dataclass
class Space:
    """The latent space of a block of passages, folded into the weight of each term in the inner product with each.

    A window's latent vector is its words' rows of the basis summed, and its inner product with a
    passage that sum times the passage's latent vector: so each term has one weight for each passage,
    the product of its row and the passage's vector. Most are 0, and the others are an index from
    terms to passages: ``common`` holds the rows of terms of many passages, the rest are postings.
    The latent vector itself is had back from the inner products with all passages by ``inverse``.
    """

    items: np.ndarray  # place in the index of each passage's item
    length: np.ndarray  # of the TF-IDF row
    row: np.ndarray  # of a term: in common, or len(common) plus its place in starts; -1 for others
    common: np.ndarray
    starts: np.ndarray
    passage: np.ndarray
    weight: np.ndarray
    size: np.ndarray  # of each passage's latent vector
    inverse: np.ndarray  # from inner products with the passages to latent vectors

    @classmethod
    def of(cls, items: np.ndarray, length: np.ndarray, used: np.ndarray, basis: np.ndarray, latent: np.ndarray) -> Space:
        """From the used terms' rows of the basis, times their idf, and the passages' latent vectors."""
        table = (basis @ latent.T).astype(np.float32)
        table[np.abs(table) < _ROUNDING * max(float(np.abs(table).max(initial=0)), 1e-12)] = 0
        held = (table != 0).sum(axis=1)
        order = np.argsort(held < _COMMON, kind="stable")
        n = int((held >= _COMMON).sum())
        row = np.full(TERMS, -1)
        row[used[order]] = np.arange(len(used))
        rest = table[order[n:]]
        at, passage = np.nonzero(rest)
        size, inverse = np.linalg.norm(latent, axis=1).astype(np.float32), np.linalg.pinv(latent).T.astype(np.float32)
        return cls(items, length, row, table[order[:n]], np.searchsorted(at, np.arange(len(rest) + 1)), passage, rest[at, passage], size, inverse)

    def inner(self, terms: np.ndarray, block: np.ndarray, n_blocks: int) -> np.ndarray:
        """Inner products of each block's words with each passage."""
        row = self.row[terms]
        n, width = len(self.common), len(self.items)
        rare = np.flatnonzero(row >= n)
        first, many = self.starts[row[rare] - n], np.diff(self.starts)[row[rare] - n]
        entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        cells = np.repeat(block[rare], many) * width + self.passage[entry]
        sums = np.bincount(cells, self.weight[entry], n_blocks * width).astype(np.float32).reshape(n_blocks, width)
        if n:
            often = np.flatnonzero((row >= 0) & (row < n))
            row, block = row[often], block[often]
            step = max(1, _CELLS // n)
            for a in range(0, n_blocks, step):
                size = min(step, n_blocks - a)
                part = slice(*np.searchsorted(block, [a, a + size]))
                counts = np.bincount((block[part] - a) * n + row[part], minlength=size * n)
                sums[a : a + size] += counts.reshape(size, n).astype(np.float32) @ self.common
        return sums

    def cosines(self, inner: np.ndarray, at: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Cosines in the latent space of windows and passages, given the windows' inner products with all passages; ``at`` ascends."""
        window = np.flatnonzero(np.diff(at, prepend=-1))
        length = np.concatenate([np.zeros(0, np.float32), *(np.linalg.norm(inner[at[window[a : a + 4096]]] @ self.inverse, axis=1) for a in range(0, len(window), 4096))])
        size = np.repeat(length, np.diff(np.append(window, len(at)))) * self.size[passage]
        return inner[at, passage] / np.maximum(size, 1e-12)


@dataclass
class Index:
    """The benchmark's items and the latent spaces of the blocks of their passages."""

    items: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    places: list[dict[int, int]] = field(default_factory=list)  # of each word of an item, as bits
    terms: list[np.ndarray] = field(default_factory=list)  # of each word of an item
    answers: list[int] = field(default_factory=list)  # words of the last sentence
    idf: np.ndarray = field(default_factory=lambda: np.zeros(TERMS))
    spaces: list[Space] = field(default_factory=list)


def _terms(words: Tokens) -> np.ndarray:
    return (words.hash >> np.uint64(64 - (TERMS.bit_length() - 1))).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that contain each hashed word, documents with words) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros(TERMS + 1, np.int64), np.zeros(TERMS, np.int64)
        for batch in batches:
            data, offsets = utf8(lowered(batch["text"]))
            for i, j in chunks(offsets):
                words = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for a in range(0, j - i, 64):
                    first, last = np.searchsorted(words.doc, [a, a + 64])
                    seen = np.zeros((64, TERMS), bool)
                    seen[words.doc[first:last] - a, _terms(words)[first:last]] = True
                    found += seen.sum(axis=0)
                total[TERMS] += int((words.counts > 0).sum())
        total[:TERMS] = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1, np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out[:TERMS], int(out[TERMS])


def _weights_of(text: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(terms, TF-IDF weights of unit length, length before) of each passage."""
    data, offsets = utf8(lowered(text))
    words = Tokens(data, offsets)
    for part in np.split(_terms(words), np.cumsum(words.counts)[:-1]):
        terms, n = np.unique(part, return_counts=True)
        weight = n * idf[terms]
        length = max(1e-12, float(np.sqrt((weight**2).sum())))
        yield terms, weight / length, length


def _rows_of(text: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, TF-IDF weights of unit length) of each passage."""
    return ((terms, weight) for terms, weight, _ in _weights_of(text, idf))


def _summed(passages: DataFrame, idf: np.ndarray, used: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A'A x test for the TF-IDF rows A of the passages over the used terms, added up in Spark by groups of terms."""
    sent = passages.sparkSession.sparkContext.broadcast((idf, used, test.astype(np.float32)))
    n, width = test.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, used, test = sent.value
        out = np.zeros((-(-n // _GROUP) * _GROUP, width), np.float32)
        for batch in batches:
            for terms, weight in _rows_of(batch["text"], idf):
                at, w = np.searchsorted(used, terms), weight.astype(np.float32)
                out[at] += w[:, None] * (w @ test[at])
        groups = np.flatnonzero(np.abs(out).reshape(-1, _GROUP * width).max(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array([out[g * _GROUP : (g + 1) * _GROUP].tobytes() for g in groups], pa.binary())], ["group", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_GROUP * width, np.float64)
        for x in sorted(rows["sums"]):
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "sums": [total.tobytes()]})

    # A task gives TERMS / _GROUP rows of bounded size at most; a group holds one row of each task.
    got = passages.select(F.col("text").cast("string").alias("text")).mapInArrow(partial, "group int, sums binary").groupBy("group").applyInPandas(add, "group int, sums binary").toPandas()
    out = np.zeros((-(-n // _GROUP) * _GROUP, width))
    for g, sums in zip(got["group"], got["sums"], strict=True):
        out[g * _GROUP : (g + 1) * _GROUP] = np.frombuffer(sums, np.float64).reshape(_GROUP, width)
    return out[:n]


def latent_basis(passages: DataFrame, idf: np.ndarray, used: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal right singular vectors (used terms x rank at most) of the passages' TF-IDF rows."""
    rng = np.random.default_rng(23)
    basis = rng.normal(size=(len(used), rank + OVERSAMPLE))
    for _ in range(2):
        basis, _r = np.linalg.qr(_summed(passages, idf, used, basis))
    core = basis.T @ _summed(passages, idf, used, basis)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = np.argsort(values)[::-1][:rank]
    kept = kept[values[kept] > 1e-7 * max(values.max(), 1e-12)]
    return basis @ vectors[:, kept]


def build(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Index:
    """The index of a benchmark (item_id, text) against a corpus. The benchmark is held by the driver."""
    found, total = document_frequencies(docs)
    idf = np.log((total + 1) / (found + 1)) + 0.1
    benchmark = benchmark.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    items = benchmark.toPandas().sort_values(["item_id", "text"])
    index = Index(idf=idf)
    if items.empty:
        return index
    data, offsets = utf8(lowered(pa.array(items["text"].tolist(), pa.string())))
    words = Tokens(data, offsets)
    chosen = np.flatnonzero(words.counts >= LEAST_WORDS)
    if not len(chosen):
        return index
    starts = np.concatenate([[0], np.cumsum(words.counts)])
    passages, of = [], []
    for k in chosen:
        text = items["text"].iloc[k]
        own = slice(starts[k], starts[k + 1])
        index.items.append(int(items["item_id"].iloc[k]))
        index.words.append(words.hash[own])
        index.places.append(places_of(words.hash[own]))
        index.terms.append(_terms(words)[own])
        stops = [p for p in (text.rstrip(" .!?\n").rfind(c) for c in ".!?\n") if p >= 0]
        cut = offsets[k] + len(text[: max(stops)].lower().encode()) if stops else offsets[k]
        index.answers.append(int((words.start[own] >= cut).sum()))
        n = int(words.counts[k])
        parts = -(-n // (BLOCK * WINDOW)) if n > LONGEST else 1
        for i in range(parts):
            a, b = starts[k] + n * i // parts, starts[k] + n * (i + 1) // parts
            passages.append(data[words.start[a] : words.end[b - 1]].tobytes().decode())
            of.append(len(index.items) - 1)
    rows = list(_weights_of(pa.array(passages, pa.string()), idf))
    spark = benchmark.sparkSession
    for a in range(0, len(rows), rank):
        block = rows[a : a + rank]
        used = np.unique(np.concatenate([terms for terms, _, _ in block]))
        basis = latent_basis(spark.createDataFrame([(x,) for x in passages[a : a + rank]], "text string"), idf, used, len(block))
        latent = np.stack([weight @ basis[np.searchsorted(used, terms)] for terms, weight, _ in block])
        length = np.array([x for _, _, x in block], np.float32)
        index.spaces.append(Space.of(np.array(of[a : a + rank]), length, used, basis * idf[used, None], latent))
    return index


def places_of(item: np.ndarray) -> dict[int, int]:
    """The places of each word of a sequence, as the bits of a number."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


def common_words(places: dict[int, int], n: int, text: list[int], skip: int = 0) -> int:
    """Length of the longest common subsequence of a text and a sequence of n words without its first ``skip``."""
    hits = [m for w in text if (m := places.get(w, 0) >> skip)]
    full = s = (1 << n - skip) - 1
    for m in hits:
        u = m & s
        s = (s + u | s - u) & full
    return n - skip - s.bit_count()


def candidates(words: Tokens, index: Index, latent: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, item, cosine of its best passage) of the windows of a chunk that pass a bound, the best first; ``latent``: or that of the latent space."""
    n_blocks = -(-words.counts // BLOCK)
    doc_first = np.cumsum(words.counts) - words.counts
    block_doc = np.repeat(np.arange(len(n_blocks)), n_blocks)
    within = np.arange(int(n_blocks.sum())) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    first = doc_first[block_doc] + within * BLOCK
    if not len(first) or not index.items:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    terms = _terms(words)
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(terms))))
    norms = np.bincount(block, index.idf[terms] ** 2, len(first))
    norm = np.sqrt(np.maximum(_windows(norms, block_doc), 1e-12)).astype(np.float32)
    parts = []
    for space in index.spaces:
        inner = _windows(space.inner(terms, block, len(first)), block_doc)
        at, item = np.nonzero(inner >= np.minimum((CANDIDATE * norm)[:, None], (SPREAD if latent else CONTAINED) * space.length))
        if latent:
            passed = inner[at, item] >= np.minimum(CANDIDATE * norm[at], CONTAINED * space.length[item])
            rest = np.flatnonzero(~passed)
            passed[rest] = space.cosines(inner, at[rest], item[rest]) >= LATENT
            at, item = at[passed], item[passed]
        parts.append((first[at], space.items[item], inner[at, item] / norm[at]))
    at, item, cosine = (np.concatenate(x) for x in zip(*parts, strict=True))
    best = np.lexsort([-cosine, item, at])
    at, item, cosine = at[best], item[best], cosine[best]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (item[1:] != item[:-1])])) if len(at) else np.zeros(0, int)
    head = head[np.argsort(-cosine[head], kind="stable")]
    return at[head], item[head], cosine[head]


def _windows(blocks: np.ndarray, block_doc: np.ndarray) -> np.ndarray:
    """Sums over the blocks of the window that begins at each block."""
    whole = blocks.copy()
    for step in range(1, WINDOW):
        same = np.flatnonzero(block_doc[:-step] == block_doc[step:])
        whole[same] += blocks[same + step]
    return whole


def matches(docs: DataFrame, index: Index, keep: list[str | Column], at: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of docs and ``found``: the items in the column text, with their evidence; no shuffle.

    found is an array of (item_id, cosine, item_share, answer_share), one for each item. A kept
    column of that name gives way. ``at`` says where ``keep`` has the text, as for map_text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)
    struct = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("item_share", pa.float64()), ("answer_share", pa.float64())]))

    def of(text: pa.Array) -> list[pa.Array]:
        index = sent.value
        data, offsets = utf8(lowered(text))
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for i, j in chunks(offsets):
            words = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = np.cumsum(words.counts)
            terms, seen_terms = _terms(words), np.zeros(TERMS, bool)
            best: dict[tuple[int, int], dict] = {}
            seen: set[tuple[int, int, int]] = set()
            for first, item, cosine in zip(*(x.tolist() for x in candidates(words, index, latent=True)), strict=True):
                doc = int(words.doc[first])
                own, answer = index.words[item], index.answers[item]
                old = best.get((doc, index.items[item]))
                if old is not None and old["item_share"] == old["answer_share"] == 1 and min(1.0, cosine) <= old["cosine"]:
                    continue  # it is found whole: no other window can say more
                around = len(own) + len(own) // 2
                a, b = max(first - around, int(ends[doc] - words.counts[doc])), min(first + BLOCK * WINDOW + around, int(ends[doc]))
                if (item, a, b) in seen:
                    continue  # the same text, and a cosine that is no better
                seen.add((item, a, b))
                seen_terms[terms[a:b]] = True
                present = np.count_nonzero(seen_terms[index.terms[item]])
                seen_terms[terms[a:b]] = False
                if present < ITEM_SHARE * len(own):
                    continue  # so many of its words are not there at all that no order can have enough
                near, places = words.hash[a:b].tolist(), index.places[item]
                share = common_words(places, len(own), near) / len(own)
                if share < ITEM_SHARE:
                    continue
                answered = common_words(places, len(own), near, skip=len(own) - answer) / answer if answer else 1.0
                if answered < ANSWER_SHARE:
                    continue
                row = {"item_id": index.items[item], "cosine": min(1.0, cosine), "item_share": share, "answer_share": answered}
                if old is None or (share, answered, cosine) > (old["item_share"], old["answer_share"], old["cosine"]):
                    best[doc, index.items[item]] = row
            for (doc, _), row in sorted(best.items()):
                out[i + doc].append(row)
        return [pa.array(out, struct)]

    return map_text(docs, keep, "found array<struct<item_id:long,cosine:double,item_share:double,answer_share:double>>", of, at)
