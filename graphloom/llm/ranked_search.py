"""Ranked lexical search over an inverted index of shards, exact, with posting blocks of variable length.

``build`` reads the documents twice: once for the number of documents with terms (N) and of all terms
(L), once to write the index. A shard is a run of documents of about SHARD_BYTES of text; the index
has one row for each shard and term (the ordinals and counts of the documents that hold it) and one
for the shard's documents. Each posting list is cut into blocks by dynamic programming: the cuts
minimise the sum over blocks of length times largest impact (how far the block's bound overshoots
its postings) plus BLOCK_COST a block.

``search`` takes the queries in sets of at most QUERY_TERMS terms, reads only the postings of their
terms, deals them out by shard and searches shard after shard. The blocks' bounds of a query's terms
add up to a step function over the shard's documents; only stretches whose bound reaches the query's
k-th score so far are scored, best first. A task carries its best k from shard to shard and returns
them once. A term in every document is spread over all shards, so no list or shard grows with the corpus.

A term's weight and an impact are integers (see ``weight`` and ``impact``), so scores are exact.

Results for odd inputs: null or empty texts have no terms and do not count in N; each row is a
document of its own, also where rows or ids repeat; equal scores go by ascending doc_id, null first;
rows of one item_id are one query with the terms of all of them; an item without terms, or whose terms
no document holds with a weight above 0, has no rows; an empty table gives none; other columns are
ignored. The longest text bounds a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, scratch
from .textvec import chunks, let_go, release, term_spans, terms_of, utf8

#: Text of a shard, in bytes; one longer document is a shard of its own. At most _SHARD_DOCS documents.
SHARD_BYTES = 8 << 20
_SHARD_DOCS = 1 << 16
#: What a block costs beside the overshoot of its bound, in units of impact (an impact is below a million).
BLOCK_COST = 1_500_000
#: Longest block, and postings that are cut in one go (a cut falls after each of these at the latest).
_LONGEST, _STRETCH = 64, 2048
#: Terms of the queries of one pass over the index.
QUERY_TERMS = 200_000
#: Documents scored first in a shard, before the bound is looked at again.
_FIRST = 64


@dataclass
class Index:
    """Folder of the postings, number of documents with terms and of all their terms."""

    folder: str
    n_docs: int
    n_terms: int


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The m of documents of n terms."""
    return 75 + (25 * n * n_docs) // max(n_terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What tf occurrences add for each unit of weight in documents of length norm m."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def cut_blocks(scores: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of several lists of impacts: the length and largest impact of each, and the offsets of the lists' blocks.

    ``scores`` holds the lists one after the other. best[i] = BLOCK_COST + min over a last block of k
    postings of best[i - k] + k * (their largest), for all lists (in stretches) at once.
    """
    counts = np.diff(offsets)
    is_end = np.zeros(int(offsets[-1]) + 1, bool)  # positions after a block's last posting
    is_end[offsets[1:]] = True
    many = np.flatnonzero(counts > 1)
    pieces = -(-counts[many] // _STRETCH)
    owner = np.repeat(many, pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(counts[owner] - nth * _STRETCH, _STRETCH)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], (offsets[:-1][owner] + nth * _STRETCH)[order]
    base = np.zeros(len(order) + 1, np.int64)  # a stretch of n postings has n + 1 states
    np.cumsum(length + 1, out=base[1:])
    best, back = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int16)
    most = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(1, most + 1), "right")  # stretches of at least i postings
    wide, tops = np.arange(1, _LONGEST + 1), np.zeros((len(order), _LONGEST), np.int64)
    for i in range(1, most + 1):
        n, k = int(live[i - 1]), min(i, _LONGEST)
        s, tops, state = scores[begin[:n] + (i - 1)], tops[:n], base[:n] + i
        tops[:, 1:k] = np.maximum(tops[:, : k - 1], s[:, None])
        tops[:, 0] = s
        cost = tops[:, :k] * wide[:k] + best[state[:, None] - wide[:k]]
        back[state] = cost.argmin(axis=1) + 1
        best[state] = cost[np.arange(n), back[state] - 1] + BLOCK_COST
    at, who = length.copy(), np.arange(len(order))
    while len(who):
        is_end[begin[who] + at] = True
        at = at - back[base[who] + at]
        who, at = who[at > 0], at[at > 0]
    ends = np.flatnonzero(is_end[1:]) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    tops = np.maximum.reduceat(scores, starts) if len(ends) else scores[:0]
    return ends - starts, tops, np.searchsorted(ends, offsets, "right")


_ROWS = "shard long, term string, df long, ords binary, counts binary, lengths binary, tops binary, ids array<long>, norms binary"


def _binaries(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each run of a flat array."""
    sizes = (offsets * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(flat))])


def _shard_rows(number: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """Index rows of one shard: its documents first, with a null term, then its terms."""
    words, term, doc = terms_of(data, offsets)
    norms = length_norm(np.bincount(doc, minlength=len(ids)), n_docs, n_terms)
    pairs, tf = np.unique(term * len(ids) + doc, return_counts=True)
    term, ords = np.divmod(pairs, len(ids))
    at = np.searchsorted(term, np.arange(len(words) + 1))
    lengths, tops, blocks = cut_blocks(impact(tf, norms[ords]), at)
    none = pa.nulls(1, pa.binary())
    columns = [
        pa.array(np.full(len(words) + 1, number)), pa.concat_arrays([pa.nulls(1, pa.string()), words.cast(pa.string())]), pa.array(np.concatenate([[0], np.diff(at)])),
        pa.concat_arrays([none, _binaries(ords.astype(np.uint16), at)]), pa.concat_arrays([none, _binaries(tf.astype(np.uint32), at)]),
        pa.concat_arrays([none, _binaries(lengths.astype(np.uint8), blocks)]), pa.concat_arrays([none, _binaries(tops.astype(np.uint32), blocks)]),
        pa.concat_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.nulls(len(words), pa.list_(pa.int64()))]),
        pa.concat_arrays([pa.array([norms.astype(np.int64).tobytes()], pa.binary()), pa.nulls(len(words), pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ROWS.split(", ")])


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """Write the index of the columns doc_id and text of ``docs`` to the session's shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            held = terms = 0
            for i, j in chunks(offsets):
                at = offsets[i : j + 1] - offsets[i]
                each = np.diff(np.searchsorted(term_spans(data[offsets[i] : offsets[j]], at)[1], at))
                held, terms = held + int((each > 0).sum()), terms + int(each.sum())
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([terms])], ["held", "terms"])

    total = texts.select("text").mapInArrow(count, "held long, terms long").agg(F.sum("held").alias("held"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = total["held"] or 0, total["terms"] or 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        number, held = TaskContext.get().partitionId() << 32, []

        def whole() -> pa.RecordBatch:
            ids, parts, lengths = zip(*held, strict=True)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            return _shard_rows(number, pa.concat_arrays(ids), np.concatenate(parts), offsets, n_docs, n_terms)

        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in chunks(offsets, shard_bytes):
                for i in range(a, b, _SHARD_DOCS):
                    j = min(b, i + _SHARD_DOCS)
                    if held and (sum(len(p) for _, p, _ in held) + offsets[j] - offsets[i] > shard_bytes or sum(map(len, (x for x, _, _ in held))) + j - i > _SHARD_DOCS):
                        yield whole()
                        number, held = number + 1, []
                    held.append((batch["doc_id"].slice(i, j - i), data[offsets[i] : offsets[j]].copy(), np.diff(offsets[i : j + 1])))
        if held:
            yield whole()
        release()

    folder = scratch(docs.sparkSession)
    texts.mapInArrow(rows, _ROWS).write.parquet(folder)
    return Index(folder, n_docs, n_terms)


@dataclass
class _Asked:
    """A set of queries: item ids, the place of each term, and the terms and weights of each item as runs."""

    items: pa.Array
    terms: dict[str, int]
    offsets: np.ndarray
    term: np.ndarray
    weights: np.ndarray


class _Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        none = np.zeros(0, np.int64)
        self.k, self.least = k, np.ones(items, np.int64)
        self.scores, self.ids, self.known = [none] * items, [none] * items, [none.astype(bool)] * items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = (np.concatenate(x) for x in ((self.scores[item], scores), (self.ids[item], ids), (self.known[item], known)))
        order = np.lexsort((ids, known, -scores))[: self.k]
        self.scores[item], self.ids[item], self.known[item] = scores[order], ids[order], known[order]
        if len(order) == self.k:
            self.least[item] = scores[order[-1]]

    def rows(self, items: pa.Array) -> pa.RecordBatch:
        each = np.repeat(np.arange(len(items)), [len(s) for s in self.scores])
        scores, ids, known = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.scores, self.ids, self.known))
        return pa.RecordBatch.from_arrays([items.take(pa.array(each)), pa.array(ids, pa.int64(), mask=~known.astype(bool)), pa.array(scores)], ["item_id", "doc_id", "score"])


def _search_shard(asked: _Asked, lists: dict[int, tuple[np.ndarray, ...]], ids: np.ndarray, known: np.ndarray, norms: np.ndarray, best: _Best) -> int:
    """Search one shard for all items; returns the number of documents that were scored."""
    n, scored = len(ids), 0
    steps = {}
    for t, (ords, _, lengths, tops) in lists.items():
        last = np.cumsum(lengths.astype(np.int64)) - 1
        begin = ords[last - lengths + 1].astype(np.int64)
        steps[t] = np.concatenate([begin, ords[last] + np.int64(1)]), np.concatenate([tops.astype(np.int64), -tops.astype(np.int64)])
    impacts: dict[int, np.ndarray] = {}
    total = np.zeros(n, np.int64)
    for item in range(len(asked.items)):
        run = slice(asked.offsets[item], asked.offsets[item + 1])
        own = [(t, w) for t, w in zip(asked.term[run].tolist(), asked.weights[run].tolist(), strict=True) if t in lists]
        if not own:
            continue
        place = np.concatenate([steps[t][0] for t, _ in own])
        order = np.argsort(place, kind="stable")
        place = place[order]
        bound = np.cumsum(np.concatenate([steps[t][1] * w for t, w in own])[order])[:-1]
        full = np.flatnonzero((place[1:] > place[:-1]) & (bound >= best.least[item]))
        full = full[np.argsort(-bound[full], kind="stable")]
        at, want = 0, _FIRST
        while at < len(full) and bound[full[at]] >= best.least[item]:
            sizes = np.cumsum(place[full[at:] + 1] - place[full[at:]])
            to = at + int(np.searchsorted(sizes, want)) + 1
            part = full[at:to]
            part = part[bound[part] >= best.least[item]]
            at, want = to, want * 4
            change = np.zeros(n + 1, np.int8)
            change[place[part]] += 1
            change[place[part + 1]] -= 1
            inside = np.cumsum(change[:-1], dtype=np.int8) > 0
            for t, w in own:
                ords, counts, _, _ = lists[t]
                hit = inside[ords]
                if not hit.any():
                    continue
                if t not in impacts:
                    impacts[t] = impact(counts, norms[ords])
                total[ords[hit]] += impacts[t][hit] * w
            docs = np.flatnonzero(inside)
            scored += len(docs)
            docs = docs[total[docs] >= best.least[item]]
            if len(docs):
                best.add(item, total[docs], ids[docs], known[docs])
            total[inside] = 0
    return scored


def _shards(batches: Iterator[pa.RecordBatch], terms: dict[str, int]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """The posting lists of the asked terms, ids (whether known) and length norms of shard after shard, from rows in order."""
    kinds = (("ords", np.uint16), ("counts", np.uint32), ("lengths", np.uint8), ("tops", np.uint32))
    shard, lists, docs = None, {}, None
    for batch in batches:
        for k, (number, term) in enumerate(zip(batch["shard"].to_pylist(), batch["term"].to_pylist(), strict=True)):
            if number != shard:
                if docs:
                    yield lists, *docs
                shard, lists = number, {}
            if term is None:
                ids = batch["ids"][k].values
                docs = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), np.frombuffer(batch["norms"][k].as_py(), np.int64)
            else:
                lists[terms[term]] = tuple(np.frombuffer(batch[name][k].as_py(), kind) for name, kind in kinds)
    if docs:
        yield lists, *docs


def _asked_terms(queries: DataFrame) -> DataFrame:
    """item_id, term and number of occurrences of the texts of ``queries``."""
    kind = queries.schema["item_id"].dataType

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for i, j in chunks(offsets):
                found, term, doc = terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                pairs, n = np.unique(term * (j - i) + doc, return_counts=True)
                term, doc = np.divmod(pairs, j - i)
                yield pa.RecordBatch.from_arrays([batch["item_id"].slice(i, j - i).take(pa.array(doc)), found.take(pa.array(term)).cast(pa.string()), pa.array(n)], ["item_id", "term", "n"])

    rows = queries.select("item_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(words, f"item_id {kind.simpleString()}, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def search(index: Index, queries: DataFrame, k: int = 20, set_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents for each text of ``queries`` (item_id, text).

    The driver and each task hold the terms of one set of queries at a time, about ``set_terms``
    (items are dealt by a hash), and k rows for each item of the set.
    """
    spark = queries.sparkSession
    folder = scratch(spark)
    _asked_terms(queries).write.parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    sets = max(1, -(-asked.count() // set_terms))
    if sets == 1:
        return _ranked(_search_set(spark, index, asked, k), k)
    for number in range(sets):
        _search_set(spark, index, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == number), k).write.parquet(f"{folder}/found/{number}")
    return _ranked(spark.read.parquet(*[f"{folder}/found/{number}" for number in range(sets)]), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """At most k rows of an item for each task that searched come in here."""
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_set(spark: SparkSession, index: Index, asked: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id and score of each task's k best documents for each item of one set."""
    postings = spark.read.schema(_ROWS).parquet(index.folder)
    terms = F.broadcast(asked.select("term").distinct())  # QUERY_TERMS rows at most
    df = postings.select("term", "df").where("term is not null").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    got = asked.join(F.broadcast(df), "term").toArrow().combine_chunks()  # df: a row for each asked term
    weights = [n * weight(index.n_docs, d) for n, d in zip(got["n"].to_pylist(), got["df"].to_pylist(), strict=True)]
    items = got["item_id"].combine_chunks().dictionary_encode("encode")
    names = got["term"].combine_chunks().dictionary_encode()
    item, weights, term = items.indices.to_numpy(), np.array(weights, np.int64), names.indices.to_numpy()
    order = np.argsort(item, kind="stable")
    order = order[weights[order] > 0]
    sent = spark.sparkContext.broadcast(_Asked(items.dictionary, {t: i for i, t in enumerate(names.dictionary.to_pylist())}, np.searchsorted(item[order], np.arange(len(items.dictionary) + 1)), term[order], weights[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        queries = sent.value
        best = _Best(len(queries.items), k)
        for lists, ids, known, norms in _shards(batches, queries.terms):
            _search_shard(queries, lists, ids, known, norms, best)
        yield best.rows(queries.items)
        release()

    needed = postings.join(terms, "term", "left_semi").unionByName(postings.where("term is null"))
    dealt = needed.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return dealt.mapInArrow(run, f"item_id {asked.schema['item_id'].dataType.simpleString()}, doc_id long, score long")


def oracle_sql(k: int = 20) -> str:
    """DuckDB SQL for item_id, rank, doc_id and score over documents and benchmark."""
    words = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) AS term"
    return f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
word AS MATERIALIZED (SELECT id, {words} FROM doc),
size AS MATERIALIZED (SELECT id, count(*) AS n FROM word GROUP BY id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
norm AS MATERIALIZED (SELECT id, 75 + (25 * n * docs) // terms AS m FROM size, whole),
asked AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {words} FROM benchmark) GROUP BY ALL),
held AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term, docs),
scored AS (SELECT item_id, id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN held USING (term) JOIN norm USING (id) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN doc USING (id) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
