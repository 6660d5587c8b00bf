"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become token ids plus an end mark. Longer ones are cut into full pieces, of which only
the first may be shorter; full pieces are sequences by themselves. The rest is bin packing. The
pieces are dealt at random into shards of bounded size. Each shard is solved by islands: a
population of packings starts from best-fit-decreasing orders with random keys; crossover injects
the well-filled bins of one parent whole into the other, removes the bins that hold duplicates and
best-fits the displaced documents, largest first. After each epoch an island's elite migrates to
the next island of its shard. At last the bins that a shard could not fill are opened, and their
pieces are dealt into fewer shards and solved again, until one shard holds them or ROUNDS are over.

State is one bounded row for each shard and island, written to the checkpoint folder between
epochs, so that a lost executor repeats one epoch of its rows.

Results for odd inputs: a null text is an empty one; an empty document is the end mark alone; each
repeated row is a document of its own; a null id is kept; an empty table gives no rows; other
columns are ignored. The longest text bounds a task's memory.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import checkpointed, partitions
from .textvec import chunks, held, release, utf8

CAPACITY = 1024
END = 2
#: Pieces of a shard, about; islands of a shard; packings of an island; generations of an epoch.
SHARD = 2048
ISLANDS = 2
POPULATION = 4
GENERATIONS = 4
EPOCHS = 2
#: A bin with more free places than this is opened and packed again with those of other shards.
SLACK = 8
ROUNDS = 3

_BYTES_AT_ONCE = 1 << 19

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document; no shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            _, offsets = utf8(batch["text"])
            for i, j in chunks(offsets, _BYTES_AT_ONCE):
                part = batch.slice(i, j - i)
                yield _cut(part["doc_id"].to_pylist(), *encoder.encode([t or "" for t in part["text"].to_pylist()]), capacity)
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES_SQL)


def _cut(doc_ids: list, ids: np.ndarray, counts: np.ndarray, capacity: int) -> pa.RecordBatch:
    rows: list[tuple] = []
    at = 0
    for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
        own = np.append(ids[at : at + n], np.uint32(END)).astype("<u4")
        at += n
        stops = list(range(len(own) % capacity or capacity, len(own) + 1, capacity)) if len(own) > capacity else [len(own)]
        start = 0
        for k, stop in enumerate(stops):
            rows.append((doc_id, k, start, stop - start, zlib.crc32(own[start:stop])))
            start = stop
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)] if rows else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)


def best_fit(order: list[int], sizes: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put the items of ``order`` in turn into the fullest of the bins that has room, or a new one."""
    open_bins = sorted((f, b) for b, f in enumerate(free))
    for item in order:
        size = sizes[item]
        k = bisect.bisect_left(open_bins, (size, -1))
        if k < len(open_bins):
            f, b = open_bins.pop(k)
            bins[b].append(item)
        else:
            f, b = capacity, len(bins)
            bins.append([item])
            free.append(capacity)
        free[b] = f - size
        if f > size:
            bisect.insort(open_bins, (f - size, b))


def fitness(free: list[int], capacity: int) -> float:
    """Mean square of the fill over bins: fewer and more unequal bins are better."""
    return sum((1 - f / capacity) ** 2 for f in free) / max(1, len(free))


def crossover(a: tuple, b: tuple, sizes: list[int], rng: random.Random, capacity: int) -> tuple:
    """A child of packing ``a`` with a random half of the well-filled bins of ``b``."""
    (bins_a, free_a), (bins_b, free_b) = a, b
    full = [k for k, f in enumerate(free_b) if f <= SLACK]
    injected = rng.sample(full, len(full) // 2) if full else []
    taken = {i for k in injected for i in bins_b[k]}
    bins, free, displaced = [bins_b[k][:] for k in injected], [free_b[k] for k in injected], []
    slack = sorted(range(len(bins_a)), key=lambda k: -free_a[k])
    loose = {k for k in slack[: max(1, len(slack) // 20)] if free_a[k]}
    for k, own in enumerate(bins_a):
        if k in loose or not taken.isdisjoint(own):
            displaced += [i for i in own if i not in taken]
        else:
            bins.append(own[:])
            free.append(free_a[k])
    displaced.sort(key=lambda i: (-sizes[i], i))
    best_fit(displaced, sizes, bins, free, capacity)
    return bins, free


def evolve(sizes: list[int], packed: list[list[int]], seed: int, capacity: int) -> list[list[int]]:
    """One epoch of an island. Packings are lists of the bin of each item, the best first."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)

    def value(p: tuple) -> tuple:
        return (len(p[0]), -fitness(p[1], capacity))

    people = []
    for bins_of in packed:
        bins: list[list[int]] = [[] for _ in range(max(bins_of, default=-1) + 1)]
        free = [capacity] * len(bins)
        for i, b in enumerate(bins_of):
            bins[b].append(i)
            free[b] -= sizes[i]
        people.append((bins, free))
    while len(people) < POPULATION:
        spread = 0 if not people else 48 * len(people)
        keys = [-s + (rng.randrange(spread) if spread else 0) for s in sizes]
        bins, free = [], []
        best_fit(sorted(range(len(sizes)), key=keys.__getitem__), sizes, bins, free, capacity)
        people.append((bins, free))
    people.sort(key=value)
    for _ in range(GENERATIONS):
        if len(people[0][0]) <= least:
            break
        a, b = rng.sample(people, 2) if len(people) > 1 else (people[0], people[0])
        people = sorted([*people, crossover(a, b, sizes, rng, capacity), crossover(b, a, sizes, rng, capacity)], key=value)[:POPULATION]
    out = []
    for bins, _ in people:
        bins_of = [0] * len(sizes)
        for k, own in enumerate(bins):
            for i in own:
                bins_of[i] = k
        out.append(bins_of)
    return out


_ISLAND_SQL = "shard int, island int, items array<long>, sizes array<int>, packed array<array<int>>"


def _epoch(seed: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row["packed"] = evolve(row["sizes"], row["packed"], hash((seed, row["shard"], row["island"])), capacity)
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("items", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("packed", pa.list_(pa.list_(pa.int32())))]))

    return run


def _solve(items: DataFrame, shards: int, seed: int, capacity: int) -> DataFrame:
    """item, size, shard, bin, at (offset in the bin) and slack (free places of the bin)."""
    parts = max(1, min(partitions(items.sparkSession), shards * ISLANDS))
    dealt = items.groupBy(F.expr(f"cast(pmod(xxhash64(item, {seed}), {shards}) as int)").alias("shard")).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "item"))).alias("rows"))  # SHARD rows about, by the hash of a unique number
    dealt = checkpointed(dealt.select("shard", F.expr("transform(rows, r -> r.item)").alias("items"), F.expr("transform(rows, r -> cast(-r.s as int))").alias("sizes")))
    islands = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "items", "sizes", F.expr("cast(array() as array<array<int>>)").alias("packed"))
    for epoch in range(EPOCHS):
        if epoch:  # the best packing of each island replaces the worst of the next one
            elites = islands.select("shard", F.expr(f"(island + 1) % {ISLANDS}").alias("island"), F.col("packed")[0].alias("elite"))
            islands = islands.join(elites, ["shard", "island"]).select("shard", "island", "items", "sizes", F.expr(f"concat(slice(packed, 1, {POPULATION - 1}), array(elite))").alias("packed"))
        islands = checkpointed(islands.repartition(parts, "shard", "island").mapInArrow(_epoch(seed * 100 + epoch, capacity), _ISLAND_SQL))
    score = F.expr("array_max(packed[0])")
    best = islands.groupBy("shard").agg(F.min_by("island", F.struct(score, "island")).alias("island"))
    won = islands.join(best, ["shard", "island"]).select("shard", F.explode(F.arrays_zip("items", "sizes", F.col("packed")[0].alias("bin"))).alias("r"))
    flat = won.select("shard", F.col("r.items").alias("item"), F.col("r.sizes").alias("size"), F.col("r.bin").alias("bin"))
    # A bin holds as many pieces as it has places, at most: the group is bounded by the capacity.
    bins = flat.groupBy("shard", "bin").agg(F.array_sort(F.collect_list(F.struct("item", "size"))).alias("rows"))
    bins = bins.select("shard", "bin", F.expr(f"{capacity} - aggregate(rows, 0, (s, r) -> s + r.size)").alias("slack"), F.posexplode("rows").alias("k", "r"), "rows")
    return bins.select(F.col("r.item").alias("item"), F.col("r.size").alias("size"), "shard", "bin", F.expr("aggregate(slice(rows, 1, k), cast(0 as long), (s, r) -> s + r.size)").alias("at"), "slack")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with the sequence and the offset that each is packed at."""
    cut = checkpointed(pieces(docs, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id()))
    full = cut.where(F.col("length") == capacity).select("item", (F.col("item") * 8 + 7).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_items = cut.where(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("size"))
    placed = full
    for level in range(ROUNDS):
        count = open_items.count()
        if not count:
            break
        shards = -(-count // SHARD)
        solved = checkpointed(_solve(open_items, shards, level + 1, capacity))
        last = shards == 1 or level == ROUNDS - 1
        done = solved if last else solved.where(F.col("slack") <= SLACK)
        placed = placed.unionByName(done.select("item", ((F.col("shard").cast("long") * (2 * SHARD * 4) + F.col("bin")) * 8 + level).alias("sequence_id"), F.col("at").alias("offset")))
        if last:
            break
        open_items = solved.where(F.col("slack") > SLACK).select("item", "size")
    return cut.join(placed, "item").drop("item")
