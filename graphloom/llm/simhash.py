"""SimHash near-duplicates by anchor-point covering.

A fingerprint takes 64 bits from the XXH64 hashes (seed 42) of its text's word shingles: a bit is
1 if it is set in over half of them. Two fingerprints link if at most three bits differ. The
positions are dealt into two segments of 31 bits (bits 31 and 63 belong to none), so that two
linked fingerprints differ in at most one bit of one segment. In each segment the codewords of
the perfect [31, 26] Hamming code, which has covering radius 1, are the anchors. A fingerprint is
at home at its nearest anchor and is replicated to every anchor within radius plus threshold
(1 + 1); residents and visitors of an anchor are compared. An anchor with many of both is split
into cells of bounded size, each of which returns a spanning forest of its links instead of all
pairs. Only distinct fingerprints take part, so exact copies cost one row.

Results for odd inputs: null and empty texts have fingerprint zero and link like any other; texts
of fewer words than a shingle have one shingle; a null id never names a component unless all its
ids are null; repeated rows share a component; an empty table gives no rows; other columns are
ignored. The longest text bounds a task's memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_text, unpacked, whole

SEED = 42
#: Differing bits of a link. Up to 3, a resident meets all visitors. For 4 and 5, a segment has at
#: most 2 of them; the word halfway between is within 1 of both, so its anchor is within 2 of both
#: and the visitors of an anchor meet one another.
THRESHOLD, MOST = 3, 5
#: An anchor with more pairs of residents and visitors than this is compared in cells.
PAIRS_AT_ANCHOR = 1 << 14
#: Residents, and visitors, of a cell.
CELL = 1024

#: Ids of documents that may go up to which they are broadcast (9 bytes each).
BROADCAST_IDS = 2_000_000

_SEGMENT = (1 << 31) - 1
#: Bits of a segment whose position, counted from 1, has bit k set: the parity checks of the code.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]


def fingerprint_of(text: str | None, shingle: int) -> int:
    """Fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    set_in = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, keep: list[str | Column] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``) and fp, the fingerprint as a signed long, of each document; no shuffle."""

    def of(text: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint_of(t.as_py(), shingle) for t in text], np.uint64).view(np.int64), pa.int64())]

    return map_text(docs, keep or [F.col("doc_id").cast("long").alias("doc_id")], "fp long", of)


def _residents(fps: DataFrame) -> DataFrame:
    """fp, seg, word (the segment's bits), syndrome and home anchor of each segment of each fingerprint."""
    words = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(F.lit(_SEGMENT)).alias("word")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(_SEGMENT)).alias("word")))).alias("s")).select("fp", "s.*")
    parity = " + ".join(f"(bit_count(word & {mask}L) & 1) * {1 << k}" for k, mask in enumerate(_CHECKS))
    words = words.withColumn("syndrome", F.expr(f"cast({parity} as int)"))
    return words.withColumn("anchor", F.expr("if(syndrome = 0, word, word ^ shiftleft(1L, syndrome - 1))"))


def _visitors(residents: DataFrame) -> DataFrame:
    """Each fingerprint at every anchor within distance 2 of its segment: its home and the pairs of flips that its syndrome allows."""
    flips = F.expr("explode(filter(sequence(0, 31), i -> i = 0 or i < (i ^ syndrome)))")
    return residents.select("fp", "seg", "word", "syndrome", F.col("anchor").alias("home"), flips.alias("i")).select("fp", "seg", F.expr("if(i = 0, home, word ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ syndrome) - 1))").alias("anchor"))


def _cell_links(cell: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """A spanning forest of the links between residents and visitors of one cell."""
    fp, guest = cell["fp"].to_numpy().view(np.uint64), cell["guest"].to_numpy()
    h, g = fp[~guest], fp[guest]
    near = np.bitwise_count(h[:, None] ^ g[None, :]) <= threshold
    hl, gl = np.arange(len(h)), np.full(len(g), len(h))
    while True:  # the least resident reachable, spread over the links
        new_g = np.where(near, hl[:, None], len(h)).min(axis=0, initial=len(h))
        new_h = np.minimum(hl, np.where(near, new_g[None, :], len(h)).min(axis=1, initial=len(h)))
        if (new_h == hl).all() and (new_g == gl).all():
            break
        hl, gl = new_h, new_g
    if not len(h):
        return pd.DataFrame({"a": h.view(np.int64), "b": h.view(np.int64)})
    mine, other = np.concatenate([h[hl], h[np.minimum(gl, len(h) - 1)]]), np.concatenate([h, g])
    real = np.concatenate([np.ones(len(h), bool), gl < len(h)]) & (mine != other)
    return pd.DataFrame({"a": mine[real].view(np.int64), "b": other[real].view(np.int64)})


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links a < b between distinct fingerprints of the column fp that hold all of them together.

    Every pair of at most ``threshold`` differing bits is joined by a path of links.
    """
    if not 0 <= threshold <= MOST:
        raise ValueError(f"threshold must be 0 to {MOST}")
    residents = _residents(fps)
    visitors = _visitors(residents)
    at = ["seg", "anchor"]
    homes = residents.select("fp", *at) if threshold <= 3 else visitors
    sizes = homes.groupBy(*at).agg(F.count("*").alias("n_home"))
    crowds = sizes.where(f"n_home > {int(PAIRS_AT_ANCHOR ** 0.5) // 16}").join(visitors.groupBy(*at).agg(F.count("*").alias("n_guest")), at).where(f"n_home * n_guest > {PAIRS_AT_ANCHOR}")
    crowds = checkpointed(crowds)
    guests = visitors
    if crowds.isEmpty():
        calm, cells = homes, None
    else:
        split = crowds.select(*at, F.expr(f"cast(ceil(n_home / {CELL}) as int)").alias("rows"), F.expr(f"cast(ceil(n_guest / {CELL}) as int)").alias("cols"))
        calm = homes.join(crowds.select(*at), at, "left_anti")
        a = homes.join(split, at).select(*at, "fp", F.expr("cast(pmod(xxhash64(fp), rows) as int)").alias("r"), F.explode(F.expr("sequence(0, cols - 1)")).alias("c"), F.lit(False).alias("guest"))
        b = guests.join(split, at).select(*at, "fp", F.explode(F.expr("sequence(0, rows - 1)")).alias("r"), F.expr("cast(pmod(xxhash64(fp, 1), cols) as int)").alias("c"), F.lit(True).alias("guest"))
        cells = a.unionByName(b).groupBy(*at, "r", "c").applyInPandas(lambda cell: _cell_links(cell, threshold), "a long, b long")
    h, g = calm.alias("h"), guests.alias("g")
    near = (F.col("h.seg") == F.col("g.seg")) & (F.col("h.anchor") == F.col("g.anchor")) & (F.col("h.fp") != F.col("g.fp")) & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("g.fp"))) <= threshold)
    found = h.join(g, near).select(F.col("h.fp").alias("a"), F.col("g.fp").alias("b"))
    if cells is not None:
        found = found.unionByName(cells)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node of the edges a < b.

    Alternating large-star and small-star contraction: a number of rounds that grows with the
    logarithm of the longest path, each with a checkpoint.
    """
    edges = checkpointed(edges)
    size = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    while size["n"]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small, "b").select("a", "b", "m").select(F.explode(F.expr("array(struct(m as a, a as b), struct(m as a, b as b))")).alias("e")).select("e.*").where("a <> b").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == size:
            break
        size = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of each document."""
    fps = checkpointed(fingerprints(docs, shingle))
    firsts = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(firsts.select("fp"), threshold))
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(heads, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, threshold: int = MOST) -> DataFrame:
    """The columns of docs, one row for each component: that of its least id.

    With five-word shingles, five bits are the distance expected at a Jaccard similarity of about
    0.95; below 0.8 a pair seldom links. Rows of equal id and text count as one; of rows with equal
    ids and other texts each is judged by its own component. A row without an id cannot be named
    and stays. Extra columns pass, whatever their names.

    Ids travel, not texts: those of rows that may go are broadcast, up to BROADCAST_IDS of them;
    beyond that the texts are joined with them by a shuffle.
    """
    own = F.col("doc.doc_id").cast("long")
    found = checkpointed(near_duplicates(docs, shingle, threshold).where(F.col("doc_id").isNotNull()))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("component_id").alias("most"), F.min("component_id").alias("least"))
    ids = checkpointed(ids.where("n > 1 or least <> doc_id").select(F.col("doc_id").alias("id"), (F.col("n") > 1).alias("again")))
    sizes = {r["again"]: r["count"] for r in ids.groupBy("again").count().collect()}
    marked = F.broadcast(ids) if sum(sizes.values()) <= BROADCAST_IDS else ids
    rows = docs.select(whole(docs))
    kept = rows.join(marked, own == F.col("id"), "left_anti")
    if sizes.get(True):
        # Repeated ids are few, or the same row again: their fingerprints say which component a row is in.
        repeated = rows.join(marked.where("again"), own == F.col("id"), "left_semi")
        judged = fingerprints(repeated.select("doc", F.col("doc.text").alias("text")), shingle, ["doc"])
        heads = found.where("doc_id = component_id").select(F.col("doc_id").alias("id"), F.col("fp").alias("head")).distinct()
        stays = judged.join(heads, (own == F.col("id")) & (F.col("fp") == F.col("head")), "left_semi")
        kept = kept.unionByName(stays.withColumn("id", F.col("doc.doc_id")).withColumn("text", F.col("doc.text")).dropDuplicates(["id", "text"]).select("doc"))
    return unpacked(kept, docs.columns)
