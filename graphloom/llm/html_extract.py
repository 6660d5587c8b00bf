"""Main text of web pages by differencing against the nearest page of the same host.

A page's html is read into text lines, one for each block. Within a host, pages are ordered by
path; the one with the longest common path prefix is next to a page in that order. The lines of
both are aligned by their longest common subsequence, on each page with a neighbour, and shared
lines are to be deleted. Pages of a host with the same lines throughout are one page there, at the
first of their paths: so the nearest page is always another one, and equal pages get equal texts.
Marks in the html then check the deletions: lines in menus, headers, footers, sidebars, notices,
adverts, forms and comments are never main text, and where a page marks its article, lines outside
are not, while those in it are, as pages quote and copy each other. There a deletion stands for an
element whose attributes leave it in doubt: it goes if all of its lines are shared, but most others
of the article are not. On a page without an article each deletion stands, unless the page would
lose all its lines: it is a copy of its neighbour and keeps them.

Outside an article the words of class, id and role attributes tell furniture. Within one, where
sections on any matter are text, they do so only if a whole token names an advert, sharing or reader
comments, or if at least half of the element's characters are in links; other elements with such
words are those in doubt. A dropped element within a line (a button in a sentence) does not break it.

Only hashes of lines and their marks travel to find shared ones; a page's text is read again where
it is written. The marks of equal lines that differ from page to page are held as a set.

Results for odd inputs: null and empty html give an empty text; pages without a host or alone on
it are only judged by their marks; unclosed tags end with the page; repeated rows are repeated in
the result; a null id is kept; an empty table gives no rows; other columns are ignored. The
longest page bounds a task's memory.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .neighbours import AFTER, BEFORE, ordered_with_edges
from .url_filter import host_and_path

#: Kinds of lines: never main text, unmarked, in a marked article.
FURNITURE, PLAIN, ARTICLE = 0, 1, 2
#: Bytes of the places of deleted lines up to which they are broadcast; beyond that pages that may lose lines are joined with them by a shuffle.
BROADCAST_BYTES = 32 << 20

# Names of elements by what they do, and words of class, id and role attributes.
_RAW = {"script", "style", "title", "noscript", "template", "iframe", "textarea", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FURNITURE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "header"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | {
    "math", "mi", "mn", "mo", "ms", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtext", "mspace", "semantics", "annotation", "svg", "g", "text", "tspan", "path", "object", "audio", "video", "canvas", "picture", "button",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS_OF_TEXT = {*_HEADINGS, "p", "blockquote", "pre", "li", "dt", "dd", "figure", "figcaption", "td", "th"}
#: Tokens that tell furniture within an article too.
_TOLD = {
    "ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsored", "promo", "share", "shares", "sharing", "share-buttons", "social", "social-share", "comments", "comment-list", "commentlist",
    "reader-comments", "disqus", "disqus_thread", "respond", "replies", "sidebar", "cookie-notice", "cookie-banner", "newsletter", "newsletter-signup", "breadcrumbs", "breadcrumb", "pagination", "navigation", "banner", "complementary", "contentinfo", "search", "dialog",
}
_ARTICLE = {"article", "main"}
_EMPTY = {"path", "use", "mspace", "g", "text", "svg", "canvas", "object"}
_PLAIN_ALWAYS = {"html", "body", *_ARTICLE}
_NAMED = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|adslot|banners?|cookies?|consent|gdpr|sidebars?|side|menus?|navbar|nav|navigation|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|discussion|disqus|replies|respond|social|share|shares|sharing|promos?|promoted|promotion|sponsor\w*|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|related|recommend\w*|widgets?|notices?|alerts?|toolbar|pager|pagination|skip|hidden|search|complementary|contentinfo|dialog)(?:$|[^a-z])"
)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<!--(.*?)(?:-->|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)


@dataclass
class _Open:
    """An open element: the furniture and article depth around it, the line that it interrupts, and what it may turn out to be."""

    name: str
    off: int
    article: int
    line: list[str] | None = None
    lines: int | None = None
    chars: int = 0
    linked: int = 0


def _marked(name: str, attributes: str, article: int) -> tuple[bool, bool]:
    """Whether attributes tell that an element is furniture, and whether it may be by its share of links."""
    if not attributes or name in _PLAIN_ALWAYS:
        return False, False
    low = attributes.lower()
    if _HIDDEN.search(low):
        return True, False
    values = [a or b or c for a, b, c in _NAMES.findall(low)]
    named = any(_NAMED.search(v) for v in values)
    if not article or not named:
        return named, False
    told = name not in _HEADINGS and any(token in _TOLD for v in values for token in v.split())
    return told, not told and name not in _BLOCKS_OF_TEXT and name not in _INLINE


def marked_lines(page: str | None) -> list[tuple[str, int, int]]:
    """(text, kind, element in doubt) of each block with text, in page order; elements in doubt are numbered from 1, 0 is none."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    stack: list[_Open] = []
    off = article = links = chars = linked = doubts = 0
    page = page or ""
    at, n = 0, len(page)

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, FURNITURE if off else ARTICLE if article else PLAIN, 0))

    def leave(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal held, off, article, links, doubts
        for e in reversed(stack[k:]):
            if e.line is None and (off != e.off or article != e.article) or e.lines is not None:
                close()
            if e.line is not None:  # the dropped element's own text is a line of its own, the one around it goes on
                close()
                held = e.line
            if e.lines is not None and 2 * (linked - e.linked) >= chars - e.chars:
                out[e.lines :] = [(text, FURNITURE, 0) for text, _, _ in out[e.lines :]]
            elif e.lines is not None:  # inner elements are closed first and keep their numbers
                doubts += 1
                out[e.lines :] = [(text, kind, doubt or doubts * (kind == ARTICLE)) for text, kind, doubt in out[e.lines :]]
            off, article = e.off, e.article
            links -= e.name == "a"
        del stack[k:]

    def text(part: str) -> None:
        nonlocal chars, linked
        held.append(part)
        size = len(part) - part.count(" ")
        chars += size
        linked += size if links else 0

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        ending, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            close()
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    leave(k)
                    break
            continue
        if name in _RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in _VOID or attributes.endswith("/") and name not in _PLAIN_ALWAYS and name in _EMPTY:
            continue
        drops, may = (True, False) if name in _FURNITURE and not (name == "header" and article) else _marked(name, attributes, article)
        e = _Open(name, off, article)
        if drops and not off and name in _INLINE:
            e.line, held = held, []
        elif drops or may:
            close()
        if may and not off:
            e.lines, e.chars, e.linked = len(out), chars, linked
        stack.append(e)
        links += name == "a"
        off += drops
        if name in _ARTICLE:
            close()
            article += 1
    leave(0)
    close()
    return out


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block with text, in page order."""
    return [(text, kind) for text, kind, _ in marked_lines(page)]


def common_subsequence(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of two lists of hashable items."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    found = list(range(head))
    masks: dict = {}
    for j, item in enumerate(x):
        masks[item] = masks.get(item, 0) | 1 << j
    full, rows = (1 << len(x)) - 1, []
    s = full
    for item in y:
        u = s & masks.get(item, 0)
        s = (s + u | s - u) & full
        rows.append(s)
    middle, row, col = [], len(rows), len(x)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not (row and not rows[row - 1] >> (col - 1) & 1):
                col -= 1
                middle.append(head + col)
    return found + middle[::-1] + list(range(len(a) - tail, len(a)))


def deleted(marks: np.ndarray, shared: list[int]) -> list[int]:
    """Places of the lines that a page loses, given those that it shares with its nearest page: the deletions that its marks let stand."""
    kinds, doubts = marks.T
    at = np.zeros(len(marks), bool)
    at[shared] = True
    if not (kinds == ARTICLE).any():
        lost = (kinds == PLAIN) & at
        return np.flatnonzero(lost).tolist() if ((kinds == PLAIN) & ~at).any() else []
    lost = (doubts > 0) & ~np.isin(doubts, doubts[~at])
    rest = (kinds == ARTICLE) & ~lost
    return np.flatnonzero(lost).tolist() if 2 * (at & rest).sum() < rest.sum() else []


def _marks(lines: list[tuple[str, int, int]]) -> np.ndarray:
    """Kind and element in doubt of each line."""
    return np.array([mark for _, *mark in lines], np.int32).reshape(-1, 2)


def _may_lose(marks: np.ndarray) -> bool:
    """Whether ``deleted`` can name any line."""
    return bool((marks[:, 1] > 0).any()) or not (marks[:, 0] == ARTICLE).any()


def _keys(lines: list[tuple[str, int, int]]) -> np.ndarray:
    """A hash of each line's text."""
    return np.array([xxhash.xxh64_intdigest(text) for text, _, _ in lines], np.uint64).view(np.int64)


def _digest(keys: np.ndarray, marks: np.ndarray | None = None) -> int:
    """A hash of a page's lines, with their marks if given."""
    return int(np.array([xxhash.xxh64_intdigest(keys.tobytes() + (b"" if marks is None else marks.tobytes()), 1)], np.uint64).view(np.int64)[0])


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line hashes and marks of pages, no texts."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            found = [marked_lines(x.as_py()) for x in part["html"]]
            keys = [_keys(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in ("host", "path", "at")), pa.array([_digest(k) for k in keys], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([_marks(f).tobytes() for f in found], pa.binary())],
                ["host", "path", "at", "digest", "keys", "marks"],
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each own page of a sorted partition, aligned with its nearest page, and each set of marks on its lines: the places of those that it loses, if any."""
    before: dict | None = None
    row: dict | None = None
    out: list[dict] = []
    schema = pa.schema([("host", pa.string()), ("digest", pa.int64()), ("lost", pa.list_(pa.int32()))])

    def found(row: dict, after: dict | None) -> None:
        best, length = None, -1
        for other in (before, after):
            if other and other["host"] == row["host"]:
                common = len(os.path.commonprefix([row["path"], other["path"]]))
                if common > length:
                    best, length = other, common
        if not best:
            return
        shared, keys = common_subsequence(row["keys"], best["keys"]), np.array(row["keys"], np.int64)
        for x in row["marks"]:
            marks = np.frombuffer(x, np.int32).reshape(-1, 2)
            if lost := deleted(marks, shared):
                out.append({"host": row["host"], "digest": _digest(keys, marks), "lost": lost})

    for batch in batches:
        for r in batch.to_pylist():
            if r["role"] == BEFORE:
                before = r
                continue
            if row is not None and row["role"] == AFTER:
                break
            if row is not None:
                found(row, r)
                before = row
            row = r
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    if row is not None and row["role"] != AFTER:
        found(row, None)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of pages, null where the marks say that they are no text; no digest to look up for pages that can lose none."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            found = [marked_lines(x.as_py()) for x in part["html"]]
            digests, texts = [], []
            for f in found:
                marks = _marks(f)
                digests.append(_digest(_keys(f), marks) if _may_lose(marks) else None)
                kept = ARTICLE if (marks[:, 0] == ARTICLE).any() else PLAIN
                texts.append([text if kind == kept else None for text, kind, _ in f])
            yield pa.RecordBatch.from_arrays([*(part[c] for c in ("page_id", "url", "host")), pa.array(digests, pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["page_id", "url", "host", "digest", "texts"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("at"), "html")
    outlines = rows.where("host <> ''").select("host", "path", "at", "html").mapInArrow(_outlined, "host string, path string, at long, digest long, keys array<long>, marks binary")
    one = outlines.groupBy("host", "digest").agg(F.min(F.struct("path", "at")).alias("p"), F.first("keys").alias("keys"), F.collect_set("marks").alias("marks"))
    one = checkpointed(one.select("host", "p.path", "p.at", "digest", "keys", "marks"))
    laid = ordered_with_edges(one, ["host", "path", "at"], ["digest"])
    lost = checkpointed(laid.select("host", "path", "keys", "marks", "role").mapInArrow(_shared, "host string, digest long, lost array<int>").select(F.col("host").alias("h"), F.col("digest").alias("d"), "lost"))
    size = lost.agg(F.coalesce(F.sum(F.size("lost") * 4 + F.length("h") + 32), F.lit(0))).first()[0]
    read = rows.select("page_id", "url", "host", "html").mapInArrow(_read, "page_id long, url string, host string, digest long, texts array<string>")
    at = F.when(F.col("digest").isNull(), F.concat(F.lit(" "), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("host"))  # pages that lose none find none: no task gets them all
    joined = read.withColumn("host", at).join(F.broadcast(lost) if size <= BROADCAST_BYTES else lost, (F.col("host") == F.col("h")) & (F.col("digest") == F.col("d")), "left")
    kept = F.when(F.col("lost").isNull(), F.col("texts")).otherwise(F.transform("texts", lambda text, k: F.when(~F.array_contains("lost", k), text)))
    return joined.select("page_id", "url", F.array_join(kept, "\n").alias("text"))
