"""Sentence forms with typed slots, and phrases, each compiled to one automaton that reads a text once.

A form is a text of fixed words and slots, ``to the {what:text} of {n:number}``. Forms share their beginnings in a
trie whose edges are words or slot types; all places of the trie that a sentence can be at move on together
(a ``text`` slot stays at its place too), so that a sentence costs its tokens times the places, however the
forms would backtrack. The form with the most fixed words wins, then the first in order. Only its own slots
are then filled, each as short as a match allows, from left to right. Phrases are found by Aho-Corasick over the tokens.

The tables of forms and phrases are compiled on the driver and sent to the tasks; their size is checked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a table of forms or phrases that are compiled into one automaton.
MOST = 200_000
_SENTENCES = re.compile(r"[.!?]+[ \t\r\n]+|\n+")
_WORD = re.compile(r"\w+")
_ITEM = re.compile(r"\{(\w+):(\w+)\}|(\w+)")

#: Slot types of one token. ``text`` takes one token or more.
KINDS: dict[str, Callable[[str], bool]] = {
    "number": lambda w: w.isdigit(),
    "name": lambda w: w[0].isupper(),
    "word": lambda w: w[0].isalpha(),
}


def items_of(form: str) -> list[tuple[str, str | None]]:
    """The items of a form: (word, None) or (slot's name, type). Raises ValueError for an unknown type or an empty form."""
    found = [(m[3].lower(), None) if m[3] else (m[1], m[2]) for m in _ITEM.finditer(form)]
    unknown = {t for _, t in found if t and t not in KINDS and t != "text"}
    if unknown or not found:
        raise ValueError(f"{form!r}: " + (f"unknown slot types {sorted(unknown)}" if unknown else "no item"))
    return found


class Forms:
    """Forms as a trie. ``rows``: (order, form) with distinct orders."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.items = {order: items_of(form) for order, form in rows}
        self.words: list[dict[str, int]] = [{}]
        self.slots: list[dict[str, int]] = [{}]
        self.stays: list[bool] = [False]
        self.ends: list[list[int]] = [[]]
        for order, items in sorted(self.items.items()):
            at = 0
            for value, kind in items:
                edges = self.slots[at] if kind else self.words[at]
                to = edges.get(kind or value)
                if to is None:
                    to = edges[kind or value] = len(self.words)
                    self.words.append({})
                    self.slots.append({})
                    self.stays.append(kind == "text")
                    self.ends.append([])
                at = to
            self.ends[at].append(order)
        self.fixed = {order: sum(kind is None for _, kind in items) for order, items in self.items.items()}

    def best(self, tokens: list[str]) -> int | None:
        """The order of the best form that matches all tokens."""
        places = {0}
        for token in tokens:
            low, after = token.lower(), set()
            for p in places:
                if low in self.words[p]:
                    after.add(self.words[p][low])
                after.update(to for kind, to in self.slots[p].items() if kind == "text" or KINDS[kind](token))
                if self.stays[p]:
                    after.add(p)
            if not after:
                return None
            places = after
        found = [order for p in places for order in self.ends[p]]
        return min(found, key=lambda k: (-self.fixed[k], k)) if tokens and found else None

    def filled(self, order: int, tokens: list[str]) -> list[tuple[str, str]]:
        """(slot, text) of a form that matches: each slot as short as the rest allows."""
        items, n = self.items[order], len(tokens)
        reach = [[False] * (n + 1) for _ in range(len(items) + 1)]  # whether items from i on match tokens from j on
        reach[-1][n] = True
        for i in range(len(items) - 1, -1, -1):
            value, kind = items[i]
            for j in range(n - 1, -1, -1):
                fits = tokens[j].lower() == value if kind is None else kind == "text" or KINDS[kind](tokens[j])
                reach[i][j] = fits and (reach[i + 1][j + 1] or kind == "text" and reach[i][j + 1])
        out, j = [], 0
        for i, (value, kind) in enumerate(items):
            k = j + 1
            while kind == "text" and not reach[i + 1][k]:
                k += 1
            if kind:
                out.append((value, " ".join(tokens[j:k])))
            j = k
        return out


def _collected(table: DataFrame, *columns: str) -> list[tuple]:
    rows = [tuple(r) for r in table.select(*columns).limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows for one automaton: deal them out and run each part")
    return rows


def match_sentences(texts: DataFrame, key: str, text: str, forms: DataFrame) -> DataFrame:
    """key, sentence (from 0), form, slots (name to text) of each sentence that a form matches whole.

    ``forms``: form (an integer, the order), pattern. Sentences end at a full stop and a space or at a line's end.
    Null and empty texts have none.
    """
    trie = Forms(_collected(forms, "form", "pattern"))
    sent = texts.sparkSession.sparkContext.broadcast(trie)  # MOST forms at most
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                for k, sentence in enumerate(_SENTENCES.split(value.as_py() or "")):
                    tokens = _WORD.findall(sentence)
                    order = trie.best(tokens)
                    if order is not None:
                        rows.append((i, k, order, trie.filled(order, tokens)))
            at, k, order, slots = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(order, pa.int64()), pa.array(slots, pa.map_(pa.string(), pa.string()))], [key, "sentence", "form", "slots"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, sentence int, form long, slots map<string, string>")


def classify_phrases(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """key, class, rule, at: the first rule in order that a text holds, and at which token; null where it holds none.

    ``phrases``: rule (an integer, the order), phrase, class. A phrase is words; case does not count.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for rule, phrase, name in sorted(_collected(phrases, "rule", "phrase", "class"), reverse=True):
        words = " ".join(_WORD.findall(phrase.lower()))
        if words:
            automaton.add_word(f" {words} ", (rule, name, len(words)))  # a later, lower rule of the same words replaces the one before
    automaton.make_automaton()
    sent = texts.sparkSession.sparkContext.broadcast(automaton)  # MOST phrases at most
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in batches:
            found = []
            for value in batch.column(1):
                line = " " + " ".join(_WORD.findall((value.as_py() or "").lower())) + " "
                best = min(((rule, end - size, name) for end, (rule, name, size) in automaton.iter(line)), default=None) if len(automaton) else None
                found.append((None, None, None) if best is None else (best[2], best[0], line.count(" ", 0, best[1])))
            names, rules, at = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(rules, pa.int64()), pa.array([None if a is None else a - 1 for a in at], pa.int64())], [key, "class", "rule", "at"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, class string, rule long, at long")
