"""Byte-level BPE over whole batches, each distinct pre-token encoded once.

Pre-token borders follow the tokenizer's own pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
and are found by numpy on code points. BPE never crosses them, so that the ids of a text are the
ids of its pre-tokens in turn; those are the ones that the ``tokenizers`` library gives, and are
remembered.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import regex
import tiktoken

from .textvec import mix, prefix_hash

#: Pre-tokens remembered by a Python worker before it forgets them all: about 50 bytes each.
REMEMBERED = 300_000
#: Sorted runs of remembered hashes before they are merged into one.
_RUNS = 6
#: Pre-tokens that are joined into one text for the library.
_JOINED = 2000

_LETTER, _NUMBER, _SPACE = 1, 2, 3


def _kinds() -> np.ndarray:
    """Class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kind = np.zeros(0x110000, np.uint8)
    for k, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            kind[[ord(c) for c in every[a:b]]] = k
    kind[0x1C:0x20] = 0  # Python's own white space that the pattern does not know
    return kind


_KIND: np.ndarray | None = None


def borders(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens begin. ``first``: where documents begin."""
    global _KIND
    if _KIND is None:
        _KIND = _kinds()
    n = len(codes)
    kind = _KIND[codes]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (codes[:-1] == 32) & ~head[1:n]
    start = run & (space | ~after_blank)
    start[:-1] |= space[:-1] & ~space[1:] & ~head[1:n]
    quote = np.flatnonzero((codes == 39) & run & ~after_blank)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~head[quote + 1]]
    if len(quote):
        c1 = codes[quote + 1]
        room = quote + 2 < n
        c2 = np.where(room & ~head[np.minimum(quote + 2, n)], codes[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(c1, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            long |= (c1 == ord(pair[0])) & (c2 == ord(pair[1]))
        for which, width in ((short, 2), (long, 3)):
            at = quote[which]
            start[at + 1] = False
            after = at + width
            after = after[after < n]
            start[after[(kind[after] == _LETTER)]] = True
    return np.flatnonzero(start)


def _merger(path: str, names: list[str], special: list[str]):
    """A merger of the file's tokens by their ids, or None where its merges are not in the order of the ids.

    Where they are, taking the pair with the least id is taking the first merge of the list, so
    that ``tiktoken`` gives the ids of ``tokenizers``, a few times faster. The pattern only parts a run.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    if made != sorted(set(made)) or made and made[0] < 256:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in t): k for k, t in enumerate(names) if t and t not in special}
    return tiktoken.Encoding("pieces", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts by one tokenizer file, with a bounded memory of pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.width = np.array([len(t) for t in names], np.int64)  # a character of a token's name stands for one byte
        self.merger = _merger(path, names, self.special)
        self._forget()

    def _forget(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # sorted hashes and their numbers
        self.known = 0
        self.at = np.zeros(1024, np.int32)
        self.count = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes, -1 for those not remembered."""
        place = np.full(len(hashes), -1, np.int64)
        for keys, numbers in self.runs:
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[at] == hashes
            place[hit] = numbers[at[hit]]
        return place

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in turn, number of ids of each).

        Pre-tokens without a line feed are merged in runs, a line feed between them; the bytes that
        the ids stand for show where each ends. The others, and all where the file's merges don't
        follow its ids, go to the ``tokenizers`` library one by one.
        """
        plain = ["\n" not in w for w in words] if self.merger else [False] * len(words)
        counts, found = np.zeros(len(words), np.int32), []
        at = [k for k, p in enumerate(plain) if p]
        for run in (at[i : i + _JOINED] for i in range(0, len(at), _JOINED)):
            own = [words[k] for k in run]
            ids = np.array(self.merger.encode_ordinary("\n".join(own)), np.uint32)
            stops = np.cumsum(np.fromiter((len(w.encode()) for w in own), np.int64, len(own)))
            last = np.searchsorted(np.cumsum(self.width[ids]), stops)
            counts[run] = np.diff(last, prepend=-1)
            found.append((run, ids))
        alone = [k for k, p in enumerate(plain) if not p]
        single = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[k] for k in alone], add_special_tokens=False)]
        counts[alone] = [len(x) for x in single]
        if alone:
            found.append((alone, np.concatenate(single)))
        begin = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for run, ids in found:
            n = counts[run]
            flat[np.repeat(begin[run] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode and remember pre-tokens, given with their sorted hashes."""
        flat, counts = self._ids_of(words)
        k = self.known
        while len(self.at) < k + len(words):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.count[k : k + len(words)] = counts
        self.at[k : k + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.known += len(words)
        self.runs.append((hashes, np.arange(k, self.known, dtype=np.int32)))
        if len(self.runs) > _RUNS:
            keys, numbers = (np.concatenate(x) for x in zip(*self.runs, strict=True))
            order = np.argsort(keys, kind="stable")
            self.runs = [(keys[order], numbers[order])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each), as the library gives them by default.

        Texts that hold the string of a special token go to the library whole.
        """
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:
            ids, counts = self.encode(["" if k in odd else t for k, t in enumerate(texts)])
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in odd:
                parts[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.array([len(p) for p in parts])
        if self.known > REMEMBERED:
            self._forget()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.cumsum(sizes)
        first = (ends - sizes)[sizes > 0]
        starts = borders(codes, first)
        stops = np.append(starts[1:], len(codes))
        sums = prefix_hash(codes)
        from .textvec import _power_tables

        hashes = mix((sums[stops] - sums[starts]) * _power_tables(len(sums))[1][starts])
        codes_of, unique = pd.factorize(hashes)
        order = np.argsort(unique)
        found = self._find(unique[order])
        new = np.flatnonzero(found < 0)
        if len(new):
            where = np.zeros(len(unique), np.int64)
            where[codes_of[::-1]] = np.arange(len(codes_of) - 1, -1, -1)
            whole = "".join(texts)
            spots = where[order[new]]
            found[new] = self.known + np.arange(len(new))
            self._learn(unique[order[new]], [whole[a:b] for a, b in zip(starts[spots].tolist(), stops[spots].tolist(), strict=True)])
        place = np.empty(len(unique), np.int64)
        place[order] = found
        piece = place[codes_of]
        counts = self.count[piece].astype(np.int64)
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(self.at[piece] - (total - counts), counts) + np.arange(total[-1])]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return ids, np.diff(upto)
