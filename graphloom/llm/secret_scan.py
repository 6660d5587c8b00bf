"""Secret scan by patterns and by assignments.

Patterns give the spans of three kinds: ``assign`` (a telling word, a separator and a value of 8 characters or
more), ``access`` (access key ids) and ``hex`` (32 hexadecimal digits or more), each kind leftmost and without
overlaps. To these the method adds spans of kind ``literal``: the text is cut into tokens of source and
configuration languages, bindings of a name to an expression are read off them (``name = expr``, ``name: expr``,
``"name": expr``, ``set("name", expr)``, ``--name value``, ``<name>value</name>``, ``scheme://user:value@host``), and
constants are propagated: an expression's value is put together from its literals, from the names in it and from
``${name}`` in its strings. A literal that reaches a name is scored by the name (which words it is made of, and which
of them comes last) times how much its whole value looks like a secret; at LEAST_SCORE it is one. Its span is that of
the literal's own text, wherever it stands, unless another span holds it already.

Results for odd inputs: a null or empty text has no spans; positions are code points, the end exclusive; a name
without a binding has no value; names that lead to each other add nothing more; the binding that counts is the last
one before the use, or the first after it; equal texts get equal results; repeated rows are repeated; an empty
table gives no rows; other columns are kept if asked for. The longest text bounds a task's memory.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

# Kinds in the order of spans that start together, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Least product of a name's and a value's score.
LEAST_SCORE = 0.45
#: Least characters of a whole value.
VALUE_LEAST = 6
#: How much a word of a name says that its value is a secret.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "pass": 0.9, "secret": 1.0, "secrets": 1.0, "credential": 0.9, "credentials": 0.9,
    "token": 0.9, "apikey": 1.0, "authkey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 0.9, "bearer": 0.9, "signature": 0.7, "authorization": 0.8, "auth": 0.6,
    "key": 0.4, "salt": 0.6, "pin": 0.6, "cookie": 0.5, "session": 0.4, "dsn": 0.5, "cert": 0.4,
}
#: Words that make a following ``key`` one.
KEY_WORDS = {"api", "access", "private", "secret", "encryption", "signing", "auth", "master", "account", "storage", "ssh", "hmac", "aes", "jwt", "service", "client", "deploy"}
#: Last words that say that the value is about a secret and is none.
ABOUT = {
    "id", "name", "names", "file", "path", "dir", "url", "uri", "type", "length", "len", "size", "count", "field", "label", "hint", "prompt", "policy", "regex", "pattern", "min", "max",
    "expiry", "expires", "ttl", "env", "var", "header", "prefix", "title", "message", "help", "placeholder", "error", "format", "version", "algorithm", "public", "reset", "required", "enabled",
}
_PLACEHOLDER = re.compile(r"(?i)^(?:(?:change.?me|place.?holder|example|sample|dummy|redacted|todo|none|null|true|false|undefined|default|secret|password|passwd|token)[\W\d_]{0,4}|(?:your|insert)[-_ ].*|.*[-_ ](?:example|placeholder|here|redacted)|<.*>|\{\{.*\}\}|(.)\1+)$")

#: Texts without a match hold no span. The second part asks for a telling word in a name that something is bound to.
_BASE_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
_NAME_HINT = r"""(?i:pass|pwd|secret|cred|token|key|bearer|signature|auth|salt|pin|cookie|session|dsn|cert)[\w.\-]*["'\]) ]*(?:[:=,>(]|\s+=)|--[\w\-]*(?i:pass|pwd|secret|token|key|auth)[\w\-]* |://[^\s/@:]*:[^\s/@]+@"""

_TOKEN = re.compile(
    r'''(?P<string>(?<![\w'"])[fFbBrRuU]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\')|(?:\b[fFbBrRuU]{1,2})?"(?:[^"\\\n]|\\.)*"|(?:\b[fFbBrRuU]{1,2}|(?<!\w))'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)'''
    r"""|(?P<name>[A-Za-z_$@%][\w$]*(?:(?:\.|->|::|-)[A-Za-z_]\w*)*)|(?P<op>:=|=>|===|==|!=|<=|>=|\+=|\|\||[-+=:,;(){}\[\]<>&.|*/])|(?P<line>\n)|(?P<other>[^\s\w"'`]|\w+|["'`])""",
    re.DOTALL,
)
_PARTS = re.compile(r"\$\{(?P<a>[A-Za-z_][\w.]*)(?::?-[^}]*)?\}|\$(?P<b>[A-Za-z_]\w*)|%\((?P<c>\w+)\)s|\{(?P<d>[A-Za-z_][\w.]*)\}|\{\{\s*(?P<e>[A-Za-z_][\w.]*)\s*\}\}")
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>#]+")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*)>\s*(?P<value>[^<>\s]+)\s*</(?P=name)>")
_USERINFO = re.compile(r"[a-z][a-z0-9+.-]*://[^\s/@:\"'<>]*:(?P<value>[^\s/@\"'<>]+)@")
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_]\w*)*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Tokens of a call or bracket that are looked at, and literals that a value is put together from.
_CALL_TOKENS, _PARTS_MOST = 200, 200
_ASSIGNS, _JOINS = {"=", ":=", "=>", ":", "==", "===", "!=", "+="}, {"+", ".", "&", "||"}
_LEADS = {"export", "set", "env", "const", "let", "var", "val", "final", "static", "public", "private", "string", "declare", "local", "define"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern kinds."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def name_score(name: str) -> float:
    """How much a name says that its value is a secret, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT or "public" in words:
        return 0.0
    best = max(NAME_WORDS.get(w, 0.0) for w in words)
    if any(b == "key" and a in KEY_WORDS for a, b in zip(words, words[1:], strict=False)):
        best = max(best, 0.9)
    if "".join(words) in NAME_WORDS:
        best = max(best, NAME_WORDS["".join(words)])
    return best if words[-1].isdigit() or NAME_WORDS.get(words[-1], 0) or best < 0.9 else 0.8 * best


def value_score(value: str) -> float:
    """How much a value looks like a secret, 0 to 1: by length, kinds of characters and their entropy."""
    if len(value) < VALUE_LEAST or _PLACEHOLDER.search(value):
        return 0.0
    if any(c.isspace() for c in value):
        return 0.3
    if value.startswith(("/", "./", "~/", "http://", "https://")) or re.fullmatch(r"[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|json|ya?ml|txt|pem|key|py|js|java|xml|cfg|conf)", value):
        return 0.2
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.3 + 0.1 * kinds + 0.1 * entropy + (0.1 if len(value) >= 16 else 0.0))


@dataclass
class _Literal:
    """A literal's text and where it stands."""

    value: str
    start: int
    end: int


@dataclass
class _Ref:
    """A name in an expression, and the literal that it is if nothing is bound to it."""

    name: str
    literal: _Literal | None = None


@dataclass
class _Bound:
    """A name and the parts of the expression that it is bound to at a place of the text."""

    name: str
    at: int
    parts: list[_Literal | _Ref]


@dataclass
class _Reader:
    """Reads the bindings off a text's tokens."""

    text: str
    tokens: list[tuple[str, int, int]] = field(default_factory=list)
    bound: list[_Bound] = field(default_factory=list)

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else "line"

    def string(self, i: int) -> tuple[int, int]:
        """Start and end of a string token's own text."""
        _, start, end = self.tokens[i]
        while self.text[start] not in "\"'`":
            start += 1
        width = 3 if self.text[start : start + 3] in ('"""', "'''") and end - start >= 6 else 1
        return start + width, end - width

    def parts(self, start: int, end: int) -> list[_Literal | _Ref]:
        """A string's text as literals and the names between them."""
        found, at = [], start
        for m in _PARTS.finditer(self.text, start, end):
            if m.start() > at:
                found.append(_Literal(self.text[at : m.start()], at, m.start()))
            found.append(_Ref(m[m.lastgroup]))
            at = m.end()
        return [*found, _Literal(self.text[at:end], at, end)] if end > at else found

    def expression(self, i: int, depth: int = 0) -> tuple[list[_Literal | _Ref], int]:
        """The parts of the expression at token i, and the token after it. Calls and brackets give the parts within."""
        found: list[_Literal | _Ref] = []
        while i < len(self.tokens):
            kind, word = self.kind(i), self.word(i)
            if kind == "string":
                found += self.parts(*self.string(i))
                i += 1
            elif depth < 20 and (word == "(" or kind == "name" and self.word(i + 1) == "("):
                i += 1 + (kind == "name")
                last = i + _CALL_TOKENS
                while i < min(last, len(self.tokens)) and self.word(i) != ")":
                    inner, to = self.expression(i, depth + 1)
                    found += inner
                    i = max(to, i + 1)
                i += 1
            elif kind == "name":
                found.append(_Ref(_plain(word)))
                i += 1
            else:
                return found, i
            joined = i
            while self.word(joined) in _JOINS or self.kind(joined) == "line" and self.word(joined + 1) in {"+", "||"}:
                joined += 1
            if joined > i:
                i = joined + (self.kind(joined) == "line")
            elif self.kind(i) != "string":
                return found, i
        return found, i

    def at_line_start(self, i: int) -> bool:
        """Whether only list marks, brackets and words like ``export`` stand before token i on its line."""
        while i and self.kind(i - 1) != "line":
            i -= 1
            if not (self.kind(i) == "op" and self.word(i) in "-{,<" or self.word(i) in {"#", "/"} or self.word(i).lower() in _LEADS):
                return False
        return True

    def read(self) -> list[_Bound]:
        """All bindings, in the text's order."""
        self.tokens = [(m.lastgroup, *m.span()) for m in _TOKEN.finditer(self.text)]
        for i in range(len(self.tokens)):
            kind = self.kind(i)
            if kind not in ("name", "string"):
                continue
            if kind == "name":
                name = _plain(self.word(i))
            else:
                start, end = self.string(i)
                if end - start > 80:
                    continue
                name = self.text[start:end]
            at, j = self.tokens[i][1], i + 1
            if kind == "string" and self.word(j) == "," and i > 1 and self.word(i - 1) == "(" and self.kind(i - 2) == "name":
                self.add(name, at, self.expression(j + 1)[0])
                continue
            if kind == "string" and self.word(j) == "]":
                j += 1
            if self.word(j) == ":" and self.kind(j + 1) == "name" and self.word(j + 2) == "=":
                j += 2
            op = self.word(j)
            if kind == "name" and op not in _ASSIGNS and i > 1 and self.word(i - 1) == "-" and self.word(i - 2) == "-" and self.kind(j) != "line":
                self.bare(name, at, self.tokens[i][2])
            if op not in _ASSIGNS:
                continue
            parts, _ = self.expression(j + 1)
            quoted = any(isinstance(p, _Literal) for p in parts)
            if not quoted and len(parts) < 2 and op in ("=", ":") and kind == "name" and (self.at_line_start(i) or i and self.word(i - 1) == "-"):
                self.bare(name, at, self.tokens[j][2])
            else:
                self.add(name, at, parts)
        for m in _ELEMENT.finditer(self.text):
            self.add(m["name"], m.start(), self.parts(*m.span("value")))
        for m in _USERINFO.finditer(self.text):
            self.add("password", m.start(), self.parts(*m.span("value")))
        return sorted(self.bound, key=lambda b: b.at)

    def bare(self, name: str, at: int, after: int) -> None:
        """A value without quotes, up to the next space or separator; a lone name may be another's."""
        while self.text[after : after + 1] in (" ", "\t"):
            after += 1
        m = _BARE.match(self.text, after)
        if m and _NAME.fullmatch(m[0]):
            code = self.text[after - 3 : after] == " = " and not any(c.isdigit() for c in m[0])
            self.bound.append(_Bound(name, at, [_Ref(_plain(m[0]), None if code else _Literal(m[0], *m.span()))]))
        elif m:
            self.add(name, at, self.parts(*m.span()))

    def add(self, name: str, at: int, parts: list[_Literal | _Ref]) -> None:
        if parts:
            self.bound.append(_Bound(name, at, parts))


def _plain(name: str) -> str:
    """A name without the sigils and owners that differ between its uses."""
    return re.sub(r"^(?:[$@%]+|self\.|this\.|this->|self->|-+)+", "", name)


def _resolved(bound: list[_Bound]) -> list[list[_Literal]]:
    """The literals of each binding after names are replaced by what they are bound to."""
    where: dict[str, list[int]] = defaultdict(list)
    for k, b in enumerate(bound):
        where[b.name].append(k)
    places = {name: [bound[k].at for k in ks] for name, ks in where.items()}
    done: dict[int, list[_Literal]] = {}

    def literals(k: int, depth: int = 0) -> list[_Literal]:
        if k not in done:
            done[k], found = [], []  # names that lead to each other meet an empty list
            for p in bound[k].parts:
                if isinstance(p, _Literal):
                    found.append(p)
                elif p.name in where and depth < 50:
                    nth = bisect.bisect_left(places[p.name], bound[k].at) - 1
                    found += literals(where[p.name][max(nth, 0)], depth + 1)
                elif p.literal:
                    found.append(p.literal)
            done[k] = found[:_PARTS_MOST]
        return done[k]

    return [literals(k) for k in range(len(bound))]


def literal_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that reach a telling name."""
    bound = _Reader(text).read()
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for b, parts in zip(bound, _resolved(bound), strict=True):
        by_name = name_score(b.name)
        if by_name <= 0 or not parts:
            continue
        score = by_name * value_score("".join(p.value for p in parts))
        if score >= LEAST_SCORE:
            for p in parts:
                if p.end - p.start >= min(VALUE_LEAST, 4) and score > best.get((p.start, p.end), (0.0, ""))[0]:
                    best[p.start, p.end] = score, b.name
    return [(s, e, name, score) for (s, e), (score, name) in sorted(best.items())]


def spans_of(text: str) -> list[tuple[int, int, str, str | None, float]]:
    """(start, end, kind, name, score) of all spans of a text, by start and then kind. Patterns have no name and score 1."""
    found = [(s, e, kind, None, 1.0) for s, e, kind in base_spans(text)]
    held = sorted((s, e) for s, e, *_ in found)
    for s, e, name, score in literal_spans(text):
        k = bisect.bisect_right(held, (s, len(text) + 1))
        if not any(a <= s and e <= b for a, b in held[max(0, k - 3) : k]):
            found.append((s, e, "literal", name, score))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, keep: list[str | Column], at: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of docs and, from their column text, ``spans``: an array of kind, start, end, name and score. No shuffle."""

    def find(text: pa.Array) -> list[pa.Array]:
        hint = pc.fill_null(pc.or_(pc.match_substring_regex(text, _BASE_HINT), pc.match_substring_regex(text, _NAME_HINT)), False)
        rows = [[dict(zip(("start", "end", "kind", "name", "score"), s, strict=True)) for s in spans_of(t.as_py())] if h else [] for h, t in zip(hint.to_pylist(), text, strict=True)]
        return [pa.array(rows, _SPANS)]

    return map_text(docs, keep, "spans array<struct<kind: string, start: bigint, `end`: bigint, name: string, score: double>>", find, at)


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
