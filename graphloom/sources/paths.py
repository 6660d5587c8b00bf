"""Paths into JSON and XML texts: ``$.lines[*].part``, ``/order/line/@part``.

All JSON paths asked of a column become one tree and one schema, so that a text is parsed once, and only for what
is asked; a repeated level is exploded once for all paths that go through it. XML paths are relative to the nodes
of an iteration path. Texts that do not parse give nulls (JSON) or no rows (XML).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_NAME = re.compile(r"(?:([A-Za-z_][\w.-]*):)?([A-Za-z_][\w.-]*)")


def json_steps(path: str) -> list[str | None]:
    """The keys of a path, None for ``[*]``. It starts with ``$`` or a key. Raises ValueError for anything else."""
    text = path.strip()
    rest = text[1:] if text.startswith("$") else f".{text}"
    steps: list[str | None] = []
    while rest:
        key = _KEY.match(rest, 1) if rest[0] == "." else None
        if rest.startswith("[*]"):
            steps.append(None)
            rest = rest[3:]
        elif key:
            steps.append(key[0])
            rest = rest[key.end() :]
        else:
            raise ValueError(f"{path!r}: {rest!r} is neither .key nor [*]")
    if not steps:
        raise ValueError(f"{path!r} names no key")
    return steps


@dataclass
class _Node:
    """A place of the tree: below it keys, or one repeated level, or nothing: then it is asked for."""

    keys: dict[str, _Node] = field(default_factory=dict)
    each: _Node | None = None
    names: list[str] = field(default_factory=list)

    def schema(self) -> str:
        if self.each:
            return f"array<{self.each.schema()}>"
        return "struct<" + ", ".join(f"`{k}`: {n.schema()}" for k, n in self.keys.items()) + ">" if self.keys else "string"


def path_tree(paths: Mapping[str, str]) -> _Node:
    """The tree of all paths. Raises ValueError where a path ends within another, or where a place is asked as a list and as an object."""
    root = _Node()
    for name, path in paths.items():
        at = root
        for step in json_steps(path):
            if step is None:
                at.each = at.each or _Node()
                at = at.each
            else:
                at = at.keys.setdefault(step, _Node())
        at.names.append(name)
    todo = [root]
    while todo:
        at = todo.pop()
        if bool(at.keys) + bool(at.each) + bool(at.names) > 1:
            raise ValueError(f"paths cross at {at.names or list(at.keys)}: a place is a value, an object or a list")
        todo += [*at.keys.values(), *([at.each] if at.each else [])]
    return root


def read_json(rows: DataFrame, column: str, paths: Mapping[str, str]) -> DataFrame:
    """``rows`` with a string column for each path, and ``pos``: the places in the repeated levels, outermost first.

    A row comes once for each element of the innermost repeated level; an empty or missing list gives one row of nulls.
    Numbers and objects come as the text that JSON has for them. Two repeated levels beside each other are refused: ask them apart.
    """
    tree = path_tree(paths)
    added, level = {*paths, "pos"}, 0
    df = rows.withColumn("_at0", F.from_json(F.col(column).cast("string"), tree.schema())).withColumn("pos", F.array().cast("array<int>"))
    values: dict[str, Column] = {}
    node, at = tree, F.col("_at0")
    while True:
        lists: list[tuple[_Node, Column]] = []
        todo = [(node, at)]
        while todo:
            n, c = todo.pop()
            values.update(dict.fromkeys(n.names, c))
            todo += [(child, c[key]) for key, child in n.keys.items()]
            if n.each:
                lists.append((n.each, c))
        if not lists:
            break
        if len(lists) > 1:
            raise ValueError("two repeated levels, neither within the other, would be paired with each other")
        node, c = lists[0]
        level += 1
        df = df.select("*", F.posexplode_outer(c).alias("_pos", f"_at{level}")).withColumn("pos", F.concat("pos", F.array("_pos"))).drop("_pos")
        at = F.col(f"_at{level}")
    return df.select(*[F.col(c) for c in rows.columns if c not in added], *[values[name].alias(name) for name in paths], "pos")


@dataclass(frozen=True)
class XmlPath:
    """Element names below each other (None: any), and the attribute at the end."""

    elements: tuple[str | None, ...]
    attribute: str | None = None


def xml_path(path: str, prefixes: Mapping[str, str] | None = None) -> XmlPath:
    """``/a/b/@c``, ``a/*``, ``@c`` or ``.``. Raises ValueError for empty steps, ``//``, and prefixes that are not declared."""

    def named(part: str) -> str:
        m = _NAME.fullmatch(part)
        if not m or m[1] and m[1] not in (prefixes or {}):
            raise ValueError(f"{path!r}: {part!r} is no name, or its prefix is not declared")
        return f"{{{prefixes[m[1]]}}}{m[2]}" if m[1] else m[2]

    text = path.strip().removeprefix("/")
    if text == ".":
        return XmlPath(())
    parts = text.split("/")
    attribute = named(parts.pop()[1:]) if parts[-1].startswith("@") else None
    return XmlPath(tuple(None if p == "*" else named(p) for p in parts), attribute)


def _reached(nodes: list, elements: tuple[str | None, ...]) -> list:
    for name in elements:
        nodes = [child for n in nodes for child in n if name is None or child.tag == name]
    return nodes


def read_xml(rows: DataFrame, key: str, column: str, iterate: str, paths: Mapping[str, str], prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """key, pos and a list of texts for each path, for each node that the absolute path ``iterate`` reaches in a text."""
    root, wanted = xml_path(iterate, prefixes), {name: xml_path(p, prefixes) for name, p in paths.items()}
    if not root.elements or root.attribute:
        raise ValueError(f"{iterate!r} reaches no elements")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, found = [], [], {name: [] for name in wanted}
            for i, text in enumerate(batch.column(1)):
                try:
                    top = ElementTree.fromstring(text.as_py() or "")
                except ElementTree.ParseError:
                    continue
                nodes = _reached([top], root.elements[1:]) if root.elements[0] in (None, top.tag) else []
                for k, node in enumerate(nodes):
                    at.append(i)
                    pos.append(k)
                    for name, p in wanted.items():
                        ends = _reached([node], p.elements)
                        found[name].append([e.get(p.attribute) for e in ends if e.get(p.attribute) is not None] if p.attribute else ["".join(e.itertext()) for e in ends])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *[pa.array(v, pa.list_(pa.string())) for v in found.values()]], [key, "pos", *found])

    return rows.select(key, F.col(column).cast("string").alias("_text")).mapInArrow(run, ", ".join([f"{key} {kind}", "pos int", *[f"`{name}` array<string>" for name in wanted]]))
