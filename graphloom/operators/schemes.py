"""Mapping schemes as tables of nodes: what is in force, what role a node has, what it inherits, and what it writes.

A node is a row: node, parent, template, tbox, rbox, abox (how it matches a class, a property or an
individual of the target: exact, broad, narrow, inverse or null), data_ref, data_inline, lookup_path,
deferred, confidence. Plans made of nodes are small data, kept as JSON with its digest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an instance takes from its template where it gives no value of its own.
INHERITED = ("tbox", "rbox", "abox", "data_ref", "data_inline", "lookup_path", "deferred")


def merged(nodes: DataFrame) -> DataFrame:
    """nodes, each with its template's values where it has none: the instance's own go first."""
    above = nodes.select(F.col("node").alias("_t"), *[F.col(c).alias(f"_{c}") for c in INHERITED])
    j = nodes.join(above, F.col("template") == F.col("_t"), "left")
    return j.select(*[F.coalesce(c, f"_{c}").alias(c) if c in INHERITED else F.col(c) for c in nodes.columns])


def role() -> Column:
    """What a node does, decided by what it has, the first case that fits."""
    tbox, rbox, abox = F.col("tbox"), F.col("rbox"), F.col("abox")
    joins = rbox.isin("exact", "inverse", "broad")
    value = F.coalesce("data_ref", "data_inline").isNotNull() | abox.isin("exact", "broad")
    joins, value = F.coalesce(joins, F.lit(False)), F.coalesce(value, F.lit(False))
    child, deferred = F.col("parent").isNotNull(), F.col("deferred").isNotNull()
    narrow = F.coalesce((tbox == "narrow") | (rbox == "narrow") | (abox == "narrow"), F.lit(False))
    return (
        F.when(narrow, "refused")
        .when(F.col("lookup_path").isNotNull(), "lookup")
        .when(deferred & child & joins & ~value, "contextual")
        .when(joins & value & tbox.isNull() & ~deferred & child, "assertion")
        .when(deferred, "datum")
        .when(tbox == "broad", "class creation")
        .when((tbox == "exact") & ~joins, "class reference")
        .when((rbox == "broad") & ~child & ~value, "property creation")
        .when(joins, "assertion")
        .when(abox.isNotNull(), "correspondence")
        .otherwise("unclassified")
    )


def confident(nodes: DataFrame, least: float) -> DataFrame:
    """Nodes whose confidence, taken with their parent's, is at least ``least``; one without a confidence is sure."""
    above = nodes.select(F.col("node").alias("_p"), F.col("confidence").alias("_c"))
    effective = F.coalesce("confidence", F.lit(1.0)) * F.coalesce("_c", F.lit(1.0))
    return nodes.join(above, F.col("parent") == F.col("_p"), "left").withColumn("effective", effective).where(F.col("effective") >= least).select(*nodes.columns, "effective")


@dataclass(frozen=True)
class Spec:
    """One compiled mapping: rows of ``source`` that pass ``guard`` get the subject and the triple of ``predicate``.

    ``subject`` and ``value`` are templates, text with {column} in it; ``predicate`` "a" types the subject.
    """

    name: str
    source: str
    subject: str
    predicate: str
    value: str
    guard: str | None = None
    confidence: float = 1.0


def template(text: str) -> Column:
    """A template's value; null if a column that it names is."""
    parts, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.col(name).cast("string")]
    return F.concat(*parts, F.lit(rest))


def run(specs: list[Spec], table: Callable[[str], DataFrame], least: float = 0.0, parse: Callable[[str], Column] = template) -> DataFrame:
    """s, p, o, mapping of the triples that specs of at least that confidence write; a triple with an unbound part is not written.

    ``parse`` reads the templates, so that a caller's own path language can stand in for them.
    """
    out = None
    for spec in specs:
        if spec.confidence < least:
            continue
        rows = table(spec.source)
        rows = rows.where(spec.guard) if spec.guard else rows
        made = rows.select(parse(spec.subject).alias("s"), F.lit("type" if spec.predicate == "a" else spec.predicate).alias("p"), parse(spec.value).alias("o"), F.lit(spec.name).alias("mapping")).where("s is not null and o is not null")
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no mapping is confident enough")
    return out


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stored(specs: list[Spec]) -> tuple[str, str]:
    """(canonical JSON of a compiled mapping, its SHA-256)."""
    text = canonical_json([asdict(s) for s in specs])
    return text, hashlib.sha256(text.encode()).hexdigest()


def read_back(text: str, digest: str) -> list[Spec]:
    """The compiled mapping; raises ValueError if the text is not the one that was stored or has unknown parts."""
    if hashlib.sha256(text.encode()).hexdigest() != digest:
        raise ValueError("the stored mapping has another digest")
    known = {f.name for f in fields(Spec)}
    rows = json.loads(text)
    if any(set(r) - known for r in rows):
        raise ValueError("the stored mapping has unknown parts")
    return [Spec(**r) for r in rows]


@dataclass(frozen=True)
class Bound:
    """A parameter of a shape: kind is required, least, most, one_of or pattern."""

    shape: str
    column: str
    kind: str
    value: object = None


def violations(rows: DataFrame, focus: str, bounds: list[Bound]) -> DataFrame:
    """shape, kind, focus of each bound that a row breaks; all but ``required`` pass over missing values."""
    broken = []
    for b in bounds:
        c = F.col(b.column)
        if b.kind == "required":
            test = c.isNull()
        elif b.kind == "least":
            test = c < F.lit(b.value)
        elif b.kind == "most":
            test = c > F.lit(b.value)
        elif b.kind == "one_of":
            test = ~c.isin(*b.value)
        elif b.kind == "pattern":
            test = ~c.rlike(b.value)
        else:
            raise ValueError(f"unknown kind of bound {b.kind}")
        broken.append(F.when(test, F.struct(F.lit(b.shape).alias("shape"), F.lit(b.kind).alias("kind"))))
    return rows.select(F.col(focus).alias("focus"), F.explode(F.array_compact(F.array(*broken))).alias("b")).select("b.shape", "b.kind", "focus")


#: The terms by which a compiled mapping is exchanged as rows, with the fields that they carry.
EXCHANGED = {"logicalSource": "source", "subjectTemplate": "subject", "predicate": "predicate", "objectTemplate": "value", "condition": "guard", "confidence": "confidence"}


def exported(specs: list[Spec]) -> list[tuple[str, str, str]]:
    """(mapping, term, value) rows of a compiled mapping; parts that are not given have no row."""
    return [(s.name, term, str(getattr(s, name))) for s in specs for term, name in EXCHANGED.items() if getattr(s, name) is not None]


def imported(rows: list[tuple[str, str, str]]) -> list[Spec]:
    """The compiled mapping of such rows, in the order of its names. ValueError for an unknown term, a term twice or a missing part."""
    found: dict[str, dict] = {}
    for name, term, value in rows:
        if term not in EXCHANGED or EXCHANGED[term] in found.setdefault(name, {}):
            raise ValueError(f"{name} has an unknown or repeated term {term}")
        found[name][EXCHANGED[term]] = float(value) if term == "confidence" else value
    try:
        return [Spec(name, **parts) for name, parts in sorted(found.items())]
    except TypeError as e:
        raise ValueError(f"a mapping lacks a part: {e}") from e


#: Mappings of one scheme that are compiled into plans.
MOST = 2000
#: Terms that a mapping must have.
NEEDED = ("logicalSource", "subjectTemplate", "predicate", "objectTemplate")


def findings(rows: DataFrame) -> DataFrame:
    """mapping, finding, term of a scheme's rows (mapping, term, value): what keeps a mapping from being compiled.

    UnknownTerm, RepeatedTerm (other values for a term; equal rows are one), MissingTerm, EmptyValue and BadConfidence.
    """
    each = rows.select("mapping", "term", "value").distinct()
    known = F.col("term").isin(*EXCHANGED)
    one = F.when(~known, "UnknownTerm").when(F.coalesce(F.trim("value"), F.lit("")) == "", "EmptyValue").when((F.col("term") == "confidence") & ~F.coalesce(F.col("value").try_cast("double").between(0, 1), F.lit(False)), "BadConfidence")
    own = each.select("mapping", one.alias("finding"), "term").where("finding is not null")
    twice = each.where(known).groupBy("mapping", "term").agg(F.count("*").alias("n")).where("n > 1").select("mapping", F.lit("RepeatedTerm").alias("finding"), "term")
    held = each.groupBy("mapping").agg(F.collect_set("term").alias("terms"))  # the terms of one mapping
    missing = held.select("mapping", F.lit("MissingTerm").alias("finding"), F.explode(F.array_except(F.array(*[F.lit(t) for t in NEEDED]), "terms")).alias("term"))
    return own.unionByName(twice).unionByName(missing).distinct()


def compiled(rows: DataFrame) -> list[Spec]:
    """The mappings of a scheme's rows that have no finding, compiled. ValueError for more than MOST of them."""
    sound = rows.select("mapping", "term", "value").distinct().join(findings(rows).select("mapping").distinct(), "mapping", "left_anti")
    found = [tuple(r) for r in sound.limit(MOST * len(EXCHANGED) + 1).collect()]
    if len({r[0] for r in found}) > MOST:
        raise ValueError(f"more than {MOST} mappings in one scheme")
    return imported(found)


def run_by_source(specs: list[Spec], table: Callable[[str], DataFrame], least: float = 0.0, parse: Callable[[str], Column] = template) -> DataFrame:
    """As ``run``, with one read of each source for all specs over it."""
    of: dict[str, list[Spec]] = {}
    for spec in specs:
        if spec.confidence >= least:
            of.setdefault(spec.source, []).append(spec)
    if not of:
        raise ValueError("no mapping is confident enough")
    out = None
    for source, own in of.items():
        made = []
        for spec in own:
            s, o = parse(spec.subject), parse(spec.value)
            triple = F.struct(s.alias("s"), F.lit("type" if spec.predicate == "a" else spec.predicate).alias("p"), o.alias("o"), F.lit(spec.name).alias("mapping"))
            made.append(F.when((F.expr(spec.guard) if spec.guard else F.lit(True)) & s.isNotNull() & o.isNotNull(), triple))
        rows = table(source).select(F.inline(F.array_compact(F.array(*made))))
        out = rows if out is None else out.unionByName(rows)
    return out


def json_chain(fields: dict[str, Column], steps: list[tuple[str, dict | list]]) -> Column:
    """A JSON object through a chain of steps: shift moves fields to dotted paths, modify computes, default fills, remove drops.

    ``modify`` maps a path to a function of the column there; steps run in order at plan time, so
    that the row costs one expression. Keys are sorted, no spaces, null fields left out.
    """
    now = dict(fields)
    for kind, spec in steps:
        if kind == "shift":
            now = {spec.get(k, k): v for k, v in now.items() if spec.get(k, k) is not None}
        elif kind == "modify":
            now |= {k: f(now[k]) for k, f in spec.items() if k in now}
        elif kind == "default":
            now = {k: F.coalesce(v, F.lit(spec[k])) if k in spec else v for k, v in now.items()} | {k: F.lit(v) for k, v in spec.items() if k not in now}
        elif kind == "remove":
            now = {k: v for k, v in now.items() if k not in spec}
        else:
            raise ValueError(f"unknown step {kind}")

    def nested(parts: dict[tuple[str, ...], Column]) -> Column:
        heads: dict[str, dict] = {}
        for path, v in parts.items():
            heads.setdefault(path[0], {})[path[1:]] = v
        return F.struct(*[(heads[h][()] if () in heads[h] else nested(heads[h])).alias(h) for h in sorted(heads)])

    return F.to_json(nested({tuple(k.split(".")): v for k, v in now.items()}))
