"""Typed operations on versioned rows: declaration, static checks, parameters, SQL text, capabilities.

An operation is declared once as data. Checks refuse what cannot be run safely before anything is
planned; requests are then checked as rows of a table, so that a batch of any size is one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("create", "replace", "append", "tombstone", "rows")
#: How a parameter's text becomes its type; null where it can't.
TYPES: dict[str, Callable[[Column], Column]] = {
    "long": lambda c: c.try_cast("long"),
    "double": lambda c: c.try_cast("double"),
    "timestamp": lambda c: c.try_cast("timestamp"),
    "string": lambda c: c,
    "iri": lambda c: F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+$"), c),
}


@dataclass(frozen=True)
class Operation:
    """What an operation does to rows of ``table`` with the key ``key``: parameters by type, those that must be given, a guard."""

    name: str
    kind: str
    table: str
    key: str
    params: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    guard: str | None = None
    expects_seq: bool = False


def refusals(op: Operation) -> list[str]:
    """The static rules that an operation breaks, by name."""
    guard, found = op.guard or "", []
    if op.kind not in KINDS:
        found.append("UnknownKind")
    if not re.fullmatch(r"[A-Za-z_]\w*", op.name) or not re.fullmatch(r"[A-Za-z_]\w*", op.table):
        found.append("BadName")
    if op.key not in op.params:
        found.append("KeyIsNoParameter")
    elif op.key not in op.required:
        found.append("KeyNotRequired")
    if set(op.params.values()) - set(TYPES):
        found.append("UnknownType")
    if set(op.required) - set(op.params):
        found.append("RequiredUndeclared")
    if re.search(r"(?i)\b(now|current_timestamp|current_date|rand|uuid)\b", guard):
        found.append("ClockInGuard")
    if set(re.findall(r":(\w+)", guard)) - set(op.params):
        found.append("UnboundInGuard")
    if op.kind == "replace" and not op.expects_seq:
        found.append("ReplaceWithoutSeq")
    if op.kind == "create" and op.expects_seq:
        found.append("SeqOnCreate")
    if op.kind == "tombstone" and set(op.params) - {op.key, "seq"}:
        found.append("PayloadOnTombstone")
    return found


def static_rules() -> dict[str, Column]:
    """What refuses an operation stored as a row: operation, kind, table, key, params (map of name to type), required, guard, expects_seq.

    The rules of ``refusals`` and those that only show in a store or in a guard's text; what Catalyst's
    analysis reports when the rendered text is planned (unknown tables and columns, types of expressions) is left to it.
    """
    c, names, required = F.col, F.map_keys("params"), F.coalesce("required", F.array().cast("array<string>"))
    guard, seq = F.coalesce("guard", F.lit("")), F.element_at("params", F.lit("seq"))
    word = r"^[A-Za-z_]\w*$"
    used = F.regexp_extract_all(guard, F.lit(r":(\w+)"), F.lit(1))
    payload = F.filter(names, lambda n: (n != c("key")) & (n != "seq"))

    def count(what: str) -> Column:
        return F.length(guard) - F.length(F.replace(guard, F.lit(what), F.lit("")))

    return {
        "UnknownKind": ~c("kind").isin(*KINDS), "BadName": ~(c("operation").rlike(word) & c("table").rlike(word)), "DuplicateOperation": F.count("*").over(Window.partitionBy("operation")) > 1,
        "KeyIsNoParameter": ~F.array_contains(names, c("key")), "KeyNotRequired": F.array_contains(names, c("key")) & ~F.array_contains(required, c("key")), "KeyType": F.array_contains(names, c("key")) & ~F.coalesce(F.element_at("params", c("key")).isin("long", "string", "iri"), F.lit(False)),
        "UnknownType": F.exists(F.map_values("params"), lambda v: ~F.coalesce(v.isin(*TYPES), F.lit(False))), "BadParameterName": F.exists(names, lambda n: ~n.rlike(word)), "ReservedParameter": F.exists(names, lambda n: n.isin("deleted", "t", "s")),
        "CaseClash": F.size(F.array_distinct(F.transform(names, F.lower))) < F.size(names), "RequiredUndeclared": F.size(F.array_except(required, names)) > 0, "RequiredTwice": F.size(F.array_distinct(required)) < F.size(required),
        "SeqUndeclared": c("expects_seq") & seq.isNull(), "SeqNotLong": seq.isNotNull() & (seq != "long"), "SeqNotRequired": c("expects_seq") & seq.isNotNull() & ~F.array_contains(required, F.lit("seq")), "SeqOnCreate": (c("kind") == "create") & c("expects_seq"), "SeqOnAppend": (c("kind") == "append") & c("expects_seq"),
        "ReplaceWithoutSeq": (c("kind") == "replace") & ~c("expects_seq"), "TombstoneWithoutSeq": (c("kind") == "tombstone") & ~c("expects_seq"), "PayloadOnTombstone": (c("kind") == "tombstone") & (F.size(payload) > 0), "NoPayload": c("kind").isin("create", "replace", "append") & (F.size(payload) == 0),
        "EmptyGuard": c("guard").isNotNull() & (F.trim(guard) == ""), "ClockInGuard": guard.rlike(r"(?i)\b(now|current_timestamp|current_date|rand|uuid)\b"), "UnboundInGuard": F.size(F.array_except(used, names)) > 0, "OptionalInGuard": F.size(F.array_except(F.array_intersect(used, names), required)) > 0,
        "StatementInGuard": guard.rlike(r";|--|/\*"), "QueryInGuard": guard.rlike(r"(?i)\b(select|merge|insert|update|delete)\b"), "UnbalancedGuard": (count("(") != count(")")) | (count("'") % 2 == 1), "GuardOnRows": (c("kind") == "rows") & c("guard").isNotNull(), "RowInGuardOfCreate": c("kind").isin("create", "append") & guard.rlike(r"\bt\."),
    }


def refused_operations(operations: DataFrame) -> DataFrame:
    """operation, rule of every static rule that a stored operation breaks; a rule that cannot be decided is broken."""
    rules = static_rules()
    tested = operations.select("operation", *[F.coalesce(test, F.lit(True)).alias(name) for name, test in rules.items()])
    hits = F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name in rules]))
    return tested.select("operation", F.explode(hits).alias("rule"))


def rendered(op: Operation) -> str:
    """The SQL text of an operation that no rule refuses, with its parameters as :name."""
    broken = refusals(op)
    if broken:
        raise ValueError(f"{op.name}: {', '.join(broken)}")
    values = [p for p in op.params if p not in (op.key, "seq")]
    guard = (" AND t.seq = :seq" if op.expects_seq else "") + (f" AND ({op.guard})" if op.guard else "")
    match = f"MERGE INTO {op.table} t USING (SELECT :{op.key} AS {op.key}) s ON t.{op.key} = s.{op.key}"
    if op.kind == "create":
        return f"{match} WHEN NOT MATCHED{guard} THEN INSERT ({', '.join([op.key, *values, 'seq'])}) VALUES ({', '.join([f':{p}' for p in (op.key, *values)] + ['1'])})"
    if op.kind == "append":
        return f"INSERT INTO {op.table} ({', '.join([op.key, *values])}) SELECT {', '.join(f':{p}' for p in (op.key, *values))}" + (f" WHERE {op.guard}" if op.guard else "")
    if op.kind == "tombstone":
        return f"{match} WHEN MATCHED{guard} THEN UPDATE SET t.deleted = TRUE, t.seq = t.seq + 1"
    if op.kind == "rows":
        return f"DELETE FROM {op.table} WHERE {op.key} = :{op.key}; INSERT INTO {op.table} SELECT * FROM payload WHERE {op.key} = :{op.key}"
    return f"{match} WHEN MATCHED{guard} THEN UPDATE SET {', '.join([f't.{p} = :{p}' for p in values] + ['t.seq = t.seq + 1'])}"


def rendered_text() -> Column:
    """The SQL text of an operation stored as a row, as ``rendered`` has it for a declared one. Ask for it only where no rule refuses the row."""
    c, key = F.col, F.col("key")
    values = F.filter(F.map_keys("params"), lambda n: (n != key) & (n != "seq"))

    def listed(names: Column, form: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(names, form), ", ")

    def slot(n: Column) -> Column:
        return F.concat(F.lit(":"), n)

    all_names = F.concat(F.array(key), values)
    guard = F.concat(F.when(c("expects_seq"), " AND t.seq = :seq").otherwise(""), F.when(c("guard").isNotNull(), F.concat(F.lit(" AND ("), c("guard"), F.lit(")"))).otherwise(""))
    match = F.concat(F.lit("MERGE INTO "), c("table"), F.lit(" t USING (SELECT :"), key, F.lit(" AS "), key, F.lit(") s ON t."), key, F.lit(" = s."), key)
    create = F.concat(match, F.lit(" WHEN NOT MATCHED"), guard, F.lit(" THEN INSERT ("), F.array_join(all_names, ", "), F.lit(", seq) VALUES ("), listed(all_names, slot), F.lit(", 1)"))
    append = F.concat(F.lit("INSERT INTO "), c("table"), F.lit(" ("), F.array_join(all_names, ", "), F.lit(") SELECT "), listed(all_names, slot), F.when(c("guard").isNotNull(), F.concat(F.lit(" WHERE "), c("guard"))).otherwise(""))
    tombstone = F.concat(match, F.lit(" WHEN MATCHED"), guard, F.lit(" THEN UPDATE SET t.deleted = TRUE, t.seq = t.seq + 1"))
    rows = F.concat(F.lit("DELETE FROM "), c("table"), F.lit(" WHERE "), key, F.lit(" = :"), key, F.lit("; INSERT INTO "), c("table"), F.lit(" SELECT * FROM payload WHERE "), key, F.lit(" = :"), key)
    replace = F.concat(match, F.lit(" WHEN MATCHED"), guard, F.lit(" THEN UPDATE SET "), listed(values, lambda n: F.concat(F.lit("t."), n, F.lit(" = :"), n)), F.lit(", t.seq = t.seq + 1"))
    return F.when(c("kind") == "create", create).when(c("kind") == "append", append).when(c("kind") == "tombstone", tombstone).when(c("kind") == "rows", rows).when(c("kind") == "replace", replace)


#: Builders of operations by kind: a name, a table, a key and payload columns give an operation that no rule refuses.
BUILDERS: dict[str, Callable[..., Operation]] = {}


def builder(kind: str) -> Callable:
    """Register a builder of operations; a name can be taken once."""

    def register(f: Callable[..., Operation]) -> Callable[..., Operation]:
        if kind in BUILDERS:
            raise ValueError(f"two builders for {kind}")
        BUILDERS[kind] = f
        return f

    return register


def _build(kind: str) -> None:
    @builder(kind)
    def make(name: str, table: str, key: str, payload: dict[str, str] | None = None, guard: str | None = None) -> Operation:
        seq = kind in ("replace", "tombstone")
        params = {key: "long"} | ({} if kind == "tombstone" else payload or {}) | ({"seq": "long"} if seq else {})
        return Operation(name, kind, table, key, params, tuple(params), guard, seq)


for _kind in KINDS:
    _build(_kind)


def broken_parameters(requests: DataFrame, request: str, params: Column, op: Operation) -> DataFrame:
    """request, parameter, reason of parameters (a map of texts) that are missing, of another type or not declared."""
    found = []
    for name, kind in op.params.items():
        given = F.element_at(params, name)
        wrong = given.isNotNull() & TYPES[kind](given).isNull()
        missing = given.isNull() if name in op.required else F.lit(False)
        found.append(F.when(missing, F.struct(F.lit(name).alias("parameter"), F.lit("missing").alias("reason"))).when(wrong, F.struct(F.lit(name).alias("parameter"), F.lit(f"no {kind}").alias("reason"))))
    unknown = F.transform(F.filter(F.map_keys(params), lambda k: ~k.isin(*op.params)), lambda k: F.struct(k.alias("parameter"), F.lit("undeclared").alias("reason")))
    return requests.select(F.col(request).alias("request"), F.explode(F.concat(F.array_compact(F.array(*found)), unknown)).alias("x")).select("request", "x.*")


def refused_rows(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of every rule that a row breaks; a rule that cannot be decided is broken."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]))
    return rows.select(F.col(key).alias("key"), F.explode(hits).alias("rule"))


def shortfalls(required: DataFrame, provided: DataFrame, order: DataFrame) -> DataFrame:
    """subject, axis, level, offered of requirements that the offer does not reach.

    ``required``: subject, axis, level; ``provided``: axis, offered; ``order`` (low, high) is a
    partial order, closed over steps and including each level itself.
    """
    reach = order.select(F.col("low").alias("level"), F.col("high").alias("offered"), F.lit(True).alias("_ok"))
    return required.join(provided, "axis", "left").join(reach, ["level", "offered"], "left").where("_ok is null").select("subject", "axis", "level", "offered")
