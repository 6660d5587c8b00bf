"""RDF term lines: quads to N-Triples text and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a literal escapes, in this order.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escaped(text: Column) -> Column:
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    for raw, safe in _ESCAPES[1:]:
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return F.replace(text, F.lit("\u0000"), F.lit("\\"))


def to_ntriples(quads: DataFrame, base: str = "urn:") -> DataFrame:
    """line: one N-Triples line for each quad; names get the base as prefix."""
    def iri(c: str) -> Column:
        return F.concat(F.lit(f"<{base}"), F.col(c), F.lit(">"))

    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^"), iri("o_dt"))).otherwise("")
    literal = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), suffix)
    return quads.select(F.concat_ws(" ", iri("s"), iri("p"), F.when(F.col("o_kind") == "iri", iri("o")).otherwise(literal), F.lit(".")).alias("line"))


def from_ntriples(lines: DataFrame, base: str = "urn:") -> DataFrame:
    """s, p, o, o_kind, o_dt, o_lang of the lines; lines that don't parse are left out."""
    # Fixed value: the shape of a line.
    pattern = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'

    def part(k: int) -> Column:
        return F.regexp_extract("line", pattern, k)

    def name(c: Column) -> Column:
        return F.when(c.startswith(base), F.substring(c, len(base) + 1, 1 << 20)).otherwise(c)

    is_iri = part(3) != ""
    return lines.where(F.col("line").rlike(pattern)).select(
        name(part(1)).alias("s"), name(part(2)).alias("p"), F.when(is_iri, name(part(3))).otherwise(unescaped(part(4))).alias("o"),
        F.when(is_iri, "iri").otherwise("literal").alias("o_kind"), F.nullif(name(part(5)), F.lit("")).alias("o_dt"), F.nullif(part(6), F.lit("")).alias("o_lang"),
    )
