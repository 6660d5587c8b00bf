"""Documents lifted to facts, in two views, and an index of classes with what is inherited.

A document gives a node, a node for each line that is not blank, what lines refer to, and what the document
declares: its columns and ``key = "value"`` texts. The blind view leaves out all that is declared, for readers that
must not see it. A document's lines are exploded where the document is; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure

# What counts as a reference and as a declaration in a line.
REFERENCE = r"[a-z0-9.]+@[a-z0-9.]+[a-z0-9]"
DECLARATION = r'([a-z_]+) = "([^"]*)"'


def _fact(s: Column, p: Column, o: Column, declared: bool) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(declared).alias("declared"))


def lifted(docs: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """key, s, p, o, declared: the facts of each document. Null columns state nothing, a null text has no lines."""
    node = F.concat(F.lit("d"), F.col(key).cast("string"))
    own = F.array(_fact(node, F.lit("type"), F.lit("Document"), False), *[F.when(F.col(c).isNotNull(), _fact(node, F.lit(c), F.col(c), True)) for c in columns])
    heads = docs.select(key, F.inline(F.array_compact(own)))
    lines = docs.select(key, node.alias("_d"), F.posexplode(F.split(text, "\n")).alias("_i", "_line")).where(F.trim("_line") != "")
    at, line = F.concat_ws("/", "_d", F.col("_i").cast("string")), F.col("_line")
    body = F.array(_fact(at, F.lit("type"), F.lit("Line"), False), _fact(at, F.lit("of"), F.col("_d"), False), _fact(at, F.lit("text"), F.sha2(line, 256), False))
    refers = F.transform(F.regexp_extract_all(line, F.lit(REFERENCE), F.lit(0)), lambda x: _fact(at, F.lit("refersTo"), x, False))
    names, values = (F.regexp_extract_all(line, F.lit(DECLARATION), F.lit(k)) for k in (1, 2))
    declares = F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: _fact(F.col("_d"), x["k"], x["v"], True))
    return heads.unionByName(lines.select(key, F.inline(F.concat(body, refers, declares))))


def views(facts: DataFrame) -> DataFrame:
    """The facts with the view that they are seen in: ``declared`` has all, ``blind`` none that is declared."""
    seen = F.when(F.col("declared"), F.array(F.lit("declared"))).otherwise(F.array(F.lit("declared"), F.lit("blind")))
    return facts.select("*", F.explode(seen).alias("seen")).drop("declared")


def class_index(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """class, own, all, properties: instances stated and inherited up ``edges`` (child, parent), and the properties found on them.

    ``facts``: s, p, o with classes as objects of ``type``. Counts are of distinct instances.
    """
    types = facts.where("p = 'type'").select("s", F.col("o").alias("class")).distinct()
    up = closure(edges).select(F.col("desc").alias("class"), F.col("anc").alias("above"))
    inherited = types.join(up, "class").select("s", F.col("above").alias("class")).unionByName(types).distinct()
    used = facts.where("p <> 'type'").select("s", "p").distinct()
    counts = inherited.groupBy("class").agg(F.count("*").alias("all"))
    own = types.groupBy("class").agg(F.count("*").alias("own"))
    props = inherited.join(used, "s").groupBy("class").agg(F.array_join(F.array_sort(F.collect_set("p")), " ").alias("properties"))
    found = counts.join(own, "class", "left").join(props, "class", "left")
    return found.select("class", F.coalesce("own", F.lit(0)).cast("long").alias("own"), "all", F.coalesce("properties", F.lit("")).alias("properties"))
