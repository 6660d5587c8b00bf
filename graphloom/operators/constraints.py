"""Integrity constraints as whole-dataset queries: each returns (rule, focus, value, severity) of its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, rule: str, focus: Column, value: Column | None = None, severity: str = "Violation") -> DataFrame:
    """The rows of df as violations of a rule."""
    return df.select(F.lit(rule).alias("rule"), focus.cast("string").alias("focus"), (F.lit(None) if value is None else value).cast("string").alias("value"), F.lit(severity).alias("severity"))


def cardinality(df: DataFrame, rule: str, focus: DataFrame, key: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Focus nodes (column ``key``) with fewer than ``least`` or more than ``most`` rows."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    counted = focus.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = F.col("n") < least
    if most is not None:
        wrong = wrong | (F.col("n") > most)
    return violations(counted.where(wrong), rule, F.col(key), F.col("n"))


def pattern(df: DataFrame, rule: str, key: str, column: str, regex: str) -> DataFrame:
    return violations(df.where(~F.coalesce(F.col(column).rlike(regex), F.lit(False))), rule, F.col(key), F.col(column))


def missing(focus: DataFrame, rule: str, key: str, having: DataFrame, other: str) -> DataFrame:
    """Focus nodes without a row in ``having``."""
    return violations(focus.join(having.select(F.col(other).alias("_o")), F.col(key) == F.col("_o"), "left_anti"), rule, F.col(key))


def unique_key(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Natural keys of more than one row."""
    many = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return violations(many, rule, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.col("n"))


def contiguous(df: DataFrame, rule: str, keys: list[str], rank: str) -> DataFrame:
    """Groups whose ranks don't run from their least by steps of one."""
    g = df.groupBy(*keys).agg(F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count_distinct(rank).alias("n"), F.count("*").alias("rows"))
    return violations(g.where("hi - lo + 1 <> n OR n <> rows"), rule, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.col("n"))


def prefix_overlap(names: DataFrame, rule: str, name: str) -> DataFrame:
    """Names that another name is a proper prefix of: in sorted order a prefix directly precedes a run of its extensions.

    Each name is compared with its own prefixes by an equi-join, not with all names.
    """
    own = names.select(F.col(name).alias("n")).distinct()
    cut = own.select("n", F.explode(F.expr("transform(sequence(1, length(n)), k -> substring(n, 1, k))")).alias("pre")).where("pre <> n")
    return violations(cut.join(own.select(F.col("n").alias("pre")), "pre"), rule, F.col("n"), F.col("pre"))


def report(*frames: DataFrame) -> DataFrame:
    """All violations with their place in a report: by severity, rule and focus."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    order = F.when(F.col("severity") == "Violation", 0).when(F.col("severity") == "Warning", 1).otherwise(2)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy(order, "focus", "value")))


def answers(facts: DataFrame, questions: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """question, s of the subjects that answer each question: of its class, with all it requires and none that it forbids.

    ``facts``: s, class, p. ``questions``: name, class, required, forbidden properties. A subject's
    properties are a set within the vocabulary, so that all questions are one aggregate.
    """
    own = facts.groupBy("s", "class").agg(F.collect_set("p").alias("ps"))
    hits = []
    for name, kind, required, forbidden in questions:
        test = F.col("class") == kind
        for p in required:
            test = test & F.array_contains("ps", p)
        for p in forbidden:
            test = test & ~F.array_contains("ps", p)
        hits.append(F.when(test, F.lit(name)))
    return own.select("s", F.explode(F.array_compact(F.array(*hits))).alias("question"))
