"""Scoped, temporal binding resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective(bindings: DataFrame, closures: DataFrame) -> DataFrame:
    """Bindings whose window ends at the earliest closure, if that comes before their own end."""
    first = closures.groupBy("binding").agg(F.min("closed_at").alias("_closed"))
    j = bindings.join(first, bindings["node"] == first["binding"], "left").drop("binding")
    return j.withColumn("valid_to", F.least("valid_to", "_closed")).drop("_closed")


def _fits(bindings: DataFrame) -> tuple[DataFrame, Column]:
    """The bindings under other names and when one applies to a context row (id, contract, context, at)."""
    b = bindings.withColumnRenamed("contract", "_contract")
    return b, (F.col("contract") == F.col("_contract")) & (F.size(F.array_except("scopes", "context")) == 0) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))


def applicable(bindings: DataFrame, contexts: DataFrame) -> DataFrame:
    """Context rows with each binding whose scopes they hold and whose window they are in."""
    b, fits = _fits(bindings)
    return contexts.join(b, fits).drop("_contract")


def _beaten(scopes: Column, others: Column) -> Column:
    """Whether one of the other scopes is a strict superset."""
    return F.exists(others, lambda o: (F.size(o) > F.size(scopes)) & (F.size(F.array_except(scopes, o)) == 0))


def maximal(found: DataFrame) -> DataFrame:
    """Candidates that no candidate of the same id with a strict superset of scopes beats. An id has as many as its contract has bindings, at most."""
    others = F.collect_list("scopes").over(Window.partitionBy("id"))
    return found.withColumn("_others", others).where(~_beaten(F.col("scopes"), F.col("_others"))).drop("_others")


def resolve(bindings: DataFrame, contexts: DataFrame, fallback: DataFrame) -> DataFrame:
    """id, outcome (resolved, conflict, fallback, none) and scheme of each context row. ``fallback``: contract, scheme.

    One shuffle by id: a context keeps its row where no binding applies, and its candidates, as many
    as its contract has bindings at most, are compared in one array.
    """
    b, fits = _fits(bindings)
    found = F.when(F.col("_contract").isNotNull(), F.struct("scopes", "scheme"))
    c = contexts.join(b, fits, "left").groupBy("id", "contract").agg(F.collect_list(found).alias("c"))
    scopes = F.transform("c", lambda x: x["scopes"])
    best = F.filter("c", lambda x: ~_beaten(x["scopes"], F.col("all")))
    schemes = F.array_sort(F.array_distinct(F.transform(F.col("best"), lambda x: x["scheme"])))
    back = fallback.select(F.col("contract").alias("_c"), F.col("scheme").alias("_fallback"))
    j = c.withColumn("all", scopes).withColumn("best", best).withColumn("schemes", schemes).join(back, F.col("contract") == F.col("_c"), "left")
    n = F.size("schemes")
    outcome = F.when(n == 1, "resolved").when(n > 1, "conflict").when(F.col("_fallback").isNotNull(), "fallback").otherwise("none")
    return j.select("id", outcome.alias("outcome"), F.when(n == 1, F.col("schemes")[0]).when(n == 0, F.col("_fallback")).alias("scheme"))
