"""Strong Kleene logic on nullable booleans: true is Permitted, false Denied, null Undetermined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERMITTED, DENIED, UNDETERMINED = "Permitted", "Denied", "Undetermined"


def decision(value: Column) -> Column:
    """The name of a three-valued result."""
    return F.when(value.isNull(), UNDETERMINED).when(value, PERMITTED).otherwise(DENIED)


def from_decision(name: Column) -> Column:
    return F.when(name == PERMITTED, True).when(name == DENIED, False)


def every(value: Column) -> Column:
    """Kleene conjunction over a group: false if one is, else null if one is; true for an empty group."""
    return F.when(F.count_if(~value) > 0, False).when(F.count_if(value.isNull()) > 0, F.lit(None)).otherwise(True)


def some(value: Column) -> Column:
    """Kleene disjunction over a group: true if one is, else null if one is; false for an empty group."""
    return F.when(F.count_if(value) > 0, True).when(F.count_if(value.isNull()) > 0, F.lit(None)).otherwise(False)


def at_least_as_known(a: Column, b: Column) -> Column:
    """Information order: a is undetermined or equals b."""
    return a.isNull() | a.eqNullSafe(b)
