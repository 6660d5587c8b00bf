"""Three-valued conditions and profiles as columns and frames.

A condition's value is a nullable boolean (see functions.kleene); each result carries a diagnostic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import kleene


def interval(value: Column, unit: Column, intervals: list[tuple]) -> Column:
    """Whether a value lies in one of (lower, lower closed, upper, upper closed, unit); null without a value or a bound in its unit."""
    inside = F.lit(False)
    for lo, lo_closed, hi, hi_closed, u in intervals:
        fits = unit == u
        if lo is not None:
            fits = fits & ((value >= lo) if lo_closed else (value > lo))
        if hi is not None:
            fits = fits & ((value <= hi) if hi_closed else (value < hi))
        inside = inside | fits
    return F.when(value.isNotNull() & unit.isin(*{i[4] for i in intervals}), inside)


def interval_diagnostic(value: Column, unit: Column, intervals: list[tuple]) -> Column:
    return F.when(value.isNull(), "MissingCandidate").when(~F.coalesce(unit.isin(*{i[4] for i in intervals}), F.lit(False)), "NoBoundInUnit")


def flat(concept: Column, in_scheme: Column, required: list[str], excluded: list[str]) -> Column:
    """Exact match: exclusions beat requirements; with exclusions only, the rest of the scheme is permitted."""
    out = F.when(concept.isin(*excluded), False) if excluded else F.when(F.lit(False), False)
    if required:
        return F.when(concept.isNotNull() & in_scheme, out.when(concept.isin(*required), True).otherwise(False))
    return F.when(concept.isNotNull() & in_scheme, out.otherwise(True))


def hierarchical(candidates: DataFrame, concept: str, closure: DataFrame, required: list[str], excluded: list[str]) -> DataFrame:
    """candidates with ``value``: at or below an exclusion false, above one null, at or below a requirement true, else false."""
    up = closure.groupBy("desc").agg(F.collect_set("anc").alias("_up"))
    down = closure.where(F.col("desc").isin(*excluded)).groupBy("anc").agg(F.lit(True).alias("_above"))
    with_self = F.array_union(F.coalesce("_up", F.array().cast("array<string>")), F.array(concept))
    j = candidates.join(up, F.col(concept) == F.col("desc"), "left").join(down, F.col(concept) == F.col("anc"), "left")
    hit = F.arrays_overlap(with_self, F.array(*[F.lit(x) for x in required])) if required else F.lit(True)
    out = F.arrays_overlap(with_self, F.array(*[F.lit(x) for x in excluded])) if excluded else F.lit(False)
    value = F.when(F.col(concept).isNull(), F.lit(None)).when(out, False).when(F.coalesce("_above", F.lit(False)), F.lit(None)).when(hit, True).otherwise(False)
    return j.withColumn("value", value).select(*candidates.columns, "value")


def read_set(values: DataFrame, subjects: DataFrame, key: str, reading: str, closed: Column) -> DataFrame:
    """key, value of a subject's set under SomeValue or EveryValue; an open or empty set decides only where values settle it."""
    c = values.groupBy(key).agg(F.count_if("value").alias("p"), F.count_if(~F.col("value")).alias("d"), F.count_if(F.col("value").isNull()).alias("u"))
    j = subjects.join(c, key, "left").na.fill(0, ["p", "d", "u"])
    none = F.lit(None).cast("boolean")
    if reading == "SomeValue":
        value = F.when(F.col("p") > 0, True).when((F.col("u") == 0) & closed, False).otherwise(none)
    elif reading == "EveryValue":
        value = F.when(F.col("d") > 0, False).when((F.col("u") == 0) & closed, True).otherwise(none)
    else:
        raise ValueError(f"unknown reading {reading}")
    return j.select(key, value.alias("value"))


#: Ways to compose the conditions of a profile, by name; ``composition`` adds one.
COMPOSITIONS: dict[str, Callable[[Column], Column]] = {"AllRequired": kleene.every, "AnySufficient": kleene.some}


def composition(name: str) -> Callable:
    """Register an aggregate of three-valued conditions as a way to compose them; a name can be taken once."""

    def register(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        if COMPOSITIONS.get(name, f) is not f:
            raise ValueError(f"there is another composition {name}")
        COMPOSITIONS[name] = f
        return f

    return register


def profile(conditions: DataFrame, keys: list[str], aggregation: str) -> DataFrame:
    """keys, value: AllRequired is a Kleene conjunction, AnySufficient a disjunction, of the column value; other registered ways as they say."""
    if aggregation not in COMPOSITIONS:
        raise ValueError(f"unknown aggregation {aggregation}")
    return conditions.groupBy(*keys).agg(COMPOSITIONS[aggregation](F.col("value")).alias("value"))


def compare_sets(tested: DataFrame, reference: DataFrame, subjects: DataFrame, key: str, comparison: str, *, below: DataFrame | None = None, scheme: DataFrame | None = None, tested_closed: Column, reference_closed: Column, negated: bool = False) -> DataFrame:
    """key, value, diagnostic, closures: a subject's tested values against its reference values.

    ``tested``: key, offered; ``reference``: key, reference; ``subjects``: key and what the closed
    columns read. ``below`` (desc, anc) makes the comparison hierarchical: a value is found at or
    below a reference value; values outside ``scheme`` (concept) are then undecided. A value that is
    not found is denied only if the reference set is closed. Subset reads every value, Intersects
    some value, Disjoint some value negated, under the tested set's closure; a subject without
    values is undecided. ``closures`` names those that the decision relied on.
    """
    if comparison not in ("Subset", "Intersects", "Disjoint"):
        raise ValueError(f"unknown comparison {comparison}")
    offered = tested.select(key, "offered").distinct()
    if below is None:
        ways = offered.select(key, "offered", F.col("offered").alias("_at"))
    else:
        up = below.where("desc <> anc").select(F.col("desc").alias("offered"), F.col("anc").alias("_at"))
        ways = offered.select(key, "offered", F.col("offered").alias("_at")).unionByName(offered.join(up, "offered").select(key, "offered", "_at"))
    hits = ways.join(reference.select(key, F.col("reference").alias("_at")), [key, "_at"]).select(key, "offered").distinct().withColumn("_found", F.lit(True))
    flags = subjects.select(key, tested_closed.alias("_closed"), reference_closed.alias("_fixed"))
    values = offered.join(hits, [key, "offered"], "left").join(flags.select(key, "_fixed"), key)
    placed = F.lit(True)
    if below is not None and scheme is not None:
        values = values.join(scheme.select(F.col("concept").alias("offered"), F.lit(True).alias("_placed")).distinct(), "offered", "left")
        placed = F.coalesce("_placed", F.lit(False))
    found = F.coalesce("_found", F.lit(False))
    value = F.when(~placed, F.lit(None)).when(found, True).when(F.col("_fixed"), False)
    counted = values.select(key, value.alias("v"), (~placed).alias("out")).groupBy(key).agg(F.count_if("v").alias("p"), F.count_if(~F.col("v")).alias("d"), F.count_if(F.col("v").isNull()).alias("u"), F.count_if("out").alias("out"))
    j = flags.join(counted, key, "left")
    none = F.col("p").isNull()
    p, d, u = (F.coalesce(c, F.lit(0)) for c in ("p", "d", "u"))
    if comparison == "Subset":
        read = F.when(d > 0, False).when(~none & (u == 0) & F.col("_closed"), True)
        tested_used, reference_used = (d == 0) & (u == 0) & ~none & F.col("_closed"), d > 0
    else:
        read = F.when(p > 0, True).when(~none & (u == 0) & F.col("_closed"), False)
        tested_used = (p == 0) & (u == 0) & ~none & F.col("_closed")
        reference_used = tested_used
    why = F.when(none, "MissingCandidate").when(read.isNull() & (F.col("out") > 0), "OutsideScheme").when(read.isNull(), "NoClosureLicence")
    swapped = (comparison == "Disjoint") != negated
    closures = F.concat_ws(" ", F.when(reference_used, "reference"), F.when(tested_used, "tested"))
    return j.select(key, (~read if swapped else read).alias("value"), why.alias("diagnostic"), closures.alias("closures"))


def in_force(closures: DataFrame, at: Column) -> Column:
    """Whether a closure (columns closure, valid_from) holds at an instant: from its source's first day on, or always without one."""
    return closures["closure"].isNotNull() & (closures["valid_from"].isNull() | (closures["valid_from"] <= at))


def profile_refusals(conditions: DataFrame, known: tuple[str, ...] = ("AllRequired", "AnySufficient")) -> DataFrame:
    """profile, reason of profiles that cannot be evaluated. ``conditions``: profile, aggregation, condition (null: none), subject.

    A profile needs one known aggregation, a condition, and conditions that read one class of subjects.
    """
    g = conditions.groupBy("profile").agg(
        F.max(~F.coalesce(F.col("aggregation").isin(*known), F.lit(False))).alias("unknown"), F.count_distinct("aggregation").alias("aggregations"), F.count("condition").alias("n"), F.count_distinct(F.when(F.col("condition").isNotNull(), F.col("subject"))).alias("subjects")
    )
    reasons = F.array_compact(F.array(F.when(F.col("unknown") | (F.col("aggregations") > 1), "RefusedOperation"), F.when(F.col("n") == 0, "NoCondition"), F.when(F.col("subjects") > 1, "MixedSubjects")))
    return g.select("profile", F.explode(reasons).alias("reason"))


def positive_rules(facts: DataFrame, rules: list[tuple[str, list[Column], bool]]) -> DataFrame:
    """rule and the columns of facts for each rule whose body holds; the rows that a decision permits.

    Rules say what is permitted only: a body of conditions that all hold. A negated rule is refused.
    """
    for name, body, negated in rules:
        if negated or not body:
            raise ValueError(f"rule {name} is negated or has no body")
    hold = []
    for name, body, _ in rules:
        both = body[0]
        for c in body[1:]:
            both = both & c
        hold.append(F.when(both, F.lit(name)))
    return facts.withColumn("rule", F.explode(F.array_compact(F.array(*hold))))


def relation_of(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """How the closed interval a stands to b: equal, within, contains, disjoint or overlaps."""
    return (
        F.when((a_lo == b_lo) & (a_hi == b_hi), "equal").when((a_lo >= b_lo) & (a_hi <= b_hi), "within").when((a_lo <= b_lo) & (a_hi >= b_hi), "contains").when((a_hi < b_lo) | (b_hi < a_lo), "disjoint").otherwise("overlaps")
    )
