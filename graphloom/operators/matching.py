"""Ranking, similarity, co-occurrence and evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import checkpointed

from .relational import top_k


def bm25(queries: DataFrame, targets: DataFrame, k: int, matches: dict[str, tuple[str, ...]], k1: float = 1.2, b: float = 0.75, step: float = 0.1) -> DataFrame:
    """query, target, score, rank of the best k targets of the kinds that a query's kind can match. Inputs: id, kind, words (array).

    ``matches`` names those kinds, the likeliest first; each step down the list costs ``step`` of the
    score. Frequencies and lengths are of the pool of targets that a kind of query can match. The
    words are read once, and the lengths of all targets are observed on the way. Targets with the same asked terms as often
    in texts of equal length are one class, kept in the checkpoint folder, and so are queries of the same terms: a class meets
    a class once, by an equi-join on terms, and of a class the k least ids count.
    """
    kinds = sorted({x for xs in matches.values() for x in xs})
    each = queries.select(F.col("id").alias("query"), F.col("kind").alias("source"), F.explode(F.array_distinct("words")).alias("term")).distinct()
    each = checkpointed(each.groupBy("query", "source").agg(F.array_sort(F.collect_list("term")).alias("terms")))
    askers = checkpointed(each.groupBy("source", "terms").agg(F.min("query").alias("asker")))
    asked = askers.select("asker", "source", F.explode("terms").alias("term"))
    seen = Observation()
    counted = targets.where(F.col("kind").isin(*kinds)).withColumn("len", F.size("words"))
    counted = counted.observe(seen, *[f(F.when(F.col("kind") == x, v)).alias(f"{name}{i}") for i, x in enumerate(kinds) for name, f, v in (("n", F.count, F.col("len")), ("s", F.sum, F.col("len")))])
    terms = counted.select("id", "kind", "len", F.explode("words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    postings = terms.groupBy("id", "kind", "len", "term").agg(F.count("*").alias("tf"))
    profiles = checkpointed(postings.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("len", "term", "tf"))).alias("profile")))  # asked terms of one target
    classes = checkpointed(profiles.groupBy("kind", "profile").agg(F.min("id").alias("least"), F.count("*").alias("members")))
    found = seen.get
    pools = []
    for source, of in matches.items():
        n = sum(found[f"n{kinds.index(x)}"] or 0 for x in of)
        pools += [(source, x, 1 - step * i, n, (sum(found[f"s{kinds.index(x)}"] or 0 for x in of) / n or 1.0) if n else 1.0) for i, x in enumerate(of)]
    pool = F.broadcast(queries.sparkSession.createDataFrame(pools, "source string, kind string, likely double, n long, mean double"))  # a row for each pair of kinds
    held = classes.select("kind", "least", "members", F.inline("profile"))
    df = held.groupBy("kind", "term").agg(F.sum("members").alias("df")).join(pool.select("source", "kind"), "kind").groupBy("source", "term").agg(F.sum("df").alias("df"))
    weighed = asked.join(df, ["source", "term"]).join(pool, "source")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = weighed.join(held, ["kind", "term"]).groupBy("asker", "source", "kind", "least", "likely").agg(F.sum(idf * norm).alias("s"))
    scored = scored.select("asker", "source", "kind", "least", F.round(F.col("s") * F.col("likely"), 4).alias("score")).where("score > 0")
    best = checkpointed(top_k(scored, ["asker", "source"], [F.col("score").desc(), F.col("least")], k).drop("rank"))  # a better class has a member at least
    wanted = classes.join(best.select("kind", "least").distinct(), ["kind", "least"]).select("kind", "least", "profile")
    ids = top_k(profiles.join(wanted, ["kind", "profile"]).select("kind", "least", F.col("id").alias("target")), ["kind", "least"], [F.col("target")], k).drop("rank")
    ranked = top_k(best.join(ids, ["kind", "least"]), ["asker", "source"], [F.col("score").desc(), F.col("target")], k)
    return ranked.join(each.join(askers, ["source", "terms"]).select("asker", "source", "query"), ["asker", "source"]).select("query", "target", "score", "rank")


def entry_words(fields: list[tuple[Column, int]]) -> Column:
    """The words of an entry for ranking: those of each field (an array, null as empty) so many times, as label and aliases say more than a definition."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(words, none) for words, times in fields for _ in range(times)])


def reciprocal_rank_fusion(rankings: list[DataFrame], c: int = 60) -> DataFrame:
    """query, target, score summed over rankings (query, target, rank)."""
    out = rankings[0].select("query", "target", "rank")
    for r in rankings[1:]:
        out = out.unionByName(r.select("query", "target", "rank"))
    return out.groupBy("query", "target").agg(F.round(F.sum(1 / (F.lit(float(c)) + F.col("rank"))), 8).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; null if one has no length."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def cooccurrence(observations: DataFrame, section: str, concept: str) -> DataFrame:
    """a < b, n, weight: sections with both over the smaller number of sections with one (overlap coefficient)."""
    obs = observations.select(F.col(section).alias("s"), F.col(concept).alias("c")).distinct()
    degree = obs.groupBy("c").agg(F.count("*").alias("deg"))
    pairs = obs.alias("x").join(obs.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.c") < F.col("y.c"))).groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(F.count("*").alias("n"))
    da, db = degree.select(F.col("c").alias("a"), F.col("deg").alias("da")), degree.select(F.col("c").alias("b"), F.col("deg").alias("db"))
    return pairs.join(da, "a").join(db, "b").select("a", "b", "n", F.round(F.col("n") / F.least("da", "db"), 6).alias("weight"))


def posteriors(logs: DataFrame, keys: list[str], log_score: str) -> DataFrame:
    """Normalised exponentials of log scores within keys, by the log-sum-exp shift."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(log_score) - F.max(log_score).over(w))
    return logs.withColumn("posterior", e / F.sum(e).over(w))


def recognised(fields: DataFrame, concepts: list[str], embed: Callable[[Column], Column]) -> DataFrame:
    """field, concept, score: the concept whose embedding is nearest, its cosine mapped to 0 to 1; the name breaks ties.

    ``embed`` makes a vector (array of doubles) from a text column; ``concepts`` is a declared list.
    """
    pairs = fields.select("field", embed(F.col("field")).alias("_x"), F.explode(F.array(*[F.lit(c) for c in concepts])).alias("concept"))
    score = F.round((1 + cosine(F.col("_x"), embed(F.col("concept")))) / 2, 6)
    return top_k(pairs.select("field", "concept", score.alias("score")), ["field"], [F.col("score").desc(), F.col("concept")], 1).select("field", "concept", "score")


def correction_rules(reviews: DataFrame, recurring: int) -> DataFrame:
    """rule, times, mappings of corrections and rejections that recur. ``reviews``: mapping, wrote, decision, kept."""
    corrected = reviews.where("decision = 'Corrected' and wrote <> kept").select("mapping", F.concat(F.lit("Instead of "), "wrote", F.lit(", write "), "kept").alias("rule"))
    rejected = reviews.where("decision = 'Rejected'").select("mapping", F.concat(F.lit("Do not write "), "wrote").alias("rule"))
    return corrected.unionByName(rejected).groupBy("rule").agg(F.count("*").alias("times"), F.count_distinct("mapping").alias("mappings")).where(F.col("times") >= recurring)


# What each kind of evidence weighs, and the score of an infeasible candidate.
EVIDENCE = {"name_match": 1.5, "embedding": 1.0, "type_compatibility": 0.8, "distortion": 0.7, "structural": 0.3, "prior": 0.2, "community": 1.8, "projection": 2.5}
INFEASIBLE = -1000.0


def evidence(signals: dict[str, Column], feasible: Column, properties: int = 15) -> Column:
    """Log score of a candidate from eight signals; INFEASIBLE where types cannot meet or the axioms forbid it.

    Similarities, compatibility and the prior count by their logarithm, distortion, structure and
    community as they are, a projection by its confidence over a chance among ``properties``. A
    signal that is 0 or missing says nothing, but the prior, which has a floor, always counts.
    """

    def logged(name: str) -> Column:
        x = F.coalesce(signals[name], F.lit(0.0))
        return F.when(x > 0, EVIDENCE[name] * F.log(x)).otherwise(0.0)

    def linear(name: str) -> Column:
        return EVIDENCE[name] * F.greatest(F.coalesce(signals[name], F.lit(0.0)), F.lit(0.0))

    fits = F.coalesce(signals["type_compatibility"], F.lit(1.0))
    projection = F.coalesce(signals["projection"], F.lit(0.0))
    total = (
        logged("name_match") + logged("embedding") + F.when(fits < 1, EVIDENCE["type_compatibility"] * F.log(fits)).otherwise(0.0) + linear("distortion") + linear("structural")
        + EVIDENCE["prior"] * F.log(F.greatest(F.coalesce(signals["prior"], F.lit(0.0)), F.lit(1e-10))) + linear("community") + F.when(projection > 0, EVIDENCE["projection"] * (F.log(projection) + F.log(F.lit(float(properties))))).otherwise(0.0)
    )
    return F.when((fits <= 0) | ~feasible, F.lit(INFEASIBLE)).otherwise(total)


def recognise(fields: DataFrame, concepts: list[str], strategies: dict[str, tuple[float, Callable[[Column, Column], Column]]], k: int) -> DataFrame:
    """field, concept, strategy, score, rank of the best k concepts of a declared list for each field.

    A strategy is a weight and a similarity of two texts; a concept has the score of the best one,
    the first in the list among equals.
    """
    pairs = fields.select("field", F.explode(F.array(*[F.lit(c) for c in concepts])).alias("concept"))
    tried = [F.struct(F.round(weight * similar(F.col("field"), F.col("concept")), 6).alias("score"), F.lit(-i).alias("turn"), F.lit(name).alias("strategy")) for i, (name, (weight, similar)) in enumerate(strategies.items())]
    best = pairs.withColumn("_b", F.array_max(F.array(*tried))).select("field", "concept", "_b.strategy", "_b.score").where("score > 0")
    return top_k(best, ["field"], [F.col("score").desc(), F.col("concept")], k)
