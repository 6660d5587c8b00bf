"""Short forms of words, learned from confirmed pairs of names, and what names they may stand for.

The words of a short and a long name are aligned in order: two words meet if they are equal, or if the short one is a
short form of the long one (its letters in order, the first letter first); the alignment with the most met words,
then the most letters, counts. All of it is columns: alignments are folds over arrays of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that one name is expanded to at most.
VARIANTS = 50


def is_short_form(short: Column, long: Column) -> Column:
    """Whether ``short`` is a true short form of ``long``: fewer letters, the same first, all in order (by a pattern of them)."""
    letters = F.regexp_replace(short, r"([^A-Za-z0-9])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(letters, r"(\\?.)", "$1.*"), F.lit("$"))
    return (F.length(short) < F.length(long)) & (F.length(short) > 1) & F.call_function("rlike", long, pattern)


def aligned(short: Column, long: Column) -> Column:
    """Array of (short, long) of words that meet and differ, in the best alignment of two arrays of words.

    A fold over the long words keeps, for each number of short words used, the best alignment so far.
    """
    state = "struct<met: int, letters: int, pairs: array<struct<short: string, long: string>>>"
    none = F.struct(F.lit(0).alias("met"), F.lit(0).alias("letters"), F.array().cast("array<struct<short: string, long: string>>").alias("pairs")).cast(state)
    start = F.transform(F.sequence(F.lit(0), F.size(short)), lambda i: none)

    def better(a: Column, b: Column) -> Column:
        return F.when((b["met"] > a["met"]) | ((b["met"] == a["met"]) & (b["letters"] > a["letters"])), b).otherwise(a)

    def over(best: Column, word: Column) -> Column:
        """Best alignments with this long word too, from those without: from left to right over the short words."""

        def step(done: Column, i: Column) -> Column:
            own = F.get(short, i)
            before = F.get(best, i)
            meets = (own == word) | is_short_form(own, word)
            pair = F.when(own == word, before["pairs"]).otherwise(F.concat(before["pairs"], F.array(F.struct(own.alias("short"), word.alias("long")))))
            joined = F.struct((before["met"] + 1).alias("met"), (before["letters"] + F.length(own)).alias("letters"), pair.alias("pairs")).cast(state)
            without = better(F.get(best, i + 1), F.element_at(done, -1))
            return F.concat(done, F.array(F.when(meets, better(without, joined)).otherwise(without)))

        return F.aggregate(F.when(F.size(short) > 0, F.sequence(F.lit(0), F.size(short) - 1)).otherwise(F.array().cast("array<int>")), F.array(F.get(best, F.lit(0))), step)

    return F.element_at(F.aggregate(long, start, over), -1)["pairs"]


def learn(pairs: DataFrame, least: int = 2) -> DataFrame:
    """short, long, n, share of the short forms in confirmed pairs (short, long: arrays of words), seen ``least`` times or more.

    ``share`` is how often the short form stood for this word.
    """
    seen = pairs.select(F.explode(aligned(F.col("short"), F.col("long"))).alias("p")).groupBy(F.col("p.short").alias("short"), F.col("p.long").alias("long")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("short"))
    return seen.withColumn("share", F.round(F.col("n") / total, 6)).where(F.col("n") >= least)


def expanded(names: DataFrame, key: str, words: str, learned: DataFrame, most: int = VARIANTS) -> DataFrame:
    """key, variant: names with their words as they are or replaced by what they may be short for; the ``most`` likeliest, then first.

    A word's choices are joined once; a name's variants are built word by word and cut to ``most`` at each, so that they
    never multiply out.
    """
    choices = learned.groupBy("short").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("less"), F.col("long").alias("word")))).alias("choices"))  # the words of one short form
    each = names.select(key, F.posexplode(words).alias("at", "word")).join(choices, F.col("word") == F.col("short"), "left")
    own = F.struct(F.lit(-1.0).alias("less"), F.col("word").alias("word"))
    each = each.select(key, "at", F.concat(F.array(own), F.coalesce("choices", F.array().cast("array<struct<less: double, word: string>>"))).alias("options"))
    rows = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "options"))).alias("w"))  # one name's words

    def grow(found: Column, word: Column) -> Column:
        joined = F.flatten(F.transform(found, lambda f: F.transform(word["options"], lambda o: F.struct((f["score"] * o["less"] * -1.0).alias("score"), F.concat_ws(" ", f["text"], o["word"]).alias("text")))))
        # Scores are negative products of shares: the least is the likeliest.
        return F.slice(F.array_sort(joined), 1, most)

    start = F.array(F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("text")))
    return rows.select(key, F.explode(F.aggregate("w", start, grow)).alias("v")).select(key, F.col("v.text").alias("variant"))
