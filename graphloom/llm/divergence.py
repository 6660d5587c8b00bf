"""Source divergence audit: how far the term use of the sources of a language lies apart.

Terms are runs of letters (ASCII, lower-cased, and all that is not ASCII). A language keeps the terms
in at least LEAST_DOCS of its documents, V of them. A group, a source of a language, gives each kept term
the share p = 1 + 10**9 * (count + 1) div (N + V), N its counts' sum. The divergence of shares p from q
at a term is (p - q)**2 div q. All of it is in integers, so results are exact.

* Part ``pair``: for each other source of the language the sum of the divergences over all V terms.
  Most terms are in neither source, and there both have their base share (of count 0). So the sum is V
  times the divergence of the bases, plus a correction for terms of one source, from each source's
  histogram of shares, plus one for terms of both, from a join on the term. Only terms that occur are met.
* Part ``term``: the TOP terms that a group has and uses more than its language, by ``radix_top``: histograms
  of 16 bits of the value at a time, counted where the rows are, find each group's threshold; values
  equal to it are told apart by two bytes of their UTF-8 text at a time. No group is sorted or collected.

Results for odd inputs: null text, lang and source count as empty strings, which make groups of their own;
a group without terms has its pairs (value 0 if V is 0) and no terms; a lang of one source has no
pairs; repeated rows count each; an empty table gives no rows; other columns are ignored. The
longest text bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, scratch
from .textvec import LETTER_BYTES, chunks, terms_of, utf8

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Text that is counted in one go, in bytes.
_PART = 8 << 20
_BITS = 16
_EXACT = "decimal(38,0)"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), added up by parts of a task's rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for i, j in chunks(offsets, _PART):
                words, term, doc = terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LETTER_BYTES)
                if not len(term):
                    continue
                pairs, n = np.unique(doc * len(words) + term, return_counts=True)
                doc, term = np.divmod(pairs, len(words))
                cells, at, docs = np.unique(group[i:j][doc] * len(words) + term, return_inverse=True, return_counts=True)
                of, term = np.divmod(cells, len(words))
                of_lang, of_source = np.divmod(of, len(source.dictionary))
                total = np.bincount(at, n, len(cells)).astype(np.int64)  # sums below 2**53
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of_lang)), source.dictionary.take(pa.array(of_source)), words.take(pa.array(term)).cast(pa.string()), pa.array(total), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    return _texts(docs).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def share(count: Column, n: Column, v: Column) -> Column:
    """The share of ``count`` of n occurrences over v terms; beyond 64 bits by decimals."""
    total = F.greatest(n + v, F.lit(1))
    far = F.call_function("div", F.lit(SCALE).cast(_EXACT) * (count + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))
    return F.lit(1) + F.when(count < 9_000_000_000, F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total)).otherwise(far)


def divergence(p: Column, q: Column) -> Column:
    """(p - q)**2 div q; below 2**60, as shares are at most 10**9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def radix_top(rows: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The rows (``groups``, item, value) of each group's ``k`` largest values, equal ones by the item's UTF-8 bytes.

    ``value`` is a long of 0 or more, ``item`` a string that a group has once (ValueError where one that is open to the
    end comes twice), without U+0000. Each round counts
    a digit of the rows whose place is open, takes those above the digit at which the k-th place
    falls, drops those below it, and leaves that digit's rows open unless all of them have a place.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    rows.select(*groups, "item", "value", F.lit(k).cast("long").alias("left"), F.lit(True).alias("open")).write.parquet(f"{folder}/rows")
    found, won = spark.read.parquet(f"{folder}/rows"), []
    falling = [F.shiftright("value", s).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")) for s in range(48, -1, -_BITS)]
    at = 0
    while True:
        if at < len(falling):
            digit, order = falling[at], F.col("digit").desc()
        else:
            place = 2 * (at - len(falling))
            if place > found.where("open").agg(F.max(F.octet_length("item"))).first()[0]:
                raise ValueError("a group has an item twice")
            byte = F.substring(F.encode("item", "UTF-8"), place + 1, 2)
            digit, order = F.conv(F.rpad(F.hex(byte), 4, "0"), 16, 10).cast("long"), F.col("digit").asc()
        digits = found.where("open").withColumn("digit", digit)
        above = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # 65,536 digits at most
        counts = digits.groupBy(*groups, "left", "digit").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        places = counts.where("above < left").select(*groups, "digit", (F.col("left") - F.col("above")).alias("_left"), (F.col("above") + F.col("n") > F.col("left")).alias("_open"))
        digits.join(places, [*groups, "digit"]).select(*groups, "item", "value", F.col("_left").alias("left"), F.col("_open").alias("open")).write.parquet(f"{folder}/{at}")
        found = spark.read.parquet(f"{folder}/{at}")
        won.append(f"{folder}/{at}")
        at += 1
        if found.where("open").isEmpty():
            break
    return spark.read.parquet(*won).where("not open").select(*groups, "item", "value")


def _pair_values(kept: DataFrame, profiles: DataFrame) -> DataFrame:
    """lang, source, item (the other source) and value of all pairs of sources of a language."""
    own = profiles.select("lang", "source", "v", F.col("base").alias("own"))
    other = profiles.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    pairs = own.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v").cast("decimal(20,0)") * divergence(F.col("own"), F.col("other")).cast("decimal(20,0)")).cast(_EXACT).alias("value"))

    def both(there: Column, back: Column, times: Column) -> Column:
        """Corrections of source to item and of item to source."""
        exact = [(x.cast("decimal(20,0)") * times.cast("decimal(18,0)")).cast(_EXACT) for x in (there, back)]
        return F.inline(F.array(F.struct("source", "item", exact[0].alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), exact[1].alias("value"))))

    shares = kept.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("terms")).withColumnRenamed("base", "own").join(other, "lang").where("source <> item")
    p, a, b = F.col("p"), F.col("own"), F.col("other")
    single = shares.select("lang", both(divergence(p, b) - divergence(a, b), divergence(b, p) - divergence(b, a), F.col("terms")))

    left = kept.select("lang", "term", "source", "p", F.col("base").alias("own"))
    right = kept.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("base").alias("other"))
    q = F.col("q")
    there = divergence(p, q) - divergence(p, b) - divergence(a, q) + divergence(a, b)
    back = divergence(q, p) - divergence(q, a) - divergence(b, p) + divergence(b, a)
    # Sums of longs in two halves, which can't overflow: exact, and cheaper than decimals.
    halves = [f(x).alias(f"{n}_{h}") for n, x in (("there", there), ("back", back)) for h, f in (("high", lambda x: F.sum(F.shiftright(x, 32))), ("low", lambda x: F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF)))))]
    met = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(*halves)
    whole = [F.col(f"{n}_high").cast(_EXACT) * F.lit(1 << 32).cast("decimal(10,0)") + F.col(f"{n}_low").cast("decimal(20,0)") for n in ("there", "back")]
    met = met.select("lang", F.inline(F.array(F.struct("source", "item", whole[0].cast(_EXACT).alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), whole[1].cast(_EXACT).alias("value")))))
    return pairs.unionByName(single).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value and rank of the columns lang, source and text of ``docs``."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    common = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("n_lang"), F.row_number().over(of_term.orderBy("source")).alias("nth"))
    common.where(F.col("docs") >= least_docs).drop("docs").write.parquet(f"{folder}/common")
    common = spark.read.parquet(f"{folder}/common")
    languages = common.where("nth = 1").groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("all_lang"))
    sizes = common.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    zero = F.lit(0).cast("long")
    profiles = _texts(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(languages, "lang", "left")
    profiles = profiles.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("all", "v", "all_lang")])
    profiles = checkpointed(profiles.withColumn("base", share(zero, F.col("all"), F.col("v"))))
    kept = common.join(profiles, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("all"), F.col("v")))
    pairs = _pair_values(kept, profiles)
    q = share(F.col("n_lang"), F.col("all_lang"), F.col("v"))
    terms = radix_top(kept.where(F.col("p") > q).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), q).alias("value")), ["lang", "source"], top)
    parts = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")  # the other sources, or ``top`` terms
    return parts.withColumn("rank", F.row_number().over(order))


def oracle_sql(top: int = TOP, least_docs: int = LEAST_DOCS) -> str:
    """DuckDB SQL over documents: every kept term for every group, and all pairs of groups."""
    return f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM doc),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= {least_docs}),
language AS MATERIALIZED (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
used AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY ALL),
grp AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(u.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN used u USING (lang, source) GROUP BY ALL),
prob AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
  CAST(1 + (1000000000 * (coalesce(u.n, 0) + 1)) // (CAST(g.total AS BIGINT) + l.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS BIGINT) AS q
  FROM grp g JOIN language l USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN prob x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN prob y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
every AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pair
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM prob WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
