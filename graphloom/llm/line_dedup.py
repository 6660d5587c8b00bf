"""Line de-duplication by site-relative frequency, in DataFrame operations only.

For each host the pages that contain a line are counted and divided by the pages of the host;
lines over the boilerplate ratio are dropped. Pages with equal text count as one page, so that a
group of copies does not turn its own lines into boilerplate. A page that would lose almost all
of its characters is a copy of other pages rather than furniture and stays whole.

The text crosses the network once, with the hashes of its own dropped lines; counting shuffles
128-bit hashes after partial aggregation, so that a frequent line or a large host costs a row for
each task.

Results for odd inputs: a null text stays null with 0 lines; blank lines are neither counted nor
dropped; a null host is a host of its own; lines compare after trimming blanks; repeated rows are
repeated in the result; a null id is kept; an empty table gives no rows; extra columns pass,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, whole

#: Share of a host's pages above which a line is boilerplate, and the pages it must be on at least.
RATIO = 0.01
LEAST_PAGES = 5
#: A page that keeps less than this share of its characters is left whole.
KEPT_SHARE = 0.2


#: Boilerplate lines of all hosts up to which their hashes (16 bytes each) are broadcast.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """_host, _line (the line's hash), pages and host_pages of each line over the ratio."""
    pages = docs.where(F.col("text").isNotNull()).select(column(host).alias("_host"), _key(F.col("text")).alias("_page"), F.array_distinct(F.transform(F.split("text", "\n"), F.trim)).alias("_lines"))
    totals = pages.select(F.col("_host").alias("_site"), "_page").distinct().groupBy("_site").agg(F.count("*").alias("host_pages"))
    lines = pages.select("_host", "_page", F.explode("_lines").alias("_line")).where("_line <> ''").select("_host", _key(F.col("_line")).alias("_line"), "_page")
    often = lines.groupBy("_host", "_line").agg(F.count_distinct("_page").alias("pages")).where(F.col("pages") >= least_pages)
    return often.join(totals, F.col("_host").eqNullSafe(F.col("_site"))).where(F.col("pages") > ratio * F.col("host_pages")).drop("_site")


def cleaned(docs: DataFrame, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, kept_share: float = KEPT_SHARE) -> DataFrame:
    """doc (all columns of docs as a struct), text without boilerplate lines, n_lines, n_dropped.

    A host has at most (lines of its mean page) / ratio boilerplate lines, so that their hashes
    fit one array for each host.
    """
    marked = checkpointed(boilerplate(docs, host, ratio, least_pages).groupBy("_host").agg(F.collect_set("_line").alias("_drop")).withColumnRenamed("_host", "_site"))
    if (marked.agg(F.sum(F.size("_drop"))).first()[0] or 0) <= BROADCAST_LINES:
        marked = F.broadcast(marked)
    rows = docs.select(whole(docs), column(host).alias("_host"), F.split("text", "\n").alias("_lines"))
    joined = rows.join(marked, F.col("_host").eqNullSafe(F.col("_site")), "left")
    split = joined.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda line: ~F.array_contains("_drop", _key(F.trim(line))))))
    split = split.withColumn("_short", F.array_join("_kept", "\n"))
    text = F.col("doc.text")
    stays = F.length("_short") < kept_share * F.length(text)
    return split.select(
        "doc",
        F.when(stays, text).otherwise(F.col("_short")).alias("text"),
        F.coalesce(F.size("_lines"), F.lit(0)).alias("n_lines"),
        F.when(stays | text.isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).alias("n_dropped"),
    )


def without_boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, kept_share: float = KEPT_SHARE) -> DataFrame:
    """All columns of docs, the column text without boilerplate lines, and n_lines, n_dropped, which replace columns of those names."""
    found = cleaned(docs, host, ratio, least_pages, kept_share)
    own = [F.col("text").alias(c) if c == "text" else column(c, "doc").alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return found.select(*own, "n_lines", "n_dropped")


def oracle_sql(host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, kept_share: float = KEPT_SHARE) -> str:
    """DuckDB SQL for doc_id, host, text, n_lines and n_dropped over documents."""
    return f"""
WITH page AS (SELECT DISTINCT {host} AS host, text FROM documents WHERE text IS NOT NULL),
total AS (SELECT host, count(*) AS host_pages FROM page GROUP BY host),
line AS (SELECT DISTINCT host, text, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))) AS line FROM page),
often AS (SELECT host, line, count(*) AS pages FROM line WHERE line <> '' GROUP BY host, line HAVING count(*) >= {least_pages}),
marked AS (SELECT o.host, list(o.line) AS bad FROM often o JOIN total t ON o.host IS NOT DISTINCT FROM t.host
           WHERE o.pages > {ratio} * t.host_pages GROUP BY o.host),
kept AS (SELECT d.doc_id, d.{host} AS host, d.text, string_split(d.text, chr(10)) AS lines,
                list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(m.bad, CAST([] AS VARCHAR[])), trim(x, ' '))) AS good
         FROM documents d LEFT JOIN marked m ON d.{host} IS NOT DISTINCT FROM m.host),
cut AS (SELECT *, array_to_string(good, chr(10)) AS short FROM kept)
SELECT doc_id, host AS {host}, CASE WHEN length(short) < {kept_share} * length(text) THEN text ELSE short END AS text,
       CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines,
       CAST(CASE WHEN text IS NULL OR length(short) < {kept_share} * length(text) THEN 0 ELSE len(lines) - len(good) END AS INTEGER) AS n_dropped
FROM cut"""
