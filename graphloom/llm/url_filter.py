"""URL filters by link-graph propagation, in DataFrame operations only.

Rules decide the urls they fit. For the others the verdict is their host's: trust is a
personalised PageRank over host links from hosts with allowed pages, distrust one over the
reversed links (who links to the blocked is suspect) from hosts with blocked pages. A host's seed
is the share of its pages that rules allow or block. Walks end at hosts without a link. A host is
blocked if its distrust exceeds its trust and is at least THRESHOLD times the mean of all hosts.
Links are the absolute and protocol-relative ``href`` targets in the html, each host pair once
with the number of pages; a host's links to itself don't count.

Results for odd inputs: a null url, or one without ``://``, has empty host and path, fits no rule
and is allowed; null html has no links; repeated rows are repeated in the result; among rules of
equal length the one with the longer host wins, then allow; a null id is kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# The rules (verdict, host and path) in the order they were given.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
DAMPING = 0.85
ITERATIONS = 12
THRESHOLD = 1.0
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct with the fields rule and verdict, or null."""
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(len(name)).alias("host"), F.lit(int(verdict == "allow")).alias("allow"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits, *fits[: 2 - len(fits)]) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def host_scores(judged: DataFrame) -> DataFrame:
    """host, trust and distrust of each host. ``judged``: host, html and verdict (null without a rule) of pages."""
    pages = judged.where("host <> ''")
    seeds = pages.groupBy("host").agg(F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst")).where("src <> dst")
    links = checkpointed(links.groupBy("src", "dst").agg(F.count("*").alias("n")))
    nodes = seeds.unionByName(links.select(F.col("dst").alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))).groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    nodes = checkpointed(nodes)
    total = nodes.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    nodes = nodes.select("host", (F.col("good") / (total["good"] or 1.0)).alias("good"), (F.col("bad") / (total["bad"] or 1.0)).alias("bad"))
    state = nodes.select("host", "good", "bad", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    outs = links.groupBy("src").agg(F.sum("n").alias("n_out"))
    ins = links.groupBy("dst").agg(F.sum("n").alias("n_in"))
    shares = checkpointed(links.join(outs, "src").join(ins, "dst").select("src", "dst", (F.col("n") / F.col("n_out")).alias("forth"), (F.col("n") / F.col("n_in")).alias("back")))
    if shares.isEmpty():
        return state.select("host", ((1 - DAMPING) * F.col("trust")).alias("trust"), ((1 - DAMPING) * F.col("distrust")).alias("distrust"))
    for k in range(ITERATIONS):
        to = shares.join(state.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        fro = shares.join(state.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        got = to.unionByName(fro).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        state = nodes.join(got, "host", "left").select("host", "good", "bad", ((1 - DAMPING) * F.col("good") + DAMPING * F.coalesce("t", F.lit(0.0))).alias("trust"), ((1 - DAMPING) * F.col("bad") + DAMPING * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        if k % 3 == 2:
            state = checkpointed(state)
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    judged = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "html", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict"))
    scores = checkpointed(host_scores(judged))
    mean = scores.agg(F.avg("distrust")).first()[0] or 0.0
    scores = scores.withColumn("own", F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= THRESHOLD * mean * (1 - 1e-9)), "block").otherwise("allow"))
    joined = judged.drop("html").join(scores, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", "own", F.lit("allow")).alias("verdict"), "trust", "distrust")


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """DuckDB SQL for page_id, host, path, rule and verdict over pages."""
    low = "translate({}, '" + _UPPER + "', '" + _LOWER + "')"
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{'/' + r.partition('/')[2]}')" for v, r in rules)
    link = _LINK.replace("'", "''")
    steps = []
    for k in range(ITERATIONS):
        steps.append(f"""
s{k + 1} AS MATERIALIZED (SELECT n.host, n.good, n.bad,
  {1 - DAMPING!r} * n.good + {DAMPING!r} * coalesce((SELECT sum(s.trust * e.forth) FROM share e JOIN s{k} s ON s.host = e.src WHERE e.dst = n.host), 0) AS trust,
  {1 - DAMPING!r} * n.bad + {DAMPING!r} * coalesce((SELECT sum(s.distrust * e.back) FROM share e JOIN s{k} s ON s.host = e.dst WHERE e.src = n.host), 0) AS distrust
  FROM node n)""")
    return f"""
WITH rest AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
part AS (SELECT page_id, html, coalesce({low.format("regexp_extract(r, '^([^/?#]*)', 1)")}, '') AS host,
                coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS id FROM rest),
rules(verdict, rule, name, start) AS (VALUES {values}),
fit AS (SELECT p.id, arg_max({{'rule': r.rule, 'verdict': r.verdict}}, length(r.rule) * 1000000 + length(r.name) * 10 + CAST(r.verdict = 'allow' AS INTEGER)) AS f
        FROM part p JOIN rules r ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.start) GROUP BY p.id),
judged AS MATERIALIZED (SELECT p.*, f.f.rule AS rule, f.f.verdict AS verdict FROM part p LEFT JOIN fit f USING (id)),
seed AS (SELECT host, avg(CAST(coalesce(verdict = 'allow', false) AS INTEGER)) AS good, avg(CAST(coalesce(verdict = 'block', false) AS INTEGER)) AS bad
         FROM judged WHERE host <> '' GROUP BY host),
target AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {low.format("x")}))) AS dst FROM judged WHERE host <> ''),
edge AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM target WHERE src <> dst GROUP BY src, dst),
every AS MATERIALIZED (SELECT host, max(good) AS good, max(bad) AS bad FROM (SELECT * FROM seed UNION ALL SELECT dst, 0.0, 0.0 FROM edge) GROUP BY host),
node AS MATERIALIZED (SELECT host, good / coalesce(nullif((SELECT sum(good) FROM every), 0), 1) AS good,
                             bad / coalesce(nullif((SELECT sum(bad) FROM every), 0), 1) AS bad FROM every),
share AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM edge),
s0 AS (SELECT host, good, bad, good AS trust, bad AS distrust FROM node),{",".join(steps)}
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.verdict, CASE WHEN s.distrust > s.trust AND s.distrust >= {THRESHOLD} * (1 - 1e-9) * (SELECT avg(distrust) FROM s{ITERATIONS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN s{ITERATIONS} s ON j.host = s.host"""
