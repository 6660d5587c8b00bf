"""Communities of concepts and what sections make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import community, leiden, lift, matching, operations
from graphloom.sources.store import digest_bag, digest_bag_sql
from graphloom.sources.tables import QUADS, Tables

from .matching import COMM, COOC, communities_of, obs_of
from .registry import query

ROUNDS = 3
RESOLUTIONS = (0.8, 1.0, 1.2)


def turn(node: Column) -> Column:
    """The last character's code: whose turn it is to move."""
    return F.ascii(F.substring(node, -1, 1))


def moves_sql(tag: str, resolution: float) -> str:
    """CTEs up to ``{tag}{ROUNDS}`` (node, k, community) over the CTE w of weighted edges."""
    out = f"""{tag}near AS MATERIALIZED (SELECT a AS node, b AS other, weight FROM w UNION ALL SELECT b, a, weight FROM w), {tag}deg AS MATERIALIZED (SELECT node, sum(weight) AS k FROM {tag}near GROUP BY 1),
{tag}0 AS (SELECT node, k, node AS community FROM {tag}deg)"""
    for r in range(ROUNDS):
        out += f""", {tag}c{r} AS (SELECT node, community, sum(w) AS w FROM (SELECT n.node, s.community, n.weight AS w FROM {tag}near n JOIN {tag}{r} s ON s.node = n.other UNION ALL SELECT node, community, 0 FROM {tag}{r}) GROUP BY ALL),
{tag}g{r} AS (SELECT s.node, s.k, s.community AS was, c.community AS to_, round(c.w - {resolution} * s.k * (t.t - CASE WHEN c.community = s.community THEN s.k ELSE 0 END) / (SELECT sum(k) FROM {tag}deg), 9) AS gain
 FROM {tag}c{r} c JOIN {tag}{r} s ON s.node = c.node JOIN (SELECT community, sum(k) AS t FROM {tag}{r} GROUP BY 1) t ON t.community = c.community),
{tag}{r + 1} AS MATERIALIZED (SELECT node, k, CASE WHEN ascii(substr(node, -1)) % 2 = {r % 2} THEN to_ ELSE was END AS community FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, to_) AS place FROM {tag}g{r}) WHERE place = 1)"""
    return out


def quality_sql(tag: str) -> str:
    last = f"{tag}{ROUNDS}"
    return f"""{tag}kept AS (SELECT * FROM {last} WHERE community IN (SELECT community FROM {last} GROUP BY 1 HAVING count(*) >= 2)),
{tag}q AS (SELECT coalesce((SELECT sum(n.weight) FROM {tag}near n JOIN {tag}kept x ON x.node = n.node JOIN {tag}kept y ON y.node = n.other WHERE x.community = y.community), 0) / m2
 - coalesce((SELECT sum(k * k) FROM (SELECT sum(k) AS k FROM {tag}kept GROUP BY community)), 0) / (m2 * m2) AS modularity, (SELECT count(*) FROM {tag}kept) / nodes AS coverage FROM (SELECT sum(k) AS m2, count(*) AS nodes FROM {tag}deg))"""


@query(f"WITH {COOC}, {moves_sql('m', 1.0)} SELECT node, community FROM m{ROUNDS}")
def cluster_moves(t: Tables) -> DataFrame:
    """Communities of concepts by local moves."""
    return community.local_moves(matching.cooccurrence(obs_of(t), "s", "c"), ROUNDS, 1.0, turn)


@query(f"WITH {COOC}, {moves_sql('m', 1.0)}, {quality_sql('m')} SELECT round(modularity, 6) AS modularity, round(coverage, 6) AS coverage FROM mq")
def cluster_scores(t: Tables) -> DataFrame:
    edges = matching.cooccurrence(obs_of(t), "s", "c")
    return community.quality(edges, community.local_moves(edges, ROUNDS, 1.0, turn)).select(F.round("modularity", 6).alias("modularity"), F.round("coverage", 6).alias("coverage"))


SWEEP = ", ".join(f"{moves_sql('abc'[i], r)}, {quality_sql('abc'[i])}" for i, r in enumerate(RESOLUTIONS))
BEST = " UNION ALL ".join(f"SELECT {i} AS i, {r} AS resolution, round(modularity, 9) AS q FROM {'abc'[i]}q" for i, r in enumerate(RESOLUTIONS))
ALL = " UNION ALL ".join(f"SELECT {i} AS i, node, community FROM {'abc'[i]}{ROUNDS}" for i, _ in enumerate(RESOLUTIONS))


@query(f"WITH {COOC}, {SWEEP}, best AS (SELECT i, resolution FROM ({BEST}) ORDER BY q DESC, i LIMIT 1) SELECT node, community, CAST(resolution AS DOUBLE) AS resolution FROM ({ALL}) JOIN best USING (i)")
def cluster_sweep(t: Tables) -> DataFrame:
    """The communities of the resolution with the best modularity."""
    resolution, found = community.sweep(matching.cooccurrence(obs_of(t), "s", "c"), list(RESOLUTIONS), ROUNDS, turn)
    return found.withColumn("resolution", F.lit(float(resolution)))


@query()
def cluster_leiden(t: Tables) -> DataFrame:
    """Communities over levels of parts that are in orders together, weighted by the overlap coefficient."""
    return leiden.of_sections(t.lineitem.select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("c")))


TEMPLATES = "tpl AS (SELECT DISTINCT p_type || '/' || p_size % 10 AS template, p_brand AS c FROM part)"


def templates_of(t: Tables) -> DataFrame:
    return t.part.select(F.concat("p_type", F.lit("/"), (F.col("p_size") % 10).cast("string")).alias("template"), F.col("p_brand").alias("c")).distinct()


@query(f"""WITH {COMM}, {TEMPLATES}, size AS (SELECT template, count(*) AS size FROM tpl GROUP BY 1), h AS (SELECT s, template, count(*) AS hit FROM obs JOIN tpl USING (c) GROUP BY ALL),
r AS (SELECT s, template, round(hit / size, 6) AS coverage, size - hit AS missing, row_number() OVER (PARTITION BY s ORDER BY round(hit / size, 6) DESC, template) AS place FROM h JOIN size USING (template) WHERE round(hit / size, 6) >= 0.2)
SELECT s, template, coverage, missing FROM r WHERE place = 1""")
def template_coverage(t: Tables) -> DataFrame:
    return community.template_coverage(obs_of(t), templates_of(t), 0.2)


@query(f"""WITH {COMM}, m AS (SELECT s, comm, row_number() OVER (PARTITION BY s ORDER BY round(sum(p), 6) DESC, comm) AS place FROM obs JOIN wt USING (c) GROUP BY s, comm),
cand AS (SELECT s, token, concept, max(prior) AS prior FROM (SELECT l_orderkey AS s, l_linenumber AS token, p_brand AS concept, (p_size + 1) / 60.0 AS prior FROM lineitem JOIN part ON p_partkey = l_partkey
 UNION ALL SELECT l_orderkey, l_linenumber, 'Brand#11', 0.4 FROM lineitem) GROUP BY ALL),
x AS (SELECT cand.s, token, concept, round(ln(prior) + ln(greatest(coalesce(p, 0), 0.001)), 6) AS score FROM cand LEFT JOIN (SELECT s, comm FROM m WHERE place = 1) b USING (s) LEFT JOIN wt ON wt.comm = b.comm AND wt.c = concept),
r AS (SELECT *, row_number() OVER v AS place, lead(score) OVER v AS next FROM x WINDOW v AS (PARTITION BY s, token ORDER BY score DESC, concept))
SELECT s, token, concept, score, CASE WHEN next IS NULL OR score - next >= 0.5 THEN 'resolved' ELSE 'open' END AS status FROM r WHERE place = 1""")
def section_resolution(t: Tables) -> DataFrame:
    """Recognition, community and projection as evidence for the concept of each line of an order."""
    profiles = communities_of(t)
    best = community.matched(obs_of(t), profiles, 1).select("s", "comm")
    lines = t.lineitem.select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("token"), "l_partkey")
    recognised = lines.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("s", "token", F.col("p_brand").alias("concept"), ((F.col("p_size") + 1) / 60.0).alias("prior"))
    usual = lines.select("s", "token", F.lit("Brand#11").alias("concept"), F.lit(0.4).cast("double").alias("prior"))
    candidates = recognised.unionByName(usual).groupBy("s", "token", "concept").agg(F.max("prior").alias("prior"))
    return community.resolve_sections(candidates, best, profiles, 0.5)


@query(f"""WITH {COMM}, g AS (SELECT comm, count(*) AS n, sum(p) AS total, max(p) AS top, min(p) AS low FROM wt GROUP BY 1)
SELECT comm AS key, 'TooFewMembers' AS rule FROM g WHERE n < 30 UNION ALL SELECT comm, 'WeightsDontSum' FROM g WHERE abs(total - 1) > 0.000001 UNION ALL SELECT comm, 'OneDominates' FROM g WHERE top > 2.0 / n""")
def community_checks(t: Tables) -> DataFrame:
    """Well-formedness of community profiles, by rule."""
    g = communities_of(t).groupBy("comm").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.max("p").alias("top"))
    rules = {"TooFewMembers": F.col("n") < 30, "WeightsDontSum": F.abs(F.col("total") - 1) > 0.000001, "OneDominates": F.col("top") > 2.0 / F.col("n")}
    return operations.refused_rows(g, "comm", rules)


@query("""WITH f AS (SELECT DISTINCT p_name AS field FROM part), c(concept) AS (VALUES ('red widget'), ('blue gadget'), ('green bolt')),
v AS (SELECT field, concept, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(length(field) - length(replace(field, c, '')) AS DOUBLE)) AS x, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(length(concept) - length(replace(concept, c, '')) AS DOUBLE)) AS y FROM f, c),
s AS (SELECT field, concept, round((1 + list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))) / 2, 6) AS score FROM v)
SELECT field, concept, score FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, concept) AS r FROM s) WHERE r = 1""")
def text_recognise_embedded(t: Tables) -> DataFrame:
    """Recognition with a caller's embedding, here the counts of letters."""

    def letters(x: Column) -> Column:
        return F.transform(F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"]), lambda c: (F.length(x) - F.length(F.replace(x, c, F.lit("")))).cast("double"))

    fields = t.part.select(F.col("p_name").alias("field")).distinct()
    return matching.recognised(fields, ["red widget", "blue gadget", "green bolt"], letters)


@query("""WITH w AS (SELECT o_custkey % 97 AS mapping, CASE WHEN o_orderpriority < '3' THEN 'A' ELSE 'B' END AS wrote, CASE o_orderstatus WHEN 'F' THEN 'Corrected' WHEN 'P' THEN 'Rejected' ELSE 'Accepted' END AS decision, CASE WHEN o_totalprice > 250000 THEN 'C' ELSE 'B' END AS kept FROM orders)
SELECT 'Instead of ' || wrote || ', write ' || kept AS rule, count(*) AS times, count(DISTINCT mapping) AS mappings FROM w WHERE decision = 'Corrected' AND wrote <> kept GROUP BY 1 HAVING count(*) >= 2
UNION ALL SELECT 'Do not write ' || wrote, count(*), count(DISTINCT mapping) FROM w WHERE decision = 'Rejected' GROUP BY 1 HAVING count(*) >= 2""")
def correction_rules(t: Tables) -> DataFrame:
    """What reviews changed, as rules with how often each recurred; those that recurred only."""
    e = F.expr
    reviews = t.orders.select((F.col("o_custkey") % 97).alias("mapping"), e("if(o_orderpriority < '3', 'A', 'B')").alias("wrote"), e("case o_orderstatus when 'F' then 'Corrected' when 'P' then 'Rejected' else 'Accepted' end").alias("decision"), e("if(o_totalprice > 250000, 'C', 'B')").alias("kept"))
    return matching.correction_rules(reviews, 2)


@query("""WITH first AS (SELECT p_brand AS term, min(p_type) AS kind, arg_min(p_name, p_partkey) AS label, count(*) AS n FROM part GROUP BY 1) SELECT term, term || ' | ' || kind || ' | ' || coalesce(label, term) || ' | ' || n || ' uses' AS card FROM first""")
def term_cards(t: Tables) -> DataFrame:
    """One line for each term: name, kind, first label, uses."""
    g = t.part.groupBy(F.col("p_brand").alias("term")).agg(F.min("p_type").alias("kind"), F.min_by("p_name", "p_partkey").alias("label"), F.count("*").alias("n"))
    return g.select("term", F.concat_ws(" | ", "term", "kind", F.coalesce("label", "term"), F.concat(F.col("n").cast("string"), F.lit(" uses"))).alias("card"))


SHADOW = "q AS (SELECT s, p, o FROM quad), c AS (SELECT s, o AS class FROM q WHERE p = 'type')"


def _shadow(t: Tables) -> DataFrame:
    q = t.quads().select("s", "p", "o")
    classes = q.where("p = 'type'").select("s", F.col("o").alias("class"))
    domain = q.where("p <> 'type'").join(classes, "s").groupBy("p").agg(F.array_join(F.array_sort(F.collect_set("class")), " ").alias("domain"), F.count("*").alias("n"))
    ranges = q.where("p <> 'type'").join(classes.select(F.col("s").alias("o"), F.col("class").alias("to")), "o").groupBy("p").agg(F.array_join(F.array_sort(F.collect_set("to")), " ").alias("range"))
    return domain.join(ranges, "p", "left").select("p", "domain", F.coalesce("range", F.lit("literal")).alias("range"), "n")


@query(f"""WITH {QUADS}, {SHADOW}, d AS (SELECT p, string_agg(DISTINCT class, ' ' ORDER BY class) AS domain, count(*) AS n FROM q JOIN c USING (s) WHERE p <> 'type' GROUP BY p),
r AS (SELECT q.p, string_agg(DISTINCT c.class, ' ' ORDER BY c.class) AS range FROM q JOIN c ON c.s = q.o WHERE q.p <> 'type' GROUP BY q.p) SELECT p, domain, coalesce(range, 'literal') AS range, n FROM d LEFT JOIN r USING (p)""")
def shadow_index(t: Tables) -> DataFrame:
    """Properties with the classes that they are found on and lead to."""
    return _shadow(t)


LIFTED = """line AS (SELECT doc_id, 'd' || doc_id AS d, i - 1 AS i, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l, ' ') <> ''),
fact AS (SELECT doc_id, 'd' || doc_id AS s, 'type' AS p, 'Document' AS o, false AS declared FROM documents UNION ALL SELECT doc_id, 'd' || doc_id, 'lang', lang, true FROM documents WHERE lang IS NOT NULL
 UNION ALL SELECT doc_id, 'd' || doc_id, 'source', source, true FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, d || '/' || i, 'type', 'Line', false FROM line UNION ALL SELECT doc_id, d || '/' || i, 'of', d, false FROM line
 UNION ALL SELECT doc_id, d || '/' || i, 'text', sha256(l), false FROM line UNION ALL SELECT doc_id, d || '/' || i, 'refersTo', unnest(regexp_extract_all(l, '[a-z0-9.]+@[a-z0-9.]+[a-z0-9]')), false FROM line
 UNION ALL SELECT doc_id, d, unnest(regexp_extract_all(l, '([a-z_]+) = "([^"]*)"', 1)), unnest(regexp_extract_all(l, '([a-z_]+) = "([^"]*)"', 2)), true FROM line),
seen AS (SELECT doc_id, 'declared' AS seen, s, p, o FROM fact UNION ALL SELECT doc_id, 'blind', s, p, o FROM fact WHERE NOT declared)"""


@query(f"WITH {LIFTED}, " + digest_bag_sql("SELECT seen, doc_id, s || ' ' || p || ' ' || o AS row FROM seen", ["seen", "doc_id"]) + " SELECT seen, doc_id, digest FROM bag")
def lift_documents(t: Tables) -> DataFrame:
    """Whole documents lifted to facts in two views, as a digest of each document's facts in each."""
    facts = lift.views(lift.lifted(t.documents, "doc_id", "text", ["lang", "source"]))
    return digest_bag(facts.select("seen", "doc_id", F.concat_ws(" ", "s", "p", "o").alias("row")), ["seen", "doc_id"], "row")


@query(f"WITH {LIFTED} SELECT seen, p, count(*) AS n, count(DISTINCT s) AS subjects FROM seen WHERE p IN ('type', 'lang', 'source', 'of', 'refersTo', 'token') GROUP BY ALL")
def lift_properties(t: Tables) -> DataFrame:
    """How often each view of the lifted documents states a property, and of how many subjects."""
    facts = lift.views(lift.lifted(t.documents, "doc_id", "text", ["lang", "source"]))
    return facts.where(F.col("p").isin("type", "lang", "source", "of", "refersTo", "token")).groupBy("seen", "p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


CLASSED = """sub AS (SELECT p_brand || '/' || p_type AS child, p_brand AS parent FROM part UNION SELECT p_brand, 'Brand' FROM part UNION SELECT 'Brand', 'Thing'),
f AS (SELECT DISTINCT 'p' || p_partkey AS s, 'type' AS p, CASE WHEN p_size % 2 = 0 THEN p_brand || '/' || p_type ELSE p_brand END AS o FROM part UNION SELECT 'p' || p_partkey, CASE WHEN p_size < 10 THEN 'small' ELSE 'size' END, '' || p_size FROM part)"""


@query(f"""WITH RECURSIVE {CLASSED}, up AS (SELECT child, parent FROM sub UNION SELECT up.child, sub.parent FROM up JOIN sub ON sub.child = up.parent),
i AS (SELECT s, o AS class FROM f WHERE p = 'type' UNION SELECT s, parent FROM f JOIN up ON child = o WHERE p = 'type'), o AS (SELECT o AS class, count(*) AS own FROM f WHERE p = 'type' GROUP BY 1)
SELECT class, coalesce(any_value(own), 0) AS own, count(DISTINCT i.s) AS all, coalesce(string_agg(DISTINCT f.p, ' ' ORDER BY f.p), '') AS properties FROM i LEFT JOIN o USING (class) LEFT JOIN f ON f.s = i.s AND f.p <> 'type' GROUP BY class""".replace(" AS all,", ' AS "all",'))
def shadow_classes(t: Tables) -> DataFrame:
    """Classes with the instances and properties that they inherit from below."""
    one = F.when(F.col("p_size") % 2 == 0, F.concat_ws("/", "p_brand", "p_type")).otherwise(F.col("p_brand"))
    s = F.concat(F.lit("p"), "p_partkey")
    facts = t.part.select(F.inline(F.array(F.struct(s.alias("s"), F.lit("type").alias("p"), one.alias("o")), F.struct(s.alias("s"), F.when(F.col("p_size") < 10, "small").otherwise("size").alias("p"), F.col("p_size").cast("string").alias("o")))))
    edges = t.part.select(F.inline(F.array(F.struct(F.concat_ws("/", "p_brand", "p_type").alias("child"), F.col("p_brand").alias("parent")), F.struct(F.col("p_brand").alias("child"), F.lit("Brand").alias("parent")), F.struct(F.lit("Brand").alias("child"), F.lit("Thing").alias("parent"))))).distinct()
    return lift.class_index(facts, edges)


@query(f"""WITH {QUADS}, v AS (SELECT 'declared' AS seen, s, p, o FROM quad UNION ALL SELECT 'blind', s, p, o FROM quad WHERE p NOT IN ('type', 'label')) SELECT seen, p, count(*) AS n, count(DISTINCT s) AS subjects FROM v GROUP BY ALL""")
def lift_views(t: Tables) -> DataFrame:
    """A document set lifted to one graph in two views: with what documents declare, and without."""
    q = t.quads().select("s", "p", "o")
    views = q.withColumn("seen", F.lit("declared")).unionByName(q.where("p not in ('type', 'label')").withColumn("seen", F.lit("blind")))
    return views.groupBy("seen", "p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query(f"""WITH {QUADS}, m(p, target) AS (VALUES ('segment', 'x:sector'), ('partOf', 'x:within')), j AS (SELECT s, coalesce(target, 'unmapped') AS p, count(*) AS n FROM quad LEFT JOIN m USING (p) WHERE p NOT IN ('type', 'label') GROUP BY ALL)
SELECT p, count(*) AS subjects, CAST(sum(n) AS BIGINT) AS facts FROM j GROUP BY p""")
def rig_projection(t: Tables) -> DataFrame:
    """A lifted graph through mapping schemes: what the schemes write, and what they leave."""
    m = t.values([("segment", "x:sector"), ("partOf", "x:within")], "p string, target string")
    j = t.quads().where("p not in ('type', 'label')").join(F.broadcast(m), "p", "left").groupBy("s", F.coalesce("target", F.lit("unmapped")).alias("p")).agg(F.count("*").alias("n"))  # m: an inline table
    return j.groupBy("p").agg(F.count("*").alias("subjects"), F.sum("n").alias("facts"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, length(w) + length(regexp_replace(w, '[\\x{0}-\\x{FFFF}]', '', 'g')) AS n FROM w), p AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, count(*) AS tokens, CAST(max(start + n) AS BIGINT) AS utf16, sha256(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY i)) AS spans FROM p GROUP BY doc_id""")
def text_spans_utf16(t: Tables) -> DataFrame:
    """Spans of the tokens of whole documents in UTF-16 units; here their number, the last end and a digest of all."""
    units = F.transform(F.split("text", " "), lambda w: (F.octet_length(F.encode(w, "UTF-16BE")) / 2).cast("int"))
    return text.token_spans(t.documents.where("text is not null").select("doc_id", units.alias("lengths")), "doc_id")


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '","user":' || user_id || '}' AS canonical FROM events""")
def json_canonical(t: Tables) -> DataFrame:
    """JSON with sorted keys and no spaces, from a struct whose fields come in any order."""
    return t.events.select("event_id", text.canonical_json({"user": F.col("user_id"), "type": F.col("event_type"), "k": F.from_json("props", "k int")["k"]}).alias("canonical"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'P' || event_id % 5 || 'DT' || event_id % 24 || 'H' WHEN 1 THEN 'PT' || event_id % 90 || '.5S' WHEN 2 THEN 'P' || event_id % 9 || 'W' WHEN 3 THEN '-PT' || event_id % 70 || 'M'
 WHEN 4 THEN 'P' || event_id || 'Y' WHEN 5 THEN 'P' WHEN 6 THEN event_type ELSE 'P' || event_id % 30 || 'DT1H' || event_id % 60 || 'M6.789S' END AS text,
CASE event_id % 8 WHEN 0 THEN event_id % 5 * 86400000 + event_id % 24 * 3600000 WHEN 1 THEN event_id % 90 * 1000 + 500 WHEN 2 THEN event_id % 9 * 604800000 WHEN 3 THEN -(event_id % 70 * 60000)
 WHEN 7 THEN event_id % 30 * 86400000 + 3600000 + event_id % 60 * 60000 + 6789 END AS ms FROM events""")
def iso_duration(t: Tables) -> DataFrame:
    """Durations in milliseconds; null for what has no fixed length or is none."""
    written = F.expr("""case event_id % 8 when 0 then 'P' || event_id % 5 || 'DT' || event_id % 24 || 'H' when 1 then 'PT' || event_id % 90 || '.5S' when 2 then 'P' || event_id % 9 || 'W' when 3 then '-PT' || event_id % 70 || 'M'
     when 4 then 'P' || event_id || 'Y' when 5 then 'P' when 6 then event_type else 'P' || event_id % 30 || 'DT1H' || event_id % 60 || 'M6.789S' end""")
    return t.events.select("event_id", written.alias("text")).select("event_id", "text", text.duration_ms(F.col("text")).alias("ms"))


@query("SELECT count(*) AS rows, 1 AS instants, true AS recent FROM orders")
def now_instant(t: Tables) -> DataFrame:
    """The current instant is one for all rows of a query, and not before the data's last day."""
    o = t.orders.withColumn("now", F.current_timestamp())
    return o.agg(F.count("*").alias("rows"), F.count_distinct("now").cast("int").alias("instants"), (F.max("now") > F.max("o_orderdate")).alias("recent"))
