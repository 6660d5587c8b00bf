"""Matching, ranking, clustering and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import abbreviations, community, forms, graph, matching, nearest, relational
from graphloom.sources.tables import Tables

from .registry import query

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def words_sql(c: str) -> str:
    spaced = f"regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    found = f"list_filter(list_transform(regexp_extract_all({spaced}, '[A-Za-z][a-z0-9]*'), lambda w: lower(w)), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"
    return f"list_transform({found}, lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN substr(w, 1, length(w) - 1) ELSE w END)"


def tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split(lower(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(f"SELECT item_id, array_to_string({words_sql('text')}, ' ') AS words FROM benchmark")
def text_words(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(text.words(F.col("text")), " ").alias("words"))


@query(f"SELECT p_partkey, array_to_string(list_sort({tokens_sql('p_name || p_type')}), ' ') AS tokens FROM part")
def text_tokenise(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.array_sort(text.tokens(F.concat("p_name", "p_type"))), " ").alias("tokens"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def text_edit_distance(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_name")
    j = p.alias("a").join(p.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    return j.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(text.edit_similarity(F.col("a.p_name"), F.col("b.p_name")), 6).alias("similarity"))


@query(f"""WITH k AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents) SELECT a.doc_id AS a, b.doc_id AS b,
round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM k a JOIN k b ON b.doc_id = a.doc_id + 1 WHERE len(a.w) + len(b.w) > 0""")
def text_jaccard(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w"))
    j = k.alias("a").join(k.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).where("size(a.w) + size(b.w) > 0")
    return j.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.round(text.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


@query("""WITH d(short, long) AS (VALUES ('red', 'scarlet'), ('red', 'crimson'), ('wid', 'widget')), w AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part),
x AS (SELECT p_name, CASE WHEN d.long IS NULL THEN w[1] ELSE d.long END AS first, w[2] AS rest FROM w LEFT JOIN d ON d.short = w[1] UNION SELECT p_name, w[1], w[2] FROM w)
SELECT p_name, first || ' ' || rest AS variant FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY first, rest) AS r FROM x) WHERE r <= 50""")
def text_abbrev(t: Tables) -> DataFrame:
    d = t.values([("red", "scarlet"), ("red", "crimson"), ("wid", "widget")], "short string, long string")
    w = t.part.select("p_name", F.split("p_name", " ").alias("w")).distinct()
    own = w.select("p_name", F.col("w")[0].alias("first"), F.col("w")[1].alias("rest"))
    more = own.join(F.broadcast(d), F.col("first") == F.col("short")).select("p_name", F.col("long").alias("first"), "rest")
    every = own.union(more).distinct()
    return relational.top_k(every, ["p_name"], [F.col("first"), F.col("rest")], 50).select("p_name", F.concat_ws(" ", "first", "rest").alias("variant"))


LEARNED = """pair AS (SELECT string_split(p_name, ' ') AS w FROM part), both_ AS (SELECT left(w[1], 3) AS short, w[1] AS long FROM pair UNION ALL SELECT w[2][1] || regexp_replace(w[2][2:], '[aeiou]', '', 'g'), w[2] FROM pair),
learned AS (SELECT short, long, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY short), 6) AS share FROM both_ WHERE short <> long GROUP BY short, long)"""


def learned_of(t: Tables) -> DataFrame:
    """Short forms learned from names of parts and names in which the first word is cut and the second has lost its vowels."""
    w = t.part.select(F.split("p_name", " ").alias("long"))
    short = F.array(F.substring(F.col("long")[0], 1, 3), F.concat(F.substring(F.col("long")[1], 1, 1), F.regexp_replace(F.substring(F.col("long")[1], 2, 100), "[aeiou]", "")))
    return abbreviations.learn(w.select(short.alias("short"), "long"))


@query(f"WITH {LEARNED} SELECT short, long, n, share FROM learned WHERE n >= 2")
def text_abbrev_learned(t: Tables) -> DataFrame:
    return learned_of(t)


@query(f"""WITH {LEARNED}, own AS (SELECT DISTINCT p_name, left(w[1], 3) AS a, w[2][1] || regexp_replace(w[2][2:], '[aeiou]', '', 'g') AS b FROM (SELECT p_name, string_split(p_name, ' ') AS w FROM part)),
x AS (SELECT p_name, a AS word, 1.0 AS p, b FROM own UNION ALL SELECT p_name, long, share, b FROM own JOIN learned ON short = a WHERE n >= 2),
y AS (SELECT p_name, word, p, b AS second FROM x UNION ALL SELECT p_name, word, p * share, long FROM x JOIN learned ON short = b WHERE n >= 2)
SELECT p_name, word || ' ' || second AS variant FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p DESC, word || ' ' || second) AS r FROM y) WHERE r <= 50""")
def text_abbrev_expanded(t: Tables) -> DataFrame:
    """What shortened names of parts may stand for, the likeliest 50."""
    w = F.split("p_name", " ")
    short = F.array(F.substring(w[0], 1, 3), F.concat(F.substring(w[1], 1, 1), F.regexp_replace(F.substring(w[1], 2, 100), "[aeiou]", "")))
    return abbreviations.expanded(t.part.select("p_name", short.alias("w")).distinct(), "p_name", "w", learned_of(t))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round((1 + list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
* sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))) / 2, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_cosine(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "embedding")
    j = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return j.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round((1 + matching.cosine(F.col("a.embedding"), F.col("b.embedding"))) / 2, 6).alias("similarity"))


# The kinds of targets that a kind of query can match, the likeliest first.
MATCHES = {"en": ("en", "de"), "de": ("de", "en"), "fr": ("fr", "es"), "es": ("es",)}
PAIRS = ", ".join(f"('{a}', '{b}', {k})" for a, bs in MATCHES.items() for k, b in enumerate(bs))


DOCS = f"""t AS (SELECT doc_id AS id, lang AS kind, {words_sql('text')} AS w FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
q AS (SELECT item_id AS id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS source, {words_sql('text')} AS w FROM benchmark)"""


def bm25_sql(k: int, pairs: str = PAIRS, inputs: str = DOCS) -> str:
    return f"""WITH kinds(source, kind, step) AS (VALUES {pairs}), {inputs},
tf AS (SELECT id, kind, len, term, count(*) AS tf FROM (SELECT id, kind, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT source, term, count(*) AS df FROM tf JOIN kinds USING (kind) GROUP BY ALL),
st AS (SELECT source, count(*) AS n, avg(len(w)) AS mean FROM t JOIN kinds USING (kind) GROUP BY 1), qt AS (SELECT DISTINCT id, source, term FROM (SELECT id, source, unnest(w) AS term FROM q)),
s AS (SELECT qt.id AS query, tf.id AS target, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) * (1 - 0.1 * step), 4) AS score
 FROM qt JOIN df USING (source, term) JOIN st USING (source) JOIN kinds USING (source) JOIN tf ON tf.term = qt.term AND tf.kind = kinds.kind GROUP BY qt.id, tf.id, step),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank FROM s WHERE score > 0) SELECT query, rank, target, score FROM r WHERE rank <= {k}"""


@query(bm25_sql(3))
def text_bm25_topk(t: Tables) -> DataFrame:
    """Each benchmark item's best documents among those of the languages that it can match."""
    e = F.expr("case item_id % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' else 'es' end")
    q = t.benchmark.select(F.col("item_id").alias("id"), e.alias("kind"), text.words(F.col("text")).alias("words"))
    d = t.documents.where("text is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), text.words(F.col("text")).alias("words"))
    return matching.bm25(q, d, 3, MATCHES).select("query", "rank", "target", "score")


# Entries of a catalogue: parts by name and type, each word twice, and by brand; suppliers by name. Queries ask for parts first.
ENTRY_MATCHES = {"part": ("part", "supplier")}
ENTRIES = f"""t AS (SELECT p_partkey AS id, 'part' AS kind, list_concat({words_sql('p_name')}, {words_sql('p_name')}, {words_sql('p_type')}, {words_sql('p_type')}, {words_sql('p_brand')}) AS w FROM part
 UNION ALL SELECT 10000000 + s_suppkey, 'supplier', list_concat({words_sql("s_name || ' widget'")}, {words_sql("s_name || ' widget'")}) FROM supplier WHERE s_suppkey % 9 = 0),
q AS (SELECT p_partkey AS id, 'part' AS source, {words_sql("p_type || ' ' || p_name")} AS w FROM part WHERE p_partkey % 50 = 0)"""


@query(bm25_sql(5, "('part', 'part', 0), ('part', 'supplier', 1)", ENTRIES))
def text_rank_entries(t: Tables) -> DataFrame:
    """The best entries of a catalogue for each fiftieth part's description: an entry's names count twice."""
    w = text.words
    parts = t.part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), matching.entry_words([(w(F.col("p_name")), 2), (w(F.col("p_type")), 2), (w(F.col("p_brand")), 1)]).alias("words"))
    named = F.concat("s_name", F.lit(" widget"))
    suppliers = t.supplier.where("s_suppkey % 9 = 0").select((F.col("s_suppkey") + 10_000_000).alias("id"), F.lit("supplier").alias("kind"), matching.entry_words([(w(named), 2)]).alias("words"))
    asked = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), w(F.concat_ws(" ", "p_type", "p_name")).alias("words"))
    return matching.bm25(asked, parts.unionByName(suppliers), 5, ENTRY_MATCHES).select("query", "rank", "target", "score")


RANKS = """a AS (SELECT user_id AS query, event_type AS target, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1, 2),
b AS (SELECT user_id AS query, event_type AS target, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS rank FROM events GROUP BY 1, 2)"""


def ranks_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    g = t.events.groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("target")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    w = Window.partitionBy("query")
    return g.withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), "target"))), g.withColumn("rank", F.row_number().over(w.orderBy(F.col("last").desc())))


@query(f"WITH {RANKS} SELECT query, target, round(sum(1 / (60.0 + rank)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def text_rrf(t: Tables) -> DataFrame:
    return matching.reciprocal_rank_fusion(list(ranks_of(t)))


@query(f"WITH {RANKS} SELECT round(avg(CAST(a.rank <= 2 AS INTEGER)), 6) AS hit_at_2, count(*) AS n FROM a JOIN b USING (query, target) WHERE b.rank = 1")
def text_hit_at_k(t: Tables) -> DataFrame:
    a, b = ranks_of(t)
    j = a.select("query", "target", "rank").join(b.where("rank = 1").select("query", "target"), ["query", "target"])
    return j.agg(F.round(F.avg((F.col("rank") <= 2).cast("int")), 6).alias("hit_at_2"), F.count("*").alias("n"))


CONCEPTS = ["red widget", "blue gadget", "green bolt", "cold widget", "hot gear", "large panel", "small bolt", "widget frame", "steel gear", "gadget"]


@query(f"""WITH f AS (SELECT DISTINCT p_name AS field FROM part), c(concept) AS (VALUES {', '.join(f"('{c}')" for c in CONCEPTS)}),
w AS (SELECT field, concept, list_distinct(string_split(field, ' ')) AS a, list_distinct(string_split(concept, ' ')) AS b FROM f, c),
s AS (SELECT field, concept, CASE WHEN field = concept THEN 1.0 ELSE 0.0 END AS exact, round(0.9 * (1 - levenshtein(field, concept) / greatest(length(field), length(concept))), 6) AS edit,
 round(0.95 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS tokens FROM w),
x AS (SELECT field, concept, greatest(exact, edit, tokens) AS score, CASE WHEN exact >= edit AND exact >= tokens THEN 'exact' WHEN edit >= tokens THEN 'edit' ELSE 'tokens' END AS strategy FROM s)
SELECT field, concept, strategy, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, concept) AS rank FROM x WHERE score > 0) WHERE rank <= 3""")
def text_recognise(t: Tables) -> DataFrame:
    """The best concepts of a declared list for each distinct field, over strategies: exact, edit distance, shared tokens."""
    strategies = {
        "exact": (1.0, lambda a, b: (a == b).cast("double")), "edit": (0.9, text.edit_similarity), "tokens": (0.95, lambda a, b: text.jaccard(text.tokens(a), text.tokens(b))),
    }
    return matching.recognise(t.part.select(F.col("p_name").alias("field")).distinct(), CONCEPTS, strategies, 3).select("field", "concept", "strategy", "score", "rank")


OBS = "obs AS (SELECT DISTINCT l_orderkey AS s, p_brand AS c FROM lineitem JOIN part ON p_partkey = l_partkey)"


def obs_of(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("s"), F.col("p_brand").alias("c")).distinct()


@query(f"WITH {OBS} SELECT s, count(*) AS n, string_agg(c, ' ' ORDER BY c) AS concepts FROM obs GROUP BY s HAVING count(*) >= 2")
def obs_sections(t: Tables) -> DataFrame:
    return obs_of(t).groupBy("s").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("c")), " ").alias("concepts")).where("n >= 2")


COOC = f"""{OBS}, deg AS (SELECT c, count(*) AS deg FROM obs GROUP BY 1), pr AS (SELECT x.c AS a, y.c AS b, count(*) AS n FROM obs x JOIN obs y ON x.s = y.s AND x.c < y.c GROUP BY ALL),
w AS (SELECT a, b, n, round(n / least(d1.deg, d2.deg), 6) AS weight FROM pr JOIN deg d1 ON d1.c = a JOIN deg d2 ON d2.c = b)"""


@query(f"WITH {COOC} SELECT * FROM w")
def cooc_overlap(t: Tables) -> DataFrame:
    return matching.cooccurrence(obs_of(t), "s", "c")


@query(f"""WITH RECURSIVE {COOC}, e AS (SELECT a, b FROM w WHERE weight >= 1 / 4.0 UNION SELECT b, a FROM w WHERE weight >= 1 / 4.0), r AS (SELECT c AS node, c AS m FROM deg UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.node)
SELECT node, min(m) AS component FROM r GROUP BY node""")
def cluster_components(t: Tables) -> DataFrame:
    """Components of the concepts whose weight reaches the threshold, one over the resolution; a concept without one is its own."""
    obs = obs_of(t)
    strong = matching.cooccurrence(obs, "s", "c").where(f"weight >= {1 / 4.0}D").select("a", "b")
    alone = obs.select(F.col("c").alias("a"), F.col("c").alias("b")).distinct()
    return graph.components(strong.union(alone), "a", "b")


@query(f"""WITH {COOC}, m AS (SELECT a, b, weight, substr(a, 7, 1) = substr(b, 7, 1) AS same FROM w), tot AS (SELECT sum(weight) AS t FROM w),
d AS (SELECT c, sum(weight) AS k FROM (SELECT a AS c, weight FROM w UNION ALL SELECT b, weight FROM w) GROUP BY c), g AS (SELECT substr(c, 7, 1) AS g, sum(k) AS k FROM d GROUP BY 1)
SELECT round((SELECT sum(weight) FROM m WHERE same) / t - (SELECT sum(k * k) FROM g) / (4 * t * t), 6) AS modularity, round((SELECT avg(weight) FROM m WHERE same), 6) AS coherence FROM tot""")
def cluster_quality(t: Tables) -> DataFrame:
    """Modularity and mean coherence of the clusters of brands by their first digit."""
    w = matching.cooccurrence(obs_of(t), "s", "c").withColumn("same", F.substring("a", 7, 1) == F.substring("b", 7, 1))
    edges = w.agg(F.sum("weight").alias("t"), F.sum(F.when(F.col("same"), F.col("weight"))).alias("within"), F.avg(F.when(F.col("same"), F.col("weight"))).alias("coherence"))
    ends = w.select(F.explode(F.array("a", "b")).alias("c"), "weight").groupBy(F.substring("c", 7, 1).alias("g")).agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return edges.join(F.broadcast(ends)).select(F.round(F.col("within") / F.col("t") - F.col("kk") / (4 * F.col("t") * F.col("t")), 6).alias("modularity"), F.round("coherence", 6).alias("coherence"))


COMM = f"""{OBS}, wt AS (SELECT p_type AS comm, p_brand AS c, count(*) / sum(count(*)) OVER (PARTITION BY p_type) AS p FROM part GROUP BY 1, 2)"""


def communities_of(t: Tables) -> DataFrame:
    """comm, c, p: the share of each brand in each type."""
    g = t.part.groupBy(F.col("p_type").alias("comm"), F.col("p_brand").alias("c")).agg(F.count("*").alias("n"))
    return g.select("comm", "c", (F.col("n") / F.sum("n").over(Window.partitionBy("comm"))).alias("p"))


@query(f"WITH {COMM} SELECT comm, count(*) AS members, round(max(p), 6) AS top, round(sum(p * p), 6) AS coherence FROM wt GROUP BY comm")
def cluster_profiles(t: Tables) -> DataFrame:
    return communities_of(t).groupBy("comm").agg(F.count("*").alias("members"), F.round(F.max("p"), 6).alias("top"), F.round(F.sum(F.col("p") * F.col("p")), 6).alias("coherence"))


@query(f"WITH {COMM}, m AS (SELECT s, comm, round(sum(p), 6) AS score FROM obs JOIN wt USING (c) GROUP BY ALL) SELECT s, comm, score FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, comm) AS r FROM m) WHERE r <= 5")
def comm_match_sum(t: Tables) -> DataFrame:
    return community.matched(obs_of(t), communities_of(t), 5)


@query(f"""WITH {COMM}, l AS (SELECT s, comm, sum(ln(greatest(coalesce(p, 0), 0.001))) AS ll FROM obs CROSS JOIN (SELECT DISTINCT comm FROM wt) k LEFT JOIN wt USING (comm, c) GROUP BY ALL),
e AS (SELECT s, comm, exp(ll - max(ll) OVER (PARTITION BY s)) AS e FROM l) SELECT s, comm, round(e / sum(e) OVER (PARTITION BY s), 6) AS posterior FROM e""")
def comm_bayes(t: Tables) -> DataFrame:
    """Naive Bayes over communities with clamped likelihoods: a small, bounded list of communities rides on each observation."""
    wide = communities_of(t)
    rows = wide.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("comm", "p"))).alias("ps"))  # communities are a short list
    kinds = wide.groupBy().agg(F.array_sort(F.collect_set("comm")).alias("comms"))
    j = obs_of(t).join(rows, "c", "left").join(F.broadcast(kinds)).select("s", "c", "ps", F.explode("comms").alias("comm")).select("s", "comm", F.element_at("ps", F.col("comm")).alias("p"))  # kinds: one row
    logs = j.groupBy("s", "comm").agg(F.sum(F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.001)))).alias("ll"))
    return matching.posteriors(logs, ["s"], "ll").select("s", "comm", F.round("posterior", 6).alias("posterior"))


@query("""WITH a AS (SELECT p_brand AS c, count(*) AS w FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT p_brand AS c, count(*) AS w FROM part WHERE p_size >= 20 GROUP BY 1)
SELECT round(sum(least(coalesce(a.w, 0), coalesce(b.w, 0))) / sum(greatest(coalesce(a.w, 0), coalesce(b.w, 0))), 6) AS jaccard FROM a FULL JOIN b USING (c)""")
def comm_wjaccard(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand").agg(F.count_if(F.col("p_size") < 25).alias("a"), F.count_if(F.col("p_size") >= 20).alias("b"))
    return g.agg(F.round(F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b")), 6).alias("jaccard"))


@query(f"WITH {COMM}, base AS (SELECT p_brand AS c, count(*) / sum(count(*)) OVER () AS q FROM part GROUP BY 1) SELECT comm, round(sum(p * greatest(0, ln(p / q))), 6) AS boost FROM wt JOIN base USING (c) GROUP BY comm")
def comm_boost(t: Tables) -> DataFrame:
    base = t.part.groupBy(F.col("p_brand").alias("c")).agg(F.count("*").alias("n"))
    total = F.broadcast(base.agg(F.sum("n").alias("total")))
    return communities_of(t).join(base.join(total), "c").groupBy("comm").agg(F.round(F.sum(F.col("p") * F.greatest(F.lit(0.0), F.log(F.col("p") / (F.col("n") / F.col("total"))))), 6).alias("boost"))


@query("SELECT p_type AS comm, p_brand AS concept, count(*) AS n, max(s_name) AS holder FROM part LEFT JOIN supplier ON s_suppkey = p_partkey GROUP BY ALL HAVING count(*) >= 2")
def comm_templates(t: Tables) -> DataFrame:
    j = t.part.join(t.supplier, F.col("s_suppkey") == F.col("p_partkey"), "left")
    return j.groupBy(F.col("p_type").alias("comm"), F.col("p_brand").alias("concept")).agg(F.count("*").alias("n"), F.max("s_name").alias("holder")).where("n >= 2")


@query("""WITH n AS (SELECT event_type, count(*) AS total FROM events GROUP BY 1), c AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS prop, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, prop, n, round(n / total, 6) AS confidence FROM c JOIN n USING (event_type) WHERE n >= 5""")
def proj_confidence(t: Tables) -> DataFrame:
    c = t.events.groupBy("event_type", F.expr("from_json(props, 'k int').k div 10").alias("prop")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("event_type"))
    return c.select("event_type", "prop", "n", F.round(F.col("n") / total, 6).alias("confidence")).where("n >= 5")


@query("""WITH RECURSIVE d AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, x AS ema FROM d WHERE i = 1
UNION ALL SELECT d.user_id, d.i, 0.3 * d.x + 0.7 * r.ema FROM r JOIN d ON d.user_id = r.user_id AND d.i = r.i + 1) SELECT user_id, round(arg_max(ema, i), 6) AS ema FROM r GROUP BY user_id""")
def comm_ema(t: Tables) -> DataFrame:
    """Exponential moving average in event order, as a sum: the k-th value before the last has the weight 0.3 * 0.7 ** k, the first one 0.7 ** k."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())) - 1
    numbered = t.events.select("user_id", "value", back.alias("k"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())).isNull().alias("first"))
    weight = F.when(F.col("first"), F.pow(F.lit(0.7), "k")).otherwise(0.3 * F.pow(F.lit(0.7), "k"))
    return numbered.groupBy("user_id").agg(F.round(F.sum(weight * F.col("value")), 6).alias("ema"))


SIGNALS = """sig AS (SELECT p_partkey, p_size / 50.0 AS name, p_retailprice / 4000 AS emb, CASE WHEN p_type = 'ECONOMY' THEN 0.0 WHEN p_size % 3 = 0 THEN 0.5 ELSE 1.0 END AS ty, p_size / 100.0 AS dist, length(p_name) / 20.0 AS struc,
p_size / 500.0 AS prior, p_partkey % 7 / 10.0 AS comm, p_partkey % 5 / 5.0 AS proj, p_partkey % 11 <> 0 AS ok FROM part)"""


@query(f"""WITH {SIGNALS} SELECT p_partkey, round(CASE WHEN ty <= 0 OR NOT ok THEN -1000 ELSE CASE WHEN name > 0 THEN 1.5 * ln(name) ELSE 0 END + CASE WHEN emb > 0 THEN ln(emb) ELSE 0 END + CASE WHEN ty < 1 THEN 0.8 * ln(ty) ELSE 0 END + 0.7 * dist + 0.3 * struc
+ 0.2 * ln(greatest(prior, 1e-10)) + 1.8 * comm + CASE WHEN proj > 0 THEN 2.5 * (ln(proj) + ln(15)) ELSE 0 END END, 6) AS score FROM sig""")
def evidence_score(t: Tables) -> DataFrame:
    """Eight signals with two hard gates."""
    e = F.expr
    signals = {
        "name_match": F.col("p_size") / 50.0, "embedding": F.col("p_retailprice") / 4000, "type_compatibility": e("case when p_type = 'ECONOMY' then 0.0D when p_size % 3 = 0 then 0.5D else 1.0D end"), "distortion": F.col("p_size") / 100.0,
        "structural": F.length("p_name") / 20.0, "prior": F.col("p_size") / 500.0, "community": e("p_partkey % 7 / 10.0D"), "projection": e("p_partkey % 5 / 5.0D"),
    }
    return t.part.select("p_partkey", F.round(matching.evidence(signals, F.col("p_partkey") % 11 != 0), 6).alias("score"))


@query("""WITH c(a, b, d) AS (VALUES ('int', 'long', 0.25), ('int', 'string', 0.5), ('long', 'string', 0.5)), f AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'long' ELSE 'date' END AS ty FROM part)
SELECT p_partkey, round(exp(-CASE WHEN ty = 'string' THEN 0 ELSE d END), 6) AS compatibility FROM f JOIN c ON a = ty AND b = 'string'""")
def type_distance(t: Tables) -> DataFrame:
    c = t.values([("int", "long", 0.25), ("int", "string", 0.5), ("long", "string", 0.5)], "ty string, b string, d double").where("b = 'string'")
    f = t.part.select("p_partkey", F.expr("case p_size % 3 when 0 then 'int' when 1 then 'long' else 'date' end").alias("ty"))
    return f.join(F.broadcast(c), "ty").select("p_partkey", F.round(F.exp(-F.col("d")), 6).alias("compatibility"))


@query("""WITH own AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'closed' WHEN n_nationkey % 3 = 1 THEN 'open' END AS intent, n_regionkey FROM nation)
SELECT id, coalesce(intent, CASE WHEN n_regionkey % 2 = 0 THEN 'closed' ELSE 'open' END) AS intent, CASE WHEN intent IS NULL THEN 0.5 ELSE 1.0 END AS alignment FROM own""")
def axiom_align(t: Tables) -> DataFrame:
    """An intent of a node, or inherited from the node above."""
    own = t.nation.select(F.col("n_nationkey").alias("id"), F.expr("case when n_nationkey % 3 = 0 then 'closed' when n_nationkey % 3 = 1 then 'open' end").alias("own"), "n_regionkey")
    above = t.region.select("r_regionkey", F.expr("if(r_regionkey % 2 = 0, 'closed', 'open')").alias("above"))
    j = own.join(above, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("id", F.coalesce("own", "above").alias("intent"), F.when(F.col("own").isNull(), 0.5).otherwise(1.0).alias("alignment"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS done FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) OVER w AS BIGINT) AS seen, round(sum(done) OVER w / sum(n) OVER w, 6) AS rate FROM d WINDOW w AS (ORDER BY day)""")
def conv_metrics(t: Tables) -> DataFrame:
    """Cumulative counts by day: the window runs over one row for each day."""
    d = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done"))
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("day", F.sum("n").over(w).alias("seen"), F.round(F.sum("done").over(w) / F.sum("n").over(w), 6).alias("rate"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'")
def queue_order(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("""WITH f(form, pat, fixed) AS (VALUES (1, '^the .*$', 1), (2, '^to the .*$', 2), (3, '^[a-z]+ of .*$', 1)), m AS (SELECT item_id, form, fixed FROM benchmark JOIN f ON regexp_matches(lower(text), pat, 's'))
SELECT item_id, form FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fixed DESC, form) AS r FROM m) WHERE r = 1""")
def text_form_match(t: Tables) -> DataFrame:
    """The sentence form with the most fixed words, then the first one."""
    forms = [(1, "(?s)^the .*$", 1), (2, "(?s)^to the .*$", 2), (3, "(?s)^[a-z]+ of .*$", 1)]
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.lit(-n).alias("fixed"), F.lit(k).alias("form"))) for k, p, n in forms]))
    return t.benchmark.select("item_id", F.array_min(hits)["form"].alias("form")).where("form is not null")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'licensed under') THEN 'licence' WHEN contains(lower(text), 'token =') THEN 'secret' ELSE 'other' END AS class FROM documents")
def text_keyword_class(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", F.when(low.contains("licensed under"), "licence").when(low.contains("token ="), "secret").otherwise("other").alias("class"))


# Forms and phrases come from the benchmark's items: their beginnings and ends as fixed words around a slot, their first words as phrases.
ITEM_WORDS = """item AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM benchmark)"""
FORM_ROWS = f"""{ITEM_WORDS}, form AS (SELECT min(item_id) * 2 AS form, a, b, c FROM (SELECT item_id, lower(w[1]) AS a, lower(w[2]) AS b, lower(w[-1]) AS c FROM item WHERE len(w) > 3) GROUP BY a, b, c
UNION ALL SELECT min(item_id) * 2 + 1, a, NULL, NULL FROM (SELECT item_id, lower(w[1]) AS a FROM item WHERE len(w) > 3) GROUP BY a)"""


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def forms_of(t: Tables) -> DataFrame:
    """form, pattern: for each item its first two words, a slot and its last word; and its first word and a slot."""
    w = t.benchmark.select("item_id", words_of("text").alias("w")).where("size(w) > 3").select("item_id", *[F.lower(F.element_at("w", k)).alias(c) for c, k in (("a", 1), ("b", 2), ("c", -1))])
    long = w.groupBy("a", "b", "c").agg((F.min("item_id") * 2).alias("form")).select("form", F.concat_ws(" ", "a", "b", F.lit("{rest:text}"), "c").alias("pattern"))
    return long.unionByName(w.groupBy("a").agg((F.min("item_id") * 2 + 1).alias("form")).select("form", F.concat_ws(" ", "a", F.lit("{rest:text}")).alias("pattern")))


@query(f"""WITH {FORM_ROWS}, s AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS sentence, regexp_extract_all(unnest(x), '[\\p{{L}}\\p{{N}}_]+') AS w FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+[ \\t\\r\\n]+|\\n+') AS x FROM documents)),
m AS (SELECT doc_id, sentence, form, w[3:-2] AS rest, 3 AS fixed FROM s JOIN form ON lower(w[1]) = a AND lower(w[2]) = b AND lower(w[-1]) = c WHERE len(w) > 3
 UNION ALL SELECT doc_id, sentence, form, w[2:], 1 FROM s JOIN form ON lower(w[1]) = a AND b IS NULL WHERE len(w) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY fixed DESC, form) AS place FROM m)
SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, form, array_to_string(rest, ' ') AS rest FROM r WHERE place = 1""")
def text_sentence_forms(t: Tables) -> DataFrame:
    """Sentences of whole documents that a form of the table matches, with what its slot holds."""
    found = forms.match_sentences(t.documents, "doc_id", "text", forms_of(t))
    return found.select("doc_id", "sentence", "form", F.element_at("slots", "rest").alias("rest"))


@query(f"""WITH {ITEM_WORDS}, rule AS (SELECT min(item_id) AS rule, p, 'class ' || min(item_id) % 5 AS class FROM (SELECT item_id, lower(array_to_string(w[1:3], ' ')) AS p FROM item WHERE len(w) > 3) GROUP BY p),
t AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents)),
h AS (SELECT doc_id, class, rule, i - 1 AS "at" FROM t JOIN rule ON p = w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, "at") AS place FROM h)
SELECT d.doc_id, class, rule, "at" FROM documents d LEFT JOIN (SELECT * FROM b WHERE place = 1) x USING (doc_id)""")
def text_phrase_class(t: Tables) -> DataFrame:
    """The first rule in order whose phrase a whole document holds."""
    p = t.benchmark.select("item_id", words_of("text").alias("w")).where("size(w) > 3").select("item_id", F.lower(F.array_join(F.slice("w", 1, 3), " ")).alias("phrase"))
    rules = p.groupBy("phrase").agg(F.min("item_id").alias("rule")).select("rule", "phrase", F.concat(F.lit("class "), (F.col("rule") % 5).cast("string")).alias("class"))
    return forms.classify_phrases(t.documents, "doc_id", "text", rules)


@query()
def vec_nearest(t: Tables) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 50; similarity in [0, 1]."""
    found = nearest.nearest(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("query", "vec_id", "rank", F.round((1 + F.col("similarity")) / 2, 6).alias("similarity"))


@query("SELECT item_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS text FROM benchmark")
def norm_text(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.normal_text(F.col("text")).alias("text"))


@query("SELECT event_id, floor((value - 10) / 25) AS bin, 10 + 25 * floor((value - 10) / 25) AS start FROM events")
def bin_of(t: Tables) -> DataFrame:
    k = F.floor((F.col("value") - 10) / 25)
    return t.events.select("event_id", k.cast("double").alias("bin"), (10 + 25 * k).cast("double").alias("start"))


@query("""WITH f(unit, factor) AS (VALUES ('g', 1), ('kg', 1000)), v AS (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' ELSE 'oz' END AS unit FROM part)
SELECT p_partkey, p_size * factor AS grams, factor IS NULL AS refused FROM v LEFT JOIN f USING (unit)""")
def convert_units(t: Tables) -> DataFrame:
    """Units convert by a factor table; without a factor the conversion is refused, never guessed."""
    f = t.values([("g", 1), ("kg", 1000)], "unit string, factor int")
    v = t.part.select("p_partkey", "p_size", F.expr("case p_size % 3 when 0 then 'g' when 1 then 'kg' else 'oz' end").alias("unit"))
    return v.join(F.broadcast(f), "unit", "left").select("p_partkey", (F.col("p_size") * F.col("factor")).alias("grams"), F.col("factor").isNull().alias("refused"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(l_quantity - 20, 0) AS over, l_extendedprice / l_quantity AS ratio, least(l_quantity, 30) AS low FROM lineitem WHERE l_quantity > 0")
def qty_ops(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.where("l_quantity > 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest(q - 20, F.lit(0.0)).alias("over"), (F.col("l_extendedprice") / q).alias("ratio"), F.least(q, F.lit(30.0)).alias("low"))
