"""Hierarchical balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import fold, ledger, settle
from graphloom.sources.tables import PATHS, POSTINGS, Tables

from .registry import query

HEAD = f"WITH RECURSIVE {PATHS}, {POSTINGS}"
#: Positions of a block of an account's postings, where the account may hold a large part of them.
BLOCK = 4096
#: Positions between two closings.
PERIOD = 16384
CEILING, STATED = 50_000_000, 20_000_000


@query(f'WITH RECURSIVE {PATHS} SELECT "desc", anc, depth FROM path')
def ledger_tree(t: Tables) -> DataFrame:
    return t.account_paths()


@query(f'{HEAD} SELECT anc AS account, CAST(sum(delta) AS BIGINT) AS moved FROM posting JOIN path ON account = "desc" WHERE pos <= (SELECT max(pos) FROM posting) GROUP BY anc')
def ledger_fold_plain(t: Tables) -> DataFrame:
    """Balances at the last recorded position: every posting counts."""
    return ledger.subtree_fold(t.postings(), t.account_paths(), {"moved": F.col("delta")})


@query(f'{HEAD} SELECT anc AS account, CAST(least({CEILING}, {STATED} + sum(delta)) AS BIGINT) AS balance FROM posting JOIN path ON account = "desc" GROUP BY anc')
def ledger_fold_ceiling(t: Tables) -> DataFrame:
    folded = ledger.subtree_fold(t.postings(), t.account_paths(), {"moved": F.col("delta")})
    return folded.select("account", F.least(F.lit(CEILING), F.lit(STATED) + F.col("moved")).alias("balance"))


@query(f'{HEAD} SELECT pos, anc AS account, depth AS "level", delta FROM posting JOIN path ON account = "desc"')
def ledger_every_level(t: Tables) -> DataFrame:
    return t.postings().join(t.account_paths(), F.col("account") == F.col("desc")).select("pos", F.col("anc").alias("account"), F.col("depth").alias("level"), "delta")


@query(f"WITH {POSTINGS} SELECT account, period, CAST(sum(sum(delta)) OVER (PARTITION BY account ORDER BY period) AS BIGINT) AS closed FROM posting GROUP BY account, period")
def ledger_checkpoint(t: Tables) -> DataFrame:
    return ledger.checkpoints(t.postings(), F.col("period"))


@query(f"WITH {POSTINGS} SELECT account, CAST(sum(delta) AS BIGINT) AS balance FROM posting GROUP BY account")
def ledger_read_from_checkpoint(t: Tables) -> DataFrame:
    """The last closing of all accounts, plus the postings after it: older postings are not read again.

    Closings are stored by the last period that they hold for and postings by period, once a session, as a
    ledger's writer keeps them; a read opens the folders of the last periods only.
    """
    numbered = t.postings().select("account", "delta", F.expr(f"(pos - 1) div {PERIOD}").alias("k"))
    head = t.remembered("last_period", lambda: numbered.agg(F.max("k").alias("k")).first()["k"] or 0, ("orders",))
    stored = t.spark.read.schema("account string, delta long, k long").parquet(t.stored("postings_by_period", lambda: numbered, "k", of=("orders",)))
    runs = t.stored("closing_runs", lambda: ledger.closing_runs(numbered, "k", head).withColumn("until", F.col("until").cast("long")), "until", of=("orders",))
    closed = t.spark.read.schema("account string, since long, closed long, until long").parquet(runs)
    tail = stored.where(f"k = {head}").groupBy("account").agg(F.sum("delta").alias("b"))
    return closed.where(f"until >= {head - 1} AND since < {head}").select("account", F.col("closed").alias("b")).unionByName(tail).groupBy("account").agg(F.sum("b").alias("balance"))


@query(f"WITH {POSTINGS} SELECT (pos - 1) // 500 AS period, account[1:2] AS layer, count(*) AS n, CAST(sum(delta) AS BIGINT) AS moved FROM posting GROUP BY 1, 2")
def ledger_period_partition(t: Tables) -> DataFrame:
    return t.postings().groupBy(F.expr("(pos - 1) div 500").alias("period"), F.substring("account", 1, 2).alias("layer")).agg(F.count("*").alias("n"), F.sum("delta").alias("moved"))


@query(f"""WITH {POSTINGS}, family(f, len) AS (VALUES ('fast', 200), ('slow', 1000)), sched AS (SELECT f, len, unnest(range(0, (SELECT max(pos) FROM posting) // len + 1)) AS k FROM family)
SELECT f, k, count(*) AS n, CAST(sum(delta) AS BIGINT) AS moved FROM posting JOIN sched ON pos > k * len AND pos <= (k + 1) * len GROUP BY f, k""")
def ledger_cross_family(t: Tables) -> DataFrame:
    """Periods of different lengths: the period number is computed for each family, no range join."""
    lengths = F.explode(F.array(F.struct(F.lit("fast").alias("f"), F.lit(200).alias("len")), F.struct(F.lit("slow").alias("f"), F.lit(1000).alias("len")))).alias("x")
    p = t.postings().select("pos", "delta", lengths).select(F.col("x.f").alias("f"), F.expr("(pos - 1) div x.len").alias("k"), "delta", "pos")
    return p.where("pos >= 1").groupBy("f", "k").agg(F.count("*").alias("n"), F.sum("delta").alias("moved"))


ACCEPTED = "(NOT credit OR kind IS NULL OR kind = 'O' OR (kind = 'F' AND CAST(account[2:] AS BIGINT) % 2 = 0))"


def accepted():
    """Debits count; credits only of kinds that the account accepts: O everywhere, F in even accounts."""
    even = F.expr("cast(substring(account, 2) as bigint) % 2 = 0")
    return ~F.col("credit") | F.col("kind").isNull() | (F.col("kind") == "O") | ((F.col("kind") == "F") & even)


@query(f'{HEAD} SELECT anc AS account, CAST(sum(CASE WHEN {ACCEPTED} THEN delta ELSE 0 END) AS BIGINT) AS moved FROM posting JOIN path ON account = "desc" GROUP BY anc')
def ledger_kind_filtered(t: Tables) -> DataFrame:
    return ledger.subtree_fold(t.postings(), t.account_paths(), {"moved": F.when(accepted(), F.col("delta")).otherwise(0)})


@query(f"""WITH {POSTINGS}, s AS (SELECT account, pos, sum(delta) OVER w AS s FROM posting WINDOW w AS (PARTITION BY account ORDER BY pos))
SELECT pos, CAST(s + least({STATED}, min({CEILING} - s) OVER (PARTITION BY account ORDER BY pos)) AS BIGINT) AS after FROM s""")
def ledger_stepwise(t: Tables) -> DataFrame:
    return ledger.stepwise(t.postings(), ["account"], ["pos"], "delta", F.lit(STATED), F.lit(CEILING)).select("pos", "after")


CUTS = f"""{HEAD}, own AS (SELECT *, sum(delta) OVER (PARTITION BY account ORDER BY pos) AS s FROM posting),
leaf AS (SELECT account, pos, credit, s + least({STATED}, min({CEILING} - s) OVER (PARTITION BY account ORDER BY pos)) AS after FROM own),
applied AS (SELECT account, pos, after - coalesce(lag(after) OVER (PARTITION BY account ORDER BY pos), {STATED}) AS applied FROM leaf),
up AS (SELECT anc, pos, applied, sum(applied) OVER (PARTITION BY anc ORDER BY pos) AS s FROM applied JOIN path ON account = "desc" AND depth = 1),
lim AS (SELECT anc, pos, applied, s + least({STATED * 20}, min({CEILING * 20} - s) OVER (PARTITION BY anc ORDER BY pos)) AS after FROM up),
cut AS (SELECT anc, pos, applied, applied - (after - coalesce(lag(after) OVER (PARTITION BY anc ORDER BY pos), {STATED * 20})) AS cut FROM lim)"""


def _cuts(t: Tables) -> DataFrame:
    """anc, pos, applied at the posting's own account and cut at the account above it."""
    leaf = ledger.stepwise(t.postings(), ["account"], ["pos"], "delta", F.lit(STATED), F.lit(CEILING))
    applied = leaf.withColumn("applied", F.col("after") - F.coalesce(F.lag("after").over(Window.partitionBy("account").orderBy("pos")), F.lit(STATED)))
    up = applied.join(t.account_paths().where("depth = 1"), F.col("account") == F.col("desc")).select("anc", "pos", "applied")
    # A nation holds a share of all postings that does not fall with their number: its fold goes by blocks of positions.
    above = ledger.stepwise(up, ["anc"], ["pos"], "applied", F.lit(STATED * 20), F.lit(CEILING * 20), block=F.expr(f"pos div {BLOCK}"))
    return above.select("anc", "pos", "applied", (F.col("applied") - (F.col("after") - F.col("before"))).alias("cut"))


@query(f"{CUTS} SELECT anc AS account, pos, CAST(applied AS BIGINT) AS applied, CAST(cut AS BIGINT) AS cut FROM cut")
def ledger_cuts(t: Tables) -> DataFrame:
    return _cuts(t).withColumnRenamed("anc", "account")


@query(f"{CUTS} SELECT anc AS account, CAST(sum(applied) - sum(cut) AS BIGINT) AS moved FROM cut GROUP BY anc")
def ledger_sum_with_cuts(t: Tables) -> DataFrame:
    return _cuts(t).groupBy("anc").agg((F.sum("applied") - F.sum("cut")).alias("moved")).withColumnRenamed("anc", "account")


BALANCE = f"""{HEAD}, bal AS (SELECT anc AS account, {STATED} + sum(delta) AS balance FROM posting JOIN path ON account = "desc" GROUP BY anc),
avail AS (SELECT "desc" AS account, min(balance) AS available FROM path JOIN bal ON anc = account GROUP BY "desc")"""


def _available(t: Tables) -> DataFrame:
    paths = t.account_paths()
    bal = ledger.subtree_fold(t.postings(), paths, {"moved": F.col("delta")}).select(F.col("account").alias("a"), (F.lit(STATED) + F.col("moved")).alias("balance"))
    return paths.join(bal, F.col("anc") == F.col("a")).groupBy(F.col("desc").alias("account")).agg(F.min("balance").alias("available"))


@query(f"{BALANCE} SELECT account, CAST(available AS BIGINT) AS available FROM avail")
def ledger_available(t: Tables) -> DataFrame:
    return _available(t)


@query(f"{BALANCE} SELECT 'C' || c_custkey AS account, CAST(round(c_acctbal * 100) AS BIGINT) <= available AS fits FROM customer JOIN avail ON account = 'C' || c_custkey WHERE c_acctbal > 0")
def ledger_debit_guard(t: Tables) -> DataFrame:
    want = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("C"), "c_custkey").alias("account"), F.round(F.col("c_acctbal") * 100).cast("long").alias("amount"))
    return want.join(_available(t), "account").select("account", (F.col("amount") <= F.col("available")).alias("fits"))


@query(f'{HEAD} SELECT anc AS account, CAST(sum(CASE WHEN credit THEN 0 ELSE amount END) AS BIGINT) AS debits, CAST(sum(CASE WHEN credit AND {ACCEPTED} THEN amount ELSE 0 END) AS BIGINT) AS credits FROM posting JOIN path ON account = "desc" GROUP BY anc')
def ledger_flows(t: Tables) -> DataFrame:
    return ledger.subtree_fold(t.postings(), t.account_paths(), {"debits": F.when(F.col("credit"), 0).otherwise(F.col("amount")), "credits": F.when(F.col("credit") & accepted(), F.col("amount")).otherwise(0)})


@query(f"""WITH RECURSIVE {POSTINGS}, o AS (SELECT account, pos, delta, row_number() OVER (PARTITION BY account ORDER BY pos) AS i FROM posting),
r AS (SELECT account, i, pos, delta, CASE WHEN delta < 0 AND -delta > {STATED} THEN 0 ELSE delta END AS taken, {STATED} + CASE WHEN delta < 0 AND -delta > {STATED} THEN 0 ELSE delta END AS balance FROM o WHERE i = 1
UNION ALL SELECT o.account, o.i, o.pos, o.delta, CASE WHEN o.delta < 0 AND -o.delta > r.balance THEN 0 ELSE o.delta END, r.balance + CASE WHEN o.delta < 0 AND -o.delta > r.balance THEN 0 ELSE o.delta END FROM r JOIN o ON o.account = r.account AND o.i = r.i + 1)
SELECT pos, CAST(taken AS BIGINT) AS taken, CAST(balance AS BIGINT) AS balance FROM r""")
def ledger_replay(t: Tables) -> DataFrame:
    """Settle again in order; a debit beyond the balance is refused. Refusals make it a true fold."""

    def step(balance: int, row: tuple) -> tuple:
        pos, delta = row
        taken = 0 if delta < 0 and -delta > balance else delta
        return balance + taken, (pos, taken, balance + taken)

    return fold.ordered_fold(t.postings(), ["account"], ["pos"], ["pos", "delta"], lambda row: STATED, step, "pos long, taken long, balance long")


LATE = "late AS (SELECT *, CASE WHEN pos % 20 = 0 THEN greatest(1, pos - 300) ELSE pos END AS eff FROM posting)"


def late_of(t: Tables) -> DataFrame:
    """Postings with an effective position; every twentieth takes effect up to 300 earlier."""
    return t.postings().withColumn("eff", F.expr("if(pos % 20 = 0, greatest(1L, pos - 300), pos)"))


@query(f"WITH {POSTINGS}, {LATE} SELECT account, CAST(sum(delta) AS BIGINT) AS moved FROM late WHERE eff <= 600 AND pos <= 800 GROUP BY account")
def bitemporal_as_of(t: Tables) -> DataFrame:
    return late_of(t).where("eff <= 600 AND pos <= 800").groupBy("account").agg(F.sum("delta").alias("moved"))


@query(f"""WITH {POSTINGS}, {LATE}, s AS (SELECT account, pos, eff, sum(delta) OVER (PARTITION BY account ORDER BY eff, pos) AS s FROM late)
SELECT pos, CAST(s + least({STATED}, min({CEILING} - s) OVER (PARTITION BY account ORDER BY eff, pos)) AS BIGINT) AS after FROM s""")
def bitemporal_resettle(t: Tables) -> DataFrame:
    return ledger.stepwise(late_of(t), ["account"], ["eff", "pos"], "delta", F.lit(STATED), F.lit(CEILING)).select("pos", "after")


@query(f"WITH {POSTINGS}, {LATE} SELECT pos, eff FROM late WHERE NOT (eff >= 2 AND eff <= pos - (pos % 3))")
def late_never_forward(t: Tables) -> DataFrame:
    """Violations of a bound on effective positions (here a stricter one than the law, so that some exist)."""
    return late_of(t).where("NOT (eff >= 2 AND eff <= pos - (pos % 3))").select("pos", "eff")


@query(f"WITH {POSTINGS}, {LATE} SELECT account, CAST(sum(delta) AS BIGINT) AS moved FROM late WHERE eff <= 600 AND pos <= 600 + 300 GROUP BY account")
def late_capped_read(t: Tables) -> DataFrame:
    """The cap on reach bounds the recorded positions that the scan must read."""
    return late_of(t).where("pos <= 900").where("eff <= 600").groupBy("account").agg(F.sum("delta").alias("moved"))


REQUESTS = """request AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS wanted, o_orderpriority AS rank FROM orders),
pot AS (SELECT c_custkey AS k, CAST(greatest(0, round(c_acctbal * 50)) AS BIGINT) AS available FROM customer)"""


def requests_of(t: Tables) -> DataFrame:
    """k, id, wanted, rank of each order and what its customer has available."""
    pot = t.customer.select(F.col("c_custkey").alias("k"), F.greatest(F.lit(0.0), F.round(F.col("c_acctbal") * 50)).cast("long").alias("available"))
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").alias("wanted"), F.col("o_orderpriority").alias("rank")).join(pot, "k")


@query(f"""WITH {REQUESTS}, r AS (SELECT *, sum(wanted) OVER (PARTITION BY k) AS total FROM request JOIN pot USING (k))
SELECT k, CASE WHEN total <= available THEN 'granted' WHEN min(wanted) > available THEN 'refused' ELSE 'rationed' END AS outcome, count(*) AS n FROM r GROUP BY k, total, available""")
def ledger_merge(t: Tables) -> DataFrame:
    g = requests_of(t).groupBy("k", "available").agg(F.sum("wanted").alias("total"), F.min("wanted").alias("least"), F.count("*").alias("n"))
    return g.select("k", F.when(F.col("total") <= F.col("available"), "granted").when(F.col("least") > F.col("available"), "refused").otherwise("rationed").alias("outcome"), "n")


@query(f"""WITH {REQUESTS} SELECT id, CAST(greatest(0, least(wanted, available - coalesce(sum(wanted) OVER (PARTITION BY k ORDER BY rank, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS granted FROM request JOIN pot USING (k)""")
def ledger_by_rank(t: Tables) -> DataFrame:
    return ledger.ration_by_rank(requests_of(t), ["k"], [F.col("rank"), F.col("id")], "wanted", F.col("available")).select("id", "granted")


@query(f"""WITH {REQUESTS}, r AS (SELECT id, available * wanted AS x, CAST(sum(wanted) OVER (PARTITION BY k) AS BIGINT) AS s FROM request JOIN pot USING (k))
SELECT id, x // s AS down, (2 * x + s) // (2 * s) AS half_up, CASE WHEN 2 * (x % s) > s OR (2 * (x % s) = s AND (x // s) % 2 = 1) THEN x // s + 1 ELSE x // s END AS half_even FROM r""")
def ledger_proportional(t: Tables) -> DataFrame:
    r = requests_of(t).withColumn("s", F.sum("wanted").over(Window.partitionBy("k"))).withColumn("x", F.col("available") * F.col("wanted"))
    return r.select("id", F.expr("x div s").alias("down"), F.expr("(2 * x + s) div (2 * s)").alias("half_up"), F.expr("if(2 * (x % s) > s or (2 * (x % s) = s and (x div s) % 2 = 1), x div s + 1, x div s)").alias("half_even"))


REMAINDER = f"""WITH {REQUESTS}, r AS (SELECT *, available * wanted AS x, CAST(sum(wanted) OVER (PARTITION BY k) AS BIGINT) AS s FROM request JOIN pot USING (k)),
q AS (SELECT *, x // s AS q, x % s AS r FROM r), p AS (SELECT *, CAST(available - sum(q) OVER (PARTITION BY k) AS BIGINT) AS short, row_number() OVER (PARTITION BY k ORDER BY r DESC, id) AS place FROM q)"""


@query(f"{REMAINDER} SELECT id, q + CASE WHEN place <= short THEN 1 ELSE 0 END AS granted FROM p")
def ledger_largest_remainder(t: Tables) -> DataFrame:
    return ledger.largest_remainder(requests_of(t), ["k"], "wanted", F.col("available"), [F.col("id")]).select("id", "granted")


@query(f"""WITH {REQUESTS}, r AS (SELECT *, available * wanted AS x, CAST(sum(wanted) OVER (PARTITION BY k) AS BIGINT) AS s FROM request JOIN pot USING (k)),
n AS (SELECT *, (2 * x + s) // (2 * s) AS n FROM r), d AS (SELECT *, CAST(available - sum(n) OVER (PARTITION BY k) AS BIGINT) AS off, x - n * s AS err FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY err DESC, id) AS up, row_number() OVER (PARTITION BY k ORDER BY err, id) AS down FROM d)
SELECT id, n + CASE WHEN off > 0 AND up <= off THEN 1 WHEN off < 0 AND down <= -off THEN -1 ELSE 0 END AS granted FROM p""")
def ledger_nearest(t: Tables) -> DataFrame:
    w = Window.partitionBy("k")
    r = requests_of(t).withColumn("s", F.sum("wanted").over(w)).withColumn("x", F.col("available") * F.col("wanted")).withColumn("n", F.expr("(2 * x + s) div (2 * s)"))
    d = r.withColumn("off", F.col("available") - F.sum("n").over(w)).withColumn("err", F.col("x") - F.col("n") * F.col("s"))
    p = d.withColumn("up", F.row_number().over(w.orderBy(F.col("err").desc(), "id"))).withColumn("down", F.row_number().over(w.orderBy("err", "id")))
    return p.select("id", F.expr("n + case when off > 0 and up <= off then 1 when off < 0 and down <= -off then -1 else 0 end").alias("granted"))


@query(f"""WITH RECURSIVE {REQUESTS}, o AS (SELECT k, id, wanted, available, row_number() OVER (PARTITION BY k ORDER BY rank, id) AS i FROM request JOIN pot USING (k)),
r AS (SELECT k, i, id, CASE WHEN wanted <= available THEN wanted ELSE 0 END AS granted, available - CASE WHEN wanted <= available THEN wanted ELSE 0 END AS rest FROM o WHERE i = 1
UNION ALL SELECT o.k, o.i, o.id, CASE WHEN o.wanted <= r.rest THEN o.wanted ELSE 0 END, r.rest - CASE WHEN o.wanted <= r.rest THEN o.wanted ELSE 0 END FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
SELECT id, granted FROM r""")
def ledger_whole_each(t: Tables) -> DataFrame:
    """Each request in order is granted whole where it fits what is left, and nothing otherwise."""

    def step(rest: int, row: tuple) -> tuple:
        request, wanted, _ = row
        granted = wanted if wanted <= rest else 0
        return rest - granted, (request, granted)

    return fold.ordered_fold(requests_of(t), ["k"], ["rank", "id"], ["id", "wanted", "available"], lambda row: row[2], step, "id long, granted long")


@query(f"""WITH {REQUESTS}, pots AS (SELECT k, available, CAST(available // 2 AS BIGINT) AS first FROM pot), w AS (SELECT k, sum(wanted) AS total FROM request GROUP BY k)
SELECT k, CAST(least(total, first) AS BIGINT) AS from_first, CAST(least(greatest(total - first, 0), available - first) AS BIGINT) AS from_second, CAST(greatest(total - available, 0) AS BIGINT) AS unmet FROM pots JOIN w USING (k)""")
def ledger_waterfall(t: Tables) -> DataFrame:
    """Fill pots in turn: each takes what is left of the request, up to its size."""
    g = requests_of(t).groupBy("k", "available").agg(F.sum("wanted").alias("total")).withColumn("first", F.expr("available div 2"))
    return g.select("k", F.least("total", "first").alias("from_first"), F.least(F.greatest(F.col("total") - F.col("first"), F.lit(0)), F.col("available") - F.col("first")).alias("from_second"), F.greatest(F.col("total") - F.col("available"), F.lit(0)).alias("unmet"))


@query(f"""WITH {REQUESTS}, f AS (SELECT k, id, rank, wanted, available // 2 AS fund FROM pot JOIN request USING (k))
SELECT id, CAST(greatest(0, least(wanted, fund - coalesce(sum(wanted) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS held FROM f""")
def ledger_pots(t: Tables) -> DataFrame:
    """Requests draw from one fund in the order of their ids; half of what is available is held back."""
    r = requests_of(t).withColumn("fund", F.expr("available div 2"))
    return ledger.ration_by_rank(r, ["k"], [F.col("id")], "wanted", F.col("fund")).select("id", F.col("granted").alias("held"))


@query(f"""WITH RECURSIVE {POSTINGS}, acc AS (SELECT 'C' || c_custkey AS account, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS j FROM customer),
o AS (SELECT nation, j, pos, delta, row_number() OVER (PARTITION BY nation ORDER BY pos) AS i FROM posting JOIN acc USING (account)),
r AS (SELECT nation, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, CAST(0 AS BIGINT) AS asked, CAST(0 AS BIGINT) AS settled, list(CAST({STATED} AS BIGINT)) AS own, CAST({STATED * 20} AS BIGINT) AS top FROM acc GROUP BY nation
UNION ALL SELECT nation, i, pos, delta, take, list_transform(own, lambda x, k: CASE WHEN k = j THEN x + take ELSE x END), top + take
FROM (SELECT r.nation, o.i, o.pos, o.delta, o.j, r.own, r.top, CASE WHEN o.delta >= 0 THEN o.delta ELSE -least(-o.delta, greatest(0, least(r.own[o.j], r.top))) END AS take FROM r JOIN o ON o.nation = r.nation AND o.i = r.i + 1))
SELECT pos, settled, CASE WHEN settled = asked THEN 'granted' WHEN settled = 0 THEN 'refused' ELSE 'rationed' END AS outcome FROM r WHERE i > 0""")
def ledger_settle(t: Tables) -> DataFrame:
    """Settle each posting in order against the least balance on its account's path, and debit the path.

    Accounts settle alone until their nation's balance binds; only from there on are its postings one fold.
    """
    nation = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("account"), F.col("c_nationkey").cast("long").alias("group"))
    return settle.settle(t.postings().join(nation, "account"), STATED, STATED * 20)


@query(f"""WITH {REQUESTS}, p AS (SELECT *, CAST(available * wanted AS BIGINT) // CAST(sum(wanted) OVER (PARTITION BY k) AS BIGINT) AS part FROM request JOIN pot USING (k)) SELECT id, wanted, part FROM p WHERE part < wanted""")
def ledger_unmet(t: Tables) -> DataFrame:
    return ledger.unmet(requests_of(t), ["k"], "wanted", F.col("available")).select("id", "wanted", "part")


@query(f"""WITH {REQUESTS}, x AS (SELECT *, CAST(sum(wanted) OVER (PARTITION BY k) AS BIGINT) AS total FROM request JOIN pot USING (k)), q AS (SELECT *, available * wanted // total AS q, available * wanted % total AS r FROM x),
u AS (SELECT *, q < wanted AS lacks, CAST(available - sum(q) OVER (PARTITION BY k) AS BIGINT) AS short, row_number() OVER (PARTITION BY k, q < wanted ORDER BY r DESC, id) AS place FROM q WHERE total > available)
SELECT id, CASE WHEN lacks AND place <= short THEN q + 1 ELSE q END AS granted FROM u""")
def ledger_apportion(t: Tables) -> DataFrame:
    """Where not all can have what they want: whole shares, and the units left go to the unmet ones of the largest remainders."""
    total = F.sum("wanted").over(Window.partitionBy("k"))
    x = requests_of(t).withColumn("total", total).where("total > available").withColumn("x", F.col("available") * F.col("wanted"))
    q = x.withColumn("q", F.expr("x div total")).withColumn("r", F.expr("x % total")).withColumn("lacks", F.col("q") < F.col("wanted"))
    short = F.col("available") - F.sum("q").over(Window.partitionBy("k"))
    place = F.row_number().over(Window.partitionBy("k", "lacks").orderBy(F.col("r").desc(), "id"))
    return q.select("id", (F.col("q") + F.when(F.col("lacks") & (place <= short), 1).otherwise(0)).alias("granted"))


@query(f"""WITH {REQUESTS}, g AS (SELECT k, available, rank, count(*) AS n, sum(wanted) AS asked FROM request JOIN pot USING (k) GROUP BY ALL),
l AS (SELECT *, CAST(available - coalesce(sum(asked) OVER (PARTITION BY k ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "left" FROM g)
SELECT k, rank, "left" FROM l WHERE n > 1 AND "left" > 0 AND "left" < asked""")
def ledger_ties(t: Tables) -> DataFrame:
    return ledger.tie_arises(requests_of(t), ["k"], "rank", "wanted", "available")


@query(f"""WITH {REQUESTS}, a AS (SELECT *, CAST(greatest(0, least(wanted, available // 2 - coalesce(sum(wanted) OVER (PARTITION BY k, rank ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS claim FROM request JOIN pot USING (k))
SELECT id, CAST(greatest(0, least(claim, available - coalesce(sum(claim) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS granted FROM a""")
def ledger_purposes(t: Tables) -> DataFrame:
    """Requests of one purpose share half of what is available; all of them share the whole."""
    return ledger.nested_ration(requests_of(t), [(["k", "rank"], F.expr("available div 2")), (["k"], F.col("available"))], [F.col("id")], "wanted").select("id", "granted")
