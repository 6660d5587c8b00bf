import re
from collections import defaultdict

import pytest
from graphloom.llm import queries, url_filter


#: The contract's five rules, written out.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_rules():
    assert list(url_filter.RULES) == RULES


def brute(pages):
    """pages: (id, url, html). (id, host, path, rule, verdict) by the definitions, with plain loops."""
    rows = []
    for i, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = []
        for verdict, rule in RULES:
            name, _, start = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fits.append((len(rule), len(name), verdict == "allow", rule, verdict))
        best = max(fits, default=(0, 0, 0, None, None))
        rows.append((i, host, path, best[3], best[4], html))
    good, bad, n = defaultdict(float), defaultdict(float), defaultdict(int)
    links = defaultdict(int)
    for _, host, _, _, verdict, html in rows:
        if host:
            n[host] += 1
            good[host] += verdict == "allow"
            bad[host] += verdict == "block"
            for to in {x.lower() for x in re.findall(url_filter._LINK, html or "")} - {host}:
                links[host, to] += 1
    hosts = set(n) | {d for _, d in links}
    g, b = ({h: x[h] / n[h] if n[h] else 0.0 for h in hosts} for x in (good, bad))
    g, b = ({h: v / (sum(x.values()) or 1) for h, v in x.items()} for x in (g, b))
    outs, ins = defaultdict(int), defaultdict(int)
    for (s, d), k in links.items():
        outs[s] += k
        ins[d] += k
    t, u = dict(g), dict(b)
    for _ in range(url_filter.ITERATIONS):
        nt, nu = {h: 0.15 * g[h] for h in hosts}, {h: 0.15 * b[h] for h in hosts}
        for (s, d), k in links.items():
            nt[d] += 0.85 * t[s] * k / outs[s]
            nu[s] += 0.85 * u[d] * k / ins[d]
        t, u = nt, nu
    if not links:
        t, u = ({h: 0.15 * v for h, v in x.items()} for x in (g, b))
    return [(i, h, p, r, v or ("block" if h and u[h] > t[h] and u[h] >= url_filter.THRESHOLD * (1 - 1e-9) * sum(u.values()) / len(hosts) else "allow")) for i, h, p, r, v, _ in rows]


def test_query_against_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = [tuple(r) for r in queries.op10_url_filter(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(pages))
    assert {r[4] for r in got} == {"allow", "block"}


def test_links_carry_distrust_back_and_trust_on(spark):
    def page(*hosts):
        return "".join(f'<a HREF="//{h}/x">x</a>' for h in hosts)

    pages = [
        (1, "http://bad.com/en/1", page("other.info")), (2, "http://linker.info/a", page("bad.com", "BAD.com")), (3, "http://Good.example.com/en/7x?q#f", page("friend.info")),
        (4, "https://friend.info", None), (5, None, None), (6, "no scheme", ""), (7, "http://friend.info?x", ""), (7, "http://friend.info?x", ""), (None, "x://bad.com/fr", page("bad.com")), (9, "http://a.example.net/de/81", ""),
    ]
    d = spark.createDataFrame([(*p, 1, "v") for p in pages], "page_id long, url string, html string, host int, verdict string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge(d).collect()}
    assert got[1, "bad.com", "/en/1"] == ("com/en/", "block")
    assert got[3, "good.example.com", "/en/7x"] == ("example.com/en/7", "allow")
    assert got[9, "a.example.net", "/de/81"] == ("example.net/de/8", "block")
    assert got[2, "linker.info", "/a"] == (None, "block")
    assert got[4, "friend.info", ""] == (None, "allow")
    assert got[5, "", ""] == got[6, "", ""] == (None, "allow")
    assert sorted(map(repr, (tuple(r)[:5] for r in url_filter.judge(d).collect()))) == sorted(map(repr, brute(pages)))
    assert url_filter.judge(d.limit(0)).count() == 0


@pytest.mark.parametrize(("url", "want"), [("http://A.b/c?d", ("a.b", "/c")), ("x://h#f", ("h", "")), ("a:/b", ("", "")), ("", ("", "")), (None, ("", "")), ("://É.x/É", ("É.x", "/É"))])
def test_host_and_path(spark, url, want):
    d = spark.createDataFrame([(url,)], "url string")
    assert tuple(d.select(*url_filter.host_and_path(d["url"])).first()) == want
