from collections import defaultdict

from graphloom.llm import line_dedup, queries


def brute(rows, ratio, least, share):
    """rows: (id, host, text). Texts after dropping, line counts and drops, a page at a time."""
    pages = defaultdict(set)
    for _, h, t in rows:
        if t is not None:
            pages[h].add(t)
    bad = {}
    for h, texts in pages.items():
        counts = defaultdict(int)
        for t in texts:
            for line in {x.strip(" ") for x in t.split("\n")} - {""}:
                counts[line] += 1
        bad[h] = {line for line, n in counts.items() if n >= least and n > ratio * len(texts)}
    out = []
    for i, h, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad[h]]
        short = "\n".join(kept)
        out.append((i, t, len(lines), 0) if len(short) < share * len(t) else (i, short, len(lines), len(lines) - len(kept)))
    return out


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in queries.op5_line_dedup(spark, sf_dir).collect()]
    want = brute(rows, line_dedup.RATIO, line_dedup.LEAST_PAGES, line_dedup.KEPT_SHARE)
    assert sorted(got) == sorted(want) and sum(r[3] for r in got) > 0


def test_hosts_copies_and_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    rows = [(k, "h" if k % 2 else None, f"nav\n  only {k} \nfoot " + "x" * 40) for k in range(40)]
    rows += [(k, "h", "nav\ncopied page text\nof many copies") for k in range(100, 130)]  # one page in 30 copies
    rows += [(200, "h", "nav"), (201, "h", None), (202, "h", ""), (202, "h", ""), (None, "other", "nav\nnav")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, _line int, host_pages string")
    got = line_dedup.without_boilerplate(docs, "source", 0.3)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
    want = brute(rows, 0.3, line_dedup.LEAST_PAGES, line_dedup.KEPT_SHARE)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == sorted(want, key=repr)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[100] == "copied page text\nof many copies" and texts[200] == "nav"


def test_odd_rows(odd, empty):
    got = line_dedup.without_boilerplate(odd, "source").collect()
    assert len(got) == 11 and {(r.doc_id, r.n_lines, r.n_dropped) for r in got if r.text is None} == {(1, 0, 0)}
    assert line_dedup.without_boilerplate(empty, "source").count() == 0
