import random
from html.parser import HTMLParser

import pyarrow as pa

from graphloom.llm import html_extract, queries
from graphloom.llm.html_extract import ARTICLE, FURNITURE, PLAIN, common_subsequence, deleted, lines_of
from graphloom.llm.neighbours import OWN


def test_lines_and_kinds():
    page = (
        "<!doctype html><html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=ad>Buy</div><!-- note <p>x</p> -->"
        "<article><h1>Head &amp; line</h1><p>One <b>bold</b>\n  two&nbsp;three<p>Next<br>row<script>var a='</p>'</script>"
        "<div class='comments'><p>Nice!</p></div><footer>foot</footer></article><p>outside<aside>side</aside><form>f<input></form>"
    )
    assert lines_of(page) == [
        ("Home", FURNITURE), ("Buy", FURNITURE), ("Head & line", ARTICLE), ("One bold two three", ARTICLE), ("Next", ARTICLE), ("row", ARTICLE),
        ("Nice!", FURNITURE), ("foot", FURNITURE), ("outside", PLAIN), ("side", FURNITURE), ("f", FURNITURE),
    ]
    assert lines_of(None) == lines_of("") == []
    assert lines_of("a < b &lt; c <p") == [("a < b < c <p", PLAIN)]


def brute_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence_is_longest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in "ab")
        at = common_subsequence(a, b)
        assert len(at) == brute_length(a, b)
        assert at == sorted(set(at))
        rest = iter(b)
        assert all(a[k] in rest for k in at)


def test_pages_without_marks_lose_the_lines_of_their_nearest_page(spark, monkeypatch):
    def page(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"

    rows = [
        (1, "http://H.x/a/1", page("Top", "Menu", "first story", "End")),
        (2, "http://h.x/a/2", page("Top", "Menu", "second story", "more", "End")),
        (3, "http://h.x/b/1", page("Other", "third", "End")),
        (4, "http://alone.x/", page("Top", "all stays")),
        (5, "http://h.x/b/1", page("Other", "third", "End")),
        (6, None, page("no url")),
        (7, "nourl", None),
    ]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, role int")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    # Page 5 repeats page 3: they are one page, with one neighbour and one text.
    assert got == {1: "first story", 2: "second story\nmore", 3: "Other\nthird", 4: "Top\nall stays", 5: "Other\nthird", 6: "no url", 7: ""}
    assert html_extract.extract(pages.limit(0)).count() == 0
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == got


def test_runs_of_equal_pages_and_pages_that_share_all(spark):
    def page(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"

    rows = [(k, f"http://h.x/s/{k // 4}?q={k}", page("Top", "Menu", f"story {k // 4}", "End")) for k in range(40)]  # runs of four equal pages
    rows += [(100, "http://other.x/1", page("Top", "one")), (101, "http://other.x/2", page("Top", "one", "two")), (None, "http://other.x/2", page("Top", "one", "two"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text) for r in html_extract.extract(pages).collect()), key=str)
    want = [(k, f"story {k // 4}") for k in range(40)] + [(100, "Top\none"), (101, "two"), (None, "two")]  # all lines of 100 are on 101: it is a copy and keeps them
    assert got == sorted(want, key=str)


def test_hand_written_pages(spark):
    article = "<article><header><h1>A &lt;b&gt; title</h1></header><p>First&nbsp;para\n with <i>words</i>.</p><ul><li>one</li><li>two</li></ul><blockquote>Said &quot;so&quot;</blockquote><div class='share-buttons'>Share</div><section id='comments'><p>Great post</p></section></article>"
    html = f"<html><head><title>T</title><script>if (a < b) document.write('<p>no</p>')</script></head><body><div role='banner'>Brand</div><nav>Home</nav><div id=cookie-notice>We use cookies</div><main>{article}</main><aside>Related</aside><form><label>Mail</label></form><footer>(c)</footer></body></html>"
    got = html_extract.extract(spark.createDataFrame([(1, "http://h.x/a", html), (2, "http://h.x/b", html.replace("First", "Other"))], "page_id long, url string, html string")).orderBy("page_id").collect()
    text = 'A <b> title\nFirst para with words.\none\ntwo\nSaid "so"'
    assert [r.text for r in got] == [text, text.replace("First", "Other")]


def test_text_of_articles_is_kept_whole():
    def article(inner):
        found = lines_of(f"<article>{inner}</article>")
        return [t for t, kind in found if kind == ARTICLE]

    assert article('<p>alpha <span class="share">x</span> beta</p>') == ["alpha beta"]
    assert article('<p>alpha <a class="ad" href=x>x <b>y</b></a>beta<button>go</button>!</p><p>z</p>') == ["alpha beta!", "z"]
    assert article('<p>a <span class="share">x<div>y</div></p><p>b</p>') == ["a", "b"]  # the end of the paragraph ends it
    assert article('<div class="discussion"><p>We found</p></div><h2 id="related-work">Related work</h2><p class="side note">Note</p>') == ["We found", "Related work", "Note"]
    assert article('<div class="related"><p>Studies <a href=1>one</a> that came before ours</p></div>') == ["Studies one that came before ours"]
    assert article('<p>x</p><div class="related-posts"><a href=1>One story</a><p><a href=2>Another</a> 1</p></div><p>y</p>') == ["x", "y"]
    assert article("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><object>flat</object><audio>no sound</audio><p>q</p>") == ["let x=1 be", "flatno sound", "q"]
    assert article('<section id="comments"><p>Great</p></section><div class="share-buttons">Share</div><p>t</p>') == ["t"]
    assert article("<nav>menu</nav><aside>side</aside><form>mail</form><p hidden>h</p><p>t</p>") == ["t"]


class Reader(HTMLParser):
    """The texts of blocks in an article, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.now, self.out, self.skip = 0, "", [], 0

    def end(self):
        if self.now.split():
            self.out.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        if tag not in ("a", "b", "i", "em", "span"):
            self.end()

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em", "span"):
            self.end()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.now += data


def test_query_against_another_reader(spark, sf_dir):
    pages = {p.page_id: p for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op4_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        reader = Reader()
        reader.feed(pages[r.page_id].html or "")
        reader.close()
        assert r.text == "\n".join(reader.out) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_marked_pages_of_a_host_are_spread(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    rows = [(k, f"http://h.x/{k}", f"<article><p>t{k}</p></article>") for k in range(300)] + [(1000 + k, f"http://h.x/u/{k}", f"<div>Top</div><div>u{k}</div>") for k in range(20)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == {k: f"t{k}" for k in range(300)} | {1000 + k: f"u{k}" for k in range(20)}


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op4_html_text(spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for p in pages:
        want = "\n".join(t for t, kind in lines_of(p.html) if kind == ARTICLE)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and want


def test_marked_pages_lose_what_their_marks_leave_in_doubt(spark, monkeypatch):
    def page(k, *, notice="We use cookies", story=None):
        return f"<nav>Menu</nav><article><h1>Head {story or k}</h1><p>story {story or k}</p><div class='notice'><p>{notice}</p><p>Agreed</p></div><blockquote>quoted by all</blockquote><p>end {story or k}</p></article>"

    def text(k, *notice):
        return "\n".join([f"Head {k}", f"story {k}", *notice, "quoted by all", f"end {k}"])

    rows = [
        *[(k, f"http://h.x/a/{k}", page(k)) for k in range(3)],
        (3, "http://own.x/a/3", page(3)), (4, "http://own.x/a/4", page(4, notice="Part of this story")),  # not all lines of the element are shared
        (5, "http://copy.x/a/5", page(5)), (6, "http://copy.x/a/6", page(5).replace("end 5", "end 6")),  # copies of one story, and so of its notice
        (7, "http://alone.x/7", page(7)), (8, None, page(8)),
        (9, "http://h.x/a/0?q", page(0).replace(" class='notice'", "")), (10, "http://h.x/a/0?r", page(0)),  # the lines of page 0, with and without the mark
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {0: text(0), 1: text(1), 2: text(2), 3: text(3, "We use cookies", "Agreed"), 4: text(4, "Part of this story", "Agreed"), 5: text(5, "We use cookies", "Agreed"), 7: text(7, "We use cookies", "Agreed"), 8: text(8, "We use cookies", "Agreed"), 9: text(0, "We use cookies", "Agreed"), 10: text(0)}
    want[6] = want[5].replace("end 5", "end 6")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want


def test_marked_pages_are_aligned(monkeypatch):
    """Each page with a neighbour goes through the differencing: the marks are asked about what it deletes."""
    html = [f"<nav>Menu</nav><article><p>all say so</p><p>story {k}</p></article><p>End</p>" for k in range(3)]
    batch = pa.RecordBatch.from_pydict({"host": ["h.x"] * 3, "path": [f"/{k}" for k in range(3)], "at": [0, 1, 2], "html": html})
    (outlines,) = html_extract._outlined(iter([batch]))
    rows = [r | {"marks": [r["marks"]], "role": OWN} for r in outlines.to_pylist()]
    asked = []
    monkeypatch.setattr(html_extract, "deleted", lambda marks, shared: asked.append(shared) or deleted(marks, shared))
    assert list(html_extract._shared(iter([pa.RecordBatch.from_pylist(rows)]))) == []  # the article's shared line is a quotation
    assert asked == [[0, 1, 3]] * 3
