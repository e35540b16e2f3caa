import html
import random
import re
from collections import defaultdict

import pytest
from helpers import SMALL, small
from pyspark.sql import functions as F

from gradeflow.llm import html_text as H
from gradeflow.llm import queries

SCHEMA = "page_id long, url string, html string, text string, host string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows], SCHEMA)
    return {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in H.main_text(df).collect()}


def article_by_template(source):
    """The article of the test pages, whose template is known."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_test_pages(spark):
    got = {r["page_id"]: r for r in queries.QUERIES["op11_html_text"](spark, SMALL).collect()}
    pages = small("pages")
    assert len(got) == len(pages)
    for p in pages:
        want = article_by_template(p["html"])
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
        assert got[p["page_id"]]["url"] == p["url"]


def covered_by_brute_force(pages):
    """Positions in a run of adjacent stream blocks, five words or more, that some page of the host with another
    longest block holds too; for pages whose text depends on it."""
    runs, parsed = defaultdict(set), []
    for host, source in pages:
        blocks = H.blocks_of(source)
        tokens = H.stream_of(blocks)
        longest = max((b for b in blocks if b.region != H.CHROME), key=lambda b: b.words, default=None)
        page = longest.text if longest else ""
        mine = []
        for i in range(len(tokens)):
            for j in range(i, len(tokens)):
                if tokens[j][0] != tokens[i][0] + j - i:
                    break
                texts = tuple(blocks[t[0]].text for t in tokens[i:j + 1])
                if sum(len(t.split()) for t in texts) >= 5:
                    runs[host, texts].add(page)
                    mine.append((texts, [t[0] for t in tokens[i:j + 1]]))
        parsed.append((host, H.asks(blocks), page, mine))
    return [sorted({at for texts, ats in mine if runs[host, texts] - {page} for at in ats}) if asks else []
            for host, asks, page, mine in parsed]


def random_pages(seed, n):
    rnd = random.Random(seed)
    items = ["Home", "About us", "Contact", "Terms of use", "Log in", "Read our newsletter every single week", "All rights kept"]
    pages = []
    for _ in range(n):
        host = rnd.choice(["a.example", "a.example", "b.example", "c.example"])
        blocks = rnd.choices(items, k=rnd.randint(0, 9))
        for _ in range(rnd.randint(0, 4)):
            blocks.insert(rnd.randint(0, len(blocks)), " ".join(rnd.choices("alpha beta gamma delta".split(), k=rnd.randint(1, 9))))
        tag = rnd.choice(["div", "p"])
        body = "".join(f"<{tag}>{b}</{tag}>" if rnd.random() < .8 else f"<p class=ad>{b}</p>" for b in blocks)
        if rnd.random() < .2:
            body = f"<div>{items[5]}</div><article><p>{body}</p><ul><li><a href=x>{items[5]}</a></ul></article>"
        pages.append((host, body))
    return pages


@pytest.mark.parametrize("seed,partitions", [(1, 8), (2, 3), (3, 40)])
def test_array_against_brute_force(spark, seed, partitions):
    pages = random_pages(seed, 120)
    df = spark.createDataFrame([(h, 0, i, s) for i, (h, s) in enumerate(pages)], "host string, k1 long, k2 long, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["k2"]: r["covered"] for r in H.covered_blocks(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = covered_by_brute_force(pages)
    assert [got.get(i, []) for i in range(len(pages))] == want
    assert sum(map(bool, want)) > 20


def test_boilerplate_of_undeclared_pages(spark):
    """No article, no telling names: the template of a host goes, unique runs and copies stay."""
    def page(k):
        story = "".join(f"<p>Story {k} part {j} tells of thing {k * 7 + j} and of nothing else here</p>" for j in range(3))
        return ("<div><a href=1>Home</a></div><div>Welcome to the daily paper of the valley</div>" + story
                + "<div>Write to the editors at the old mill</div><div>Open</div>")
    rows = [(k, f"http://paper.example/{k}", page(k)) for k in range(6)]
    rows += [(100 + k, f"http://paper.example/copy{k}", page(3)) for k in range(4)] + [(200, "http://other.example/", page(9))]
    got = run(spark, rows)
    story = "\n".join(f"Story 3 part {j} tells of thing {21 + j} and of nothing else here" for j in range(3))
    assert all(got[k][1] == story for k in (3, 100, 101, 102, 103))
    # pages that agree in their longest block count as copies of one page, among which nothing repeats
    assert "Welcome" in run(spark, [(k, "http://p.example/", f"<p>{k}</p>" + page(3)) for k in range(3)])[0][1]
    assert "editors" in got[200][1]  # alone on its host: nothing repeats
    # an article's prose stays although all pages hold it, its covered link lists go
    shared = "<article><h1>T{0}</h1><p>What page {0} alone has to say about the number {0}</p><p>the very same license line on every page</p><ul><li><a href=x>Read more of our best stories today</a></ul></article>"
    got = run(spark, [(k, "http://l.example/x", shared.format(k)) for k in range(3)])
    assert got[0][1] == "T0\nWhat page 0 alone has to say about the number 0\nthe very same license line on every page"


CHROME = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header id=top><h2>Site</h2></header>
<div role="navigation">x</div><div class="cookie-notice">We use cookies</div><noscript>no</noscript>{}
<section id="comments"><article class="comment">I disagree</article></section><form><label>Name</label><input></form>
<div class='col sidebar-right'>Also<article>teaser</article></div><div hidden>secret</div><footer>f</footer></body></html>"""


@pytest.mark.parametrize("inner,text", [
    ("<article><header><h1>Head &amp; line</h1></header><p>One\n two&nbsp;three<p>Four<br>five</article>", "Head & line\nOne two three\nFour five"),
    ("<main><p>Body</p><div class=share>Share</div><nav>n</nav></main>", "Body"),
    ("<div class='post-content'><p>a <b>b</b><i>c</i> &lt;d&gt; &#233;</p><blockquote>q</blockquote></div>", "a bc <d> é\nq"),
    ("<article><p>5 < 6 <span class=ad>buy</span>yes<script>if (a</p>) {}</script></p><ul><li>1<li>2</ul>", "5 < 6 yes\n1\n2"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><aside>no</aside><pre>x\ty</pre><dl><dt>k<dd>v</dl></article>", "a b\nc\nx y\nk\nv"),
    ("<article></article>", ""),
])
def test_regions(inner, text):
    assert H.text_of(CHROME.replace("{}", inner)) == text


@pytest.mark.parametrize("source", [None, "", "<", "<!--", "<!-- x", "</p>", "<p", "<a href='x", "<script>x", "&", "<article", "<title>", "< a>", "</"])
def test_broken_markup(source):
    assert isinstance(H.text_of(source), str)
    assert H.text_of(f"<article><p>kept</p></article>{source or ''}") == "kept"


def test_edges(spark):
    assert run(spark, []) == {}
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    got = run(spark, [(1, None, None), (2, "u", ""), (None, None, "<p>x"), (3, "http://h/", long), (4, "//H.example:80/p", "<p>y")])
    assert got[1] == (None, "", 0) and got[2] == ("u", "", 0) and got[None][1] == "x" and got[4][1] == "y"
    assert got[3][2] == 30_000 * 5 - 1
    same = spark.createDataFrame([(7, "http://h/", "<article>z</article>")] * 5, "page_id long, url string, html string")
    assert [r["text"] for r in H.main_text(same).collect()] == ["z"] * 5
    urls = spark.createDataFrame([(u,) for u in ("HTTP://A.b:8/x", "//u@c/d", "c/d", None)], "u string")
    assert [r[0] for r in urls.select(H.host_of(F.col("u"))).collect()] == ["a.b", "c", "", ""]


def test_packed_rows_sort_by_tokens():
    a, b = b"\x05" * 8, b"\x00" * 8
    rows = [H.pack(b, [a], b"p" * 8, b"k" * 16, 3, [9], True), H.pack(b, [a, b], b"o" * 8, b"k" * 16, 4, [1, 2], False)]
    assert rows == sorted(rows)
    assert H.unpack(rows[1]) == (b + b"\1" + a + b"\1" + b, b"o" * 8, b"k" * 16, 4, 0, bytes([1, 2]))
    assert H.common(H.unpack(rows[0])[0], H.unpack(rows[1])[0]) == 1
