import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from lodestat.llm import html as H
from lodestat.llm.queries import QUERIES
from tests.conftest import SF


def article(page):
    """The test pages hold one article of headings and paragraphs, some of them left open."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p|br)>", body)
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op9_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


CASES = [
    (None, ""), ("", ""), ("plain &amp; &#233; text", "plain & é text"), ("<p>a<p>b <b>c</b>d", "a\nb cd"), ("<body>x<nav>n</nav>y", "x\ny"),
    ("<article><header><h1>T</h1></header><p>a\n\t b</p><aside>s</aside></article>q", "T\na b"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
    ("<script>var a='<p>x</p>';</script><style>p{}</style>ok", "ok"), ("<div class='main ad-box'>x</div><div>y<br>z</div>", "y\nz"),
    ("<div hidden>x</div><p style='display: none'>x</p><div id=cookie_bar>x</div>1 < 2 & 3<", "1 < 2 & 3<"), ("a<!-- b -->c<p", "ac"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<div>" * 5000 + "deep", "deep"), ("</p></div>x</b>", "x"), ("<form>f</form><section class=comments>c</section>&nbsp;t&nbsp; ", "t"),
    ("<article>a</article><main>b</main>", "a\nb"), ("w " * 100000, " ".join(["w"] * 100000)), ("&lt;p&gt; not a tag", "<p> not a tag"),
    ("<p>Fish</p><p><a title=it's>x</a></p><p>rest of it</p>", "Fish\nx\nrest of it"), ("<p title='it's'>a</p><p>b'</p>", "a\nb'"), ("<p title=\"a>b\">c</p>", "c"),
    ("<article><div class='article-header'><h1>T</h1></div><p class=social-policy>p</p><div class='cookie-banner'>c</div></article>", "T\np"),
    ("<div class='header'>h</div><article><div class='header'><h1>T</h1></div>t</article>", "T\nt"), ("<div class='site-header'>h</div><p id=page-footer>f</p>t", "t"),
]


@pytest.mark.parametrize("page,text", CASES, ids=range(len(CASES)))
def test_pages(page, text):
    assert H.main_text(page, set()) == text


def test_templates_per_host(spark, monkeypatch):
    rows = [(i, f"http://a.b/{i}", f"<div><p>Site  line</p><p>body {i}</p></div><div class=x>Join us</div>") for i in range(8)]
    rows += [(20 + i, f"http://c.d:80/{i}", f"<p>Site line</p><p>{'Join us' if i < 3 else i}</p>") for i in range(8)]
    rows += [(40, None, "<p>Site line</p>"), (41, "x", None), (42, "http://a.b/q", "<article>Join us</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("h"))
    for size in (H.TEMPLATE_BYTES, -1):
        monkeypatch.setattr(H, "TEMPLATE_BYTES", size)
        got = {r.page_id: r.text for r in H.extract(pages).collect()}
        assert all(got[i] == f"body {i}" for i in range(8)) and got[42] == "Join us"
        assert got[20] == "Join us" and got[25] == "5" and got[40] == "Site line" and got[41] == ""
    assert H.extract(pages.limit(0)).count() == 0
    assert H.extract(pages.unionByName(pages)).count() == 2 * len(rows)


def test_copies_of_a_page_are_no_template(spark):
    """Six of ten pages of a host hold one article; what all distinct pages share goes, though no tag or class tells."""
    shell = lambda body: f"<div><p>Join us today</p></div><article>{body}<p>All rights</p></article><div>Site {7}</div>"
    rows = [(i, "http://a.b/x", shell("<p>One</p><p>Two</p>")) for i in range(6)]
    rows += [(6 + i, f"http://a.b/{i}", shell(f"<p>Other {i}</p>")) for i in range(4)]
    rows += [(20 + i, f"http://q.r/{i}", f"<p>Only</p><p>Text</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert all(got[i] == "One\nTwo" for i in range(6)) and got[6] == "Other 0"
    assert all(got[20 + i] == "Only\nText" for i in range(9))
    off = {r.page_id: r.text for r in H.extract(pages, min_pages=99).collect()}
    assert off[0] == "One\nTwo\nAll rights"
