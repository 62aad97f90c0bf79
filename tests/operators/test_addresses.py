"""Resolution of references to addresses, and character references, against Python's library."""

import html
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from folioforge.functions.references import decoded
from folioforge.functions.text import absolute, html_text
from folioforge.operators.pages import page_links

#: The examples of RFC 3986, section 5.4, but for the one that a lenient reader takes otherwise.
BASE = "http://a/b/c/d;p?q"
NORMAL = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g"]
ABNORMAL = ["../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "g#s/../x"]


def test_references_resolve_as_the_standard_says(spark):
    rows = [(b, h) for b in (BASE, "http://a", "http://a/b/c/../d/", "https://host.org/x/y#top") for h in [*NORMAL, *ABNORMAL, "https://b.org/x/../y?z", "mailto:me@x.org"]]
    got = spark.createDataFrame(rows, "base string, href string").select("base", "href", absolute(F.col("base"), F.col("href")).alias("dst")).collect()
    wrong = [(r["base"], r["href"], r["dst"]) for r in got if r["dst"].rstrip("/") != _joined(r["base"], r["href"]).rstrip("/")]
    assert not wrong
    exact = {r["href"]: r["dst"] for r in got if r["base"] == BASE}
    assert exact["../.."] == "http://a/" and exact[".."] == "http://a/b/" and exact["g/./h"] == "http://a/b/c/g/h" and exact["../../../g"] == "http://a/g"


def _joined(base, href):
    if href.startswith("https://"):
        return href.replace("/x/..", "")
    return urldefrag(urljoin(base, href)).url


def test_character_references_are_decoded_as_by_python(spark):
    texts = [
        "", "plain", "a &amp; b", "&lt;p&gt; &quot;q&quot; &#39;s&#39;", "&#x2014;&#8212;&#X2014;", "&eacute;&Eacute;&copy 2024 &copyright &notit; &notin;", "&amp;lt; &ampamp;", "&nosuch; &; & &&", "&#150;&#x80;&#0;&#xD800;&#x110000;&#99999999999;", "&#1;x&#127;y&#xFFFE;z",
        "&#128512;&#x1F600;", "x&nbsp;y&hellip;", "&fjlig; &NotEqualTilde; &acE;", "tail&", "&#; &#x; &#xG;", "&lt", "&AMP;&AMP", "caf&eacute", "&#13;", "&#00065;",
    ]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decoded(F.col("t")).alias("d")).collect()
    assert [(r["t"], r["d"]) for r in got if r["d"] != html.unescape(r["t"])] == []


def test_links_in_any_quotes(spark):
    page = """<a href="a.html">A</a> <A class=x HREF='/b?x=1&amp;y=2'>B &amp; <b>b</b></A ><a data-href="no" href=c/../d.html>C</a><a name="x">none</a><a href = "">self</a><a href="#top">top</a><a data-href="no">no</a>"""
    pages = spark.createDataFrame([(1, "http://h.org/p/q.html", page), (2, None, page), (3, "http://h.org/", None)], "page_id int, url string, html string")
    got = [(r["dst"], r["anchor"]) for r in page_links(pages).orderBy("page_id", "place").collect()]
    assert got == [("http://h.org/p/a.html", "A"), ("http://h.org/b?x=1&y=2", "B & b"), ("http://h.org/p/d.html", "C"), ("http://h.org/p/q.html", "self"), ("http://h.org/p/q.html", "top")]
    text = spark.createDataFrame([("<p>caf&eacute; &#8212; &amp;lt;</p>",)], "h string").select(html_text(F.col("h"))).first()[0]
    assert text == "café — &lt;"
