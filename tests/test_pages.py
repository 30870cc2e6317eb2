"""Markup that browsers read without complaint, main text by density, and addresses in one form."""

from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import html, urls
from corpusmill.operators import pages


def texts(markup):
    return [b["text"] for b in html.page(markup)["blocks"]]


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("a < b and 1<2 <3", ["a < b and 1<2 <3"]),
        ("<p>x<!-- <p>no --> y<!-- never closed <p>z", ["x y"]),
        ("<div title='a > b' data-x=\"</div>\">in</div>", ["in"]),
        ("<script>if (a<b) '</p>';</scripty></script >after", ["after"]),
        ("<STYLE>p{}</style><P>Shown<BR>two</P>", ["Shown two"]),
        ("<script>never closed <p>gone", []),
        ("<p>never closed tag <a href='x", ["never closed tag"]),
        ("a<b>bo</b>ld<i>er</i>", ["abolder"]),
        ("</ no><?php echo ?><!DOCTYPE html>t", ["t"]),
        ("<svg><text>no</text><svg></svg>no</svg>yes", ["yes"]),
        ("&lt;p&gt; &amp;amp; &eacute;&#x41;&nbsp;​ﬁn", ["<p> &amp; éA fin"]),
        ("<textarea><p>typed</textarea>shown", ["shown"]),
        ("İ<SCRIPT>x</SCRIPT>end", ["İend"]),
        ("", []),
        (None, []),
        ("<", ["<"]),
        ("</", ["</"]),
    ],
)
def test_tokens(markup, want):
    assert texts(markup) == want


def test_title_links_and_base():
    found = html.page('<title>A &amp;\n B</title><title>no</title><base href="/x/"><base href="/y/"><a href="a?b=1&amp;c=2">one <b>two</b><a HREF=c class=z>three</a><a name=n>none</a><a href=\'\'></a>')
    assert found["title"] == "A & B" and found["base"] == "/x/"
    assert found["links"] == [{"href": "a?b=1&c=2", "text": "one two"}, {"href": "c", "text": "three"}, {"href": "", "text": ""}]
    assert found["blocks"] == [{"tag": "", "text": "one twothreenone", "words": 2, "link_words": 3}]


def test_long_pages_take_linear_time():
    assert len(texts("<p>x<b>" * 50_000)) == 50_000
    assert texts("<" * 20_000)[0].startswith("<<")
    assert texts("<a " + "x='1' " * 50_000 + ">t</a>") == ["t"]


def test_main_text(spark):
    prose, short = "word " * 20, "six short words stand in here"
    menu = "".join(f'<li><a href="/{i}">item {i} of a menu</a></li>' for i in range(5))
    markup = f"<body><ul>{menu}</ul><p>{short} alone</p><h2>Not kept</h2><ul>{menu}</ul><h1>Kept</h1><p>{prose}</p><p>{short}</p><p>by</p><p>{prose}<a href=x>{prose}</a></p></body>"
    rows = spark.createDataFrame([(1, markup), (2, None), (3, ""), (3, "<p>" + prose)], "page_id bigint, html string")
    got = sorted((tuple(x) for x in pages.main_text(rows).collect()), key=str)
    kept = f"Kept\n{prose.strip()}\n{short}"
    assert got == sorted([(1, None, 17, 3, kept), (2, None, 0, 0, ""), (3, None, 0, 0, ""), (3, None, 1, 1, prose.strip())], key=str)
    assert pages.main_text(rows.limit(0)).count() == 0


ONE_FORM = {
    "HTTP://User:pw@Example.COM:80/a/./b/../c": "http://example.com/a/c",
    "https://example.com:443": "https://example.com/",
    "https://example.com.:8443/?": "https://example.com:8443/",
    "http://e.org/a/..": "http://e.org/",
    "http://e.org/a/b/..": "http://e.org/a/",
    "http://e.org/../../x/.": "http://e.org/x/",
    "http://e.org//a//b/": "http://e.org//a//b/",
    "http://e.org/%7euser/%c3%a9%2F%41": "http://e.org/~user/%C3%A9%2FA",
    "http://e.org/für mich/100%": "http://e.org/f%C3%BCr%20mich/100%25",
    "http://e.org/a,b;c=d@e": "http://e.org/a,b;c=d@e",
    "http://e.org/?b=2&a=1&utm_source=x&UTM_Medium=y&&ref=z&refer=1#top": "http://e.org/?a=1&b=2&refer=1",
    "  http://e.org/x  ": "http://e.org/x",
    "http://[2001:DB8::1]:80/": "http://[2001:db8::1]/",
    "mailto:a@b.c": None,
    "ftp://e.org/": None,
    "http:///x": None,
    "/only/a/path": None,
    "": None,
    None: None,
}


def test_one_form(spark):
    rows = spark.createDataFrame([(x,) for x in ONE_FORM], "url string")
    form = rows.withColumn("n", urls.parts(F.trim("url"))).withColumn("n", urls.normal(F.col("n"))).withColumn("form", urls.address(F.col("n")))
    assert {r.url: r.form for r in form.collect()} == ONE_FORM
    again = form.filter("form IS NOT NULL").withColumn("m", urls.parts(F.col("form"))).withColumn("m", urls.normal(F.col("m"))).withColumn("twice", urls.address(F.col("m")))
    assert all(r.form == r.twice for r in again.collect())  # one form has itself


def test_links_seen_from_a_page(spark):
    """RFC 3986, 5.4: the examples with a host, against the standard library's resolution."""
    base = "http://a/b/c/d;p?q"
    hrefs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h"]
    markup = "".join(f'<a href="{h}">t</a>' for h in hrefs) + '<a href="javascript:void(0)">no</a>'
    rows = spark.createDataFrame([(1, base, markup), (2, base, '<base href="/q/"><a href="r">t</a>'), (3, None, '<a href="/r">t</a>'), (4, base, None)], "page_id bigint, url string, html string")
    got = {(r.page_id, r.n): r for r in pages.links(rows).collect()}
    for n, h in enumerate(hrefs):
        want = urlsplit(urljoin(base, h))
        path = want.path + (";" + want.params if getattr(want, "params", "") else "")
        assert got[1, n].url == f"{want.scheme}://{want.netloc}{path or '/'}" + (f"?{want.query}" if want.query else ""), h
        assert got[1, n].outside == (want.netloc != "a") and got[1, n].href == h
    assert got[1, len(hrefs)].url is None and got[1, len(hrefs)].outside is False
    assert got[2, 0].url == "http://a/q/r" and got[3, 0].url is None and len(got) == len(hrefs) + 3


def test_pages_of_one_address(spark):
    rows = spark.createDataFrame([(3, "http://e.org/?a=1&b=2"), (2, "HTTP://E.org:80/?b=2&a=1#x"), (5, "http://e.org/?a=2"), (7, None), (8, "nothing")], "page_id bigint, url string")
    assert sorted(tuple(x) for x in pages.same_address(rows).collect()) == [("http://e.org/?a=1&b=2", 2, 2), ("http://e.org/?a=2", 1, 5)]
