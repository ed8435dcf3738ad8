"""Main text of pages: the tables' pages against a plain cut, and pages of other make with their main text known."""

import html as references
import re

from weftline.llm.html_extraction import extract_main, joined, parsed

KIND = "page_id long, url string, html string, text string, host string, kind int"


def got(spark, pages):
    df = extract_main(spark.createDataFrame([(i, u, h, "old", "h", 1) for i, u, h in pages], KIND))
    assert df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    rows = df.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return sorted(((r["page_id"], r["url"], r["text"]) for r in rows), key=repr)


def cut(page):
    """The article of the tables' pages, whose blocks are headings and paragraphs."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (references.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(t for b in blocks if (t := " ".join(b.split())))


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted(((r["page_id"], r["url"], cut(r["html"])) for r in pages.collect()), key=repr)
    found = sorted(((r["page_id"], r["url"], r["text"]) for r in extract_main(pages).collect()), key=repr)
    assert found == want


RICH = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><h2>Site</h2></header>
<div id="cookie-notice">We use cookies</div><div role="navigation"><a href=/>Home</a></div><main><article class="post-17">
<header><h1>Title&nbsp;of <em>it</em></h1></header><p title="a > b">First   para &lt;one&gt;<br>line<p>Second<script>if (a < b) x("</p>")</script> para &#233;&am
<ul><li>one<li>two</ul><aside>side</aside><form><label>Mail</label><input></form><blockquote>quote</blockquote>
<table><tr><td>c1<td>c2</table><div class="adBanner">buy</div>tail<footer>by me</footer></article></main>
<section id="comments"><p>A reader says</p></section><div class="sidebar"><p>links</p></div><noscript>no</noscript>"""
RICH_TEXT = "Title of it\n\nFirst para <one> line\n\nSecond para é&am\n\none\n\ntwo\n\nquote\n\nc1\n\nc2\n\ntail"


def test_named_elements(spark):
    assert got(spark, [(1, "http://a.org/x", RICH)]) == [(1, "http://a.org/x", RICH_TEXT)]


def test_deduced_template(spark):
    """Nothing here is named: what the host repeats around the changing slots is the template, and the larger slot is main."""
    menu = "<div class=k1><a href=a>Start</a> <a href=b>More of us</a></div>"

    def page(i):
        body = "".join(f"<div>Words of part {j} on page {i} that no other page has</div>" for j in range(1 + i % 4))
        return f"<html><body>{menu}<div class=k2><div>Read this with care</div>{body}</div><div class=k3>Imprint and so on, every page the same</div></body></html>"

    def want(i):
        return "\n\n".join(f"Words of part {j} on page {i} that no other page has" for j in range(1 + i % 4))

    pages = [(i, f"https://User@Plain.org:80/{i}", page(i)) for i in range(12)]
    pages += [(50, "https://plain.org/odd", "<html><body><article>An odd one</article></body></html>")]
    assert got(spark, pages) == sorted([(i, u, want(i)) for i, u, _ in pages[:12]] + [(50, pages[12][1], "An odd one")], key=repr)


def test_odd_rows(spark):
    long = "<article>" + "<p>word &amp; word" * 40_000
    pages = [(1, None, None), (None, "u", ""), (2, "", "no markup at all"), (2, "", "no markup at all"), (3, "http://b/", "<"), (4, "http://b/", "<p <b x='>"), (5, "http://b/", "</div></p><p>a<div>b"), (6, "http://c/", long)]
    long_text = "\n\n".join(["word & word"] * 40_000)
    texts = [None, "", "no markup at all", "no markup at all", "<", "", "a\n\nb", long_text]
    assert got(spark, pages) == sorted([(i, u, t or "") for (i, u, _), t in zip(pages, texts, strict=True)], key=repr)
    assert got(spark, []) == []


def test_copies(spark):
    """Pages that are all alike still have their article."""
    assert got(spark, [(i, "http://same.org/", RICH) for i in range(9)]) == [(i, "http://same.org/", RICH_TEXT) for i in range(9)]


def test_parser():
    runs, opens, closes = parsed("<div><p>a<b>c</p>d</div><!-- <p> --><p>e<![CDATA[x]]></p>")
    assert joined(runs) == [("/div/p", "ac", 2), ("/div", "d", 1), ("/p", "e", 1)]
    assert (opens["/div/p"], closes["/div/p"], closes["/div"]) == (1, 1, 1)
    assert joined(parsed("<script>never ends <p>x")[0]) == []
    assert joined(parsed("a<span class=ad>b<i>c</i></span>d")[0]) == [("", "ad", 2)]
