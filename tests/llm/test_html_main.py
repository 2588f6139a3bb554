from __future__ import annotations

import re
import time
from html import unescape

import pytest

from glucoframe.llm import html_main

PAGES = "page_id long, url string, html string"


def text_of(html: str) -> str:
    page = html_main.Page(html)
    return "\n".join(text for text, _ in html_main.main_blocks(page.runs, page.parents, page.kinds))


def test_markup_that_names_itself():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><article>";</script></head>
    <body><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy</div><aside><p>Side</p></aside><div id="cookie-notice">We use cookies</div><form><p>Mail <input type=text></p><button>Go</button></form>
    <article><header><h1>Head &amp; line</h1></header><p>First  <b>bold</b>
    text&nbsp;here.<br>More</p><ul><li>One<li>Two &lt;x&gt;</ul><div class="share-buttons">Share</div><table><tr><td>a<td>b<tr><td>c</table>
    <blockquote>Said <p>inner</blockquote><pre>a   b</pre></article><section class="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""
    assert text_of(html).split("\n") == ["Head & line", "First bold text here. More", "One", "Two <x>", "a", "b", "c", "Said", "inner", "a b"]


def test_pages_without_an_article():
    assert text_of("<body><nav>m</nav><main><p>a</p><p>b</main><p>c</body>") == "a\nb"
    assert text_of("<body><div role='main'><p>a</p></div><div>c</div>") == "a"
    assert text_of("<header><h1>site</h1></header><main><header class='entry-header'><h1>t</h1></header><p>a</main>") == "t\na"
    assert text_of("<p>a<p>b<div>c</div>d") == "a\nb\nc\nd"
    assert text_of("just text &amp; more") == "just text & more"


def test_broken_markup():
    assert text_of("<article><p>a<b>b<p>c</article><p>d") == "ab\nc"
    assert text_of("<article><p>a < b and 3<4</p><p>end <a hre") == "a < b and 3<4\nend"
    assert text_of("</div></p>a</span>b</article>") == "ab"
    assert text_of("<article><p>one <nav><ul><li>x</article><p>two") == "one"
    assert text_of("<script>never closed <p>a</p>") == ""
    assert text_of("<article><p title='a>b'>x</p><p>y &am") == "x\ny &am"
    assert text_of("") == "" and text_of("<p>a<!-- never <p>ends") == "a"
    assert text_of("<p>1 <span class=ad>buy</span> 2 <b class=ad>x</b>3") == "1 2 3" and text_of("<p>a<span class='my-ad-x'>long enough to stay in</span>b") == "along enough to stay inb"
    assert text_of("<head><title>x</title><body><p>no end of the head") == "no end of the head"
    assert text_of("<p a='b>c'>x<p a=it's>y&#99999999999;") == "x\ny�"
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text_of('<article><a class="comment-count">3</a> <p class="lead">in</p><span class="ad">x</span>out</article>') == "in\nout"


def test_documents_against_expressions(spark, docs_folder):
    """The generated pages have an article of headings and paragraphs, so expressions can take their text out."""
    pages = spark.read.parquet(f"{docs_folder}/pages.parquet")
    found = {r.page_id: r for r in html_main.main_text(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        r = found[page.page_id]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == page.url


def test_recurring_subtrees_are_deleted(spark):
    """A box without a telling name goes where it recurs, a paragraph only at an article's edge; copies of one article stay."""
    box = "<div><p>Read our magazine</p><div>every week</div></div>"
    rows = [(k, f"https://a.example/{k}", f"<article><h1>Title {k}</h1><p>Shared passage.</p><p>Words of page {k}.</p><p>Shared too.</p><p>More of {k}</p><p>Last {k}</p>{box}</article>") for k in range(8)]
    rows += [(20 + k, f"https://b.example/{k}", f"<body><div><p>Body {k}</p></div><div><p>Contact us</p></div></body>") for k in range(8)]
    rows += [(40 + k, f"https://c.example/{k}", "<article><div><p>The same article</p></div><div><p>everywhere</p></div></article>") for k in range(30)]
    rows += [(80 + k, f"https://d.example/{k}", f"<article><p>{k}</p>{box}</article>") for k in range(3)]
    rows += [(100 + k, f"https://e.example/{k}", f"<article><h1>One title</h1><div><p>Same start</p></div><p>version {k}</p><p>Same end</p></article>") for k in range(30)]
    frame = spark.createDataFrame(rows, PAGES)
    found = {r.page_id: (r.text, r.n_removed) for r in html_main.main_text(frame, min_edge_pages=5).collect()}
    assert found[3] == ("Title 3\nWords of page 3.\nShared too.\nMore of 3\nLast 3", 2)
    assert found[22] == ("Body 2", 1)
    assert found[45] == ("The same article\neverywhere", 0)
    assert found[81] == ("1\nRead our magazine\nevery week", 0)
    assert found[107] == ("One title\nSame start\nversion 7\nSame end", 0)
    assert {r.page_id: (r.text, r.n_removed) for r in html_main.main_text(frame, min_edge_pages=5, broadcast_rows=0).collect()} == found
    assert html_main.main_text(frame).where("page_id = 3").first().text.startswith("Title 3\nShared passage.\nWords")


def test_templates_of_a_section(spark):
    """Boxes on 30 % of a host's pages go, wherever they are nested; a section's last line goes in that section only."""
    rows = []
    for k in range(100):
        step = ("de", "en", "fr", "it", "es", "pt", "nl", "da", "sv", "fi")[k % 10]
        box = f"<section><ul><li>Our shop in {step}</li><li>All offers</li></ul></section>" if step in ("de", "en", "fr") else ""
        line = "<p>Write to us.</p>" if step == "it" else f"<p>End of {k}</p>" if k % 20 else "<p>Write to us.</p>"
        rows.append((k, f"https://host.example/{step}/{k}", f"<body><div class=x1><div class=x2>{box}<article><h1>T{k}</h1><p>text {k}</p>{box}{line}</article></div>{box}</div></body>"))
    found = {r.page_id: (r.text, r.n_removed) for r in html_main.main_text(spark.createDataFrame(rows, PAGES), min_edge_pages=5).collect()}
    for k, (text, removed) in found.items():
        step = k % 10
        wanted = f"T{k}\ntext {k}" + ("" if step == 3 else "\nWrite to us." if k % 20 == 0 else f"\nEnd of {k}")
        if k % 20 == 0:  # half of this section's pages end with the line
            wanted = f"T{k}\ntext {k}"
        assert (text, removed) == (wanted, (3 if step < 3 else 0) + (wanted == f"T{k}\ntext {k}"))


def test_templates_equal_a_count_of_subtrees(spark):
    """On the given pages the deleted subtrees are those that a plain count over all pages of a host finds."""
    least = 3  # of the 250 pages here few share a host
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    held: dict[tuple, set] = {}
    for page in pages:
        host = re.match(r"[^:/?#]*://([^/?#]*)", page.url)[1].lower()
        read = html_main.parse(page.html)
        for value in read["boxes"]:
            held.setdefault((host, value), set()).add(read["identity"])
    templates = {key for key, titles in held.items() if len(titles) >= least}
    removed = {}
    for page in pages:
        host = re.match(r"[^:/?#]*://([^/?#]*)", page.url)[1].lower()
        nodes = html_main.parse(page.html)["nodes"]
        gone = [bool(n["kind"] & html_main.BOX) and (host, n["hash"]) in templates for n in nodes]
        above = [n["parent"] >= 0 and any(gone[p] for p in _chain(nodes, n["parent"])) for n in nodes]
        removed[page.page_id] = sum(g and not a for g, a in zip(gone, above))
    found = {r.page_id: r.n_removed for r in html_main.main_text(spark.createDataFrame(pages), min_pages=least).collect()}
    assert found == removed and sum(removed.values()) > 0


def _chain(nodes, at):
    while at >= 0:
        yield at
        at = nodes[at]["parent"]


@pytest.mark.parametrize("html", [
    "<a " * 350_000, "<a " * 350_000 + ">", "<a x=\"" * 170_000 + ">", "<a x='" * 170_000, "&" * 1_000_000, "&#" + "9" * 1_000_000 + ";", "<" * 1_000_000 + ">",
    "<!--" * 250_000 + ">", "<script>" + "</script " * 100_000, "<div class='has-nav x'>" * 1_000 + "deep", "<div>" * 90_000 + "d" + "</div>" * 90_000,
    "<div>" * 50_000 + "</p></x></span>" * 50_000, "<span class=ad>" * 60_000 + "x", "<ul><li>x" * 50_000, "<p class" + " " * 1_000_000 + ">x", "<p " + 'id="' * 200_000 + ">x",
], ids=range(16))
def test_a_megabyte_of_broken_markup(html):
    started = time.time()
    html_main.parse(html)
    assert time.time() - started < 5


def test_odd_rows(spark):
    long_page = "<article>" + "".join(f"<p>Paragraph {k} of a long page.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, None, None), (1, "u", ""), (None, "http://x/", "<p>a"), (2, "http://x/", "<p>a"), (2, "http://x/", "<p>a"), (3, "http://x/", long_page)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, PAGES).select("*", F.lit(1).alias("host"), F.lit(2).alias("p"), F.lit(3).alias("row"), F.lit(4).alias("text"))
    found = html_main.main_text(frame).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in found)[:5] == [(-1, 1), (1, 0), (1, 0), (2, 1), (2, 1)]
    assert max(r.n_chars for r in found) > 500_000 and all(r.text is not None for r in found)
    empty = spark.createDataFrame([], PAGES).select("*", F.lit(1).alias("host"), F.lit(2).alias("section"), F.lit(3).alias("p"))
    assert html_main.main_text(empty).count() == 0 and html_main.main_text(empty, broadcast_rows=0).count() == 0


def test_main_text_is_chosen_by_its_share():
    long = "Words of the text itself that go on for a while."
    assert text_of(f"<body><main><h1>T</h1><p>{long}</p><article><p>Teaser</p></article></main></body>") == f"T\n{long}\nTeaser"
    assert text_of(f"<body><div><p>{long}</p></div><article class='comment'><p>{long} No!</p></article></body>") == long
    assert text_of(f"<body><div><p>{long}</p></div><article><p>Teaser</p></article></body>") == f"{long}\nTeaser"
    assert text_of(f"<body><h1>Title</h1><article><p>{long}</p></article><p>beside</p></body>") == f"Title\n{long}"
    assert text_of(f"<body><h1>Site</h1><article><h1>Title</h1><p>{long}</p></article></body>") == f"Title\n{long}"


def test_a_mark_inside_a_longer_name_drops_small_parts_only():
    long = "Words of the text itself that go on for a while."
    for start, end in (('<div class="content no-sidebar">', "</div>"), ('<div class="post has-comments">', "</div>"), ('<section id="notice-of-results">', "</section>"), ('<article class="has-sidebar">', "</article>")):
        assert text_of(f"<body>{start}<p>{long}</p><div class='share-buttons'>Share</div>{end}</body>") == long
        assert text_of(f"<body><div id='no-nav'>{start}<p>{long}</p>{end}</div></body>") == long
    assert text_of(f"<body><div><p>{long}</p></div><div class='comments'><p>{long}</p><p>{long}</p></div></body>") == long
