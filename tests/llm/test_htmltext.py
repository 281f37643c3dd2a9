import html
import re
import time

import pytest
from pyspark.sql import functions as F

from lotvalue.llm import htmltext
from lotvalue.llm.common import table


def article(page):
    """Of a page of the test table: its only article, read plainly."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|li|ul|div)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages_of_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in htmltext.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


LONG = "A sentence with some words, and a few more of them. " * 6


def test_page_without_an_article_element():
    page = f"""<html><body class="has-sidebar"><div class="top"><a href=/>Home</a> <a href=/x>News</a></div>
      <div class=content><h2>The  title</h2><p>{LONG}</p><p>Short one.</p><blockquote>{LONG}</blockquote></div>
      <div id="comments"><p>{LONG}</p></div><div class="cookieNotice">{LONG}</div><div hidden>{LONG}</div>
      <form><p>{LONG}</p></form><div class=bottom><a href=a>Imprint</a></div></body></html>"""
    assert htmltext.main_text(page) == f"The title\n{LONG.strip()}\nShort one.\n{LONG.strip()}"


def test_markup():
    read = htmltext.main_text
    assert read("<article><header><h1>T</h1></header><p>a<br>b&nbsp;&eacute;&#x41;</p><script>if (a<b) x()</script>"
                "<style>p{}</style><!-- <p>no</p> --><footer>f</footer></article>") == "T\na b éA"
    assert read("<main><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></main>") == "one\ntwo\nx\ny"
    assert read('<article><p title="a > b">in<b>li</b>ne</p><div class="ad">buy</div></article>') == "inline"
    assert read("<article><article class='comment'><p>hi</p></article><p>text</p></article>") == "text"
    assert read("plain text, no markup") == "plain text, no markup"
    assert read("<article>a < b and <p") == "a < b and"
    assert read("<article><p>&lt;b&gt; &amp;amp;</p></article>") == "<b> &amp;"


def test_edges(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<nav>x</nav>"), (3, "u", "<p>" + "word " * 100000),
            (3, "u", "<p>" + "word " * 100000), (4, "u", "<" * 5000), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    frame = spark.createDataFrame(rows, schema).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = [(r.page_id, r.url, r.n_chars) for r in htmltext.extract(frame).collect()]
    assert got[:3] == [(1, None, 0), (None, "u", 0), (2, "u", 0)]
    assert [g[2] for g in got[3:5]] == [499999, 499999] and got[6][2] == 4
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0


def test_names_are_evidence():
    read, want = htmltext.main_text, f"T\n{LONG.strip()}"
    body = f"<h1>T</h1><p>{LONG}</p>"
    assert read(f"<div class='layout has-sidebar'><article>{body}</article></div>") == want
    assert read(f"<article class='post social'>{body}</article><div class=ad>buy</div>") == want
    assert read(f"<div class='legal-text'>{body}</div>") == want and read(f"<div class='legal'>{body}</div>") == want
    assert read(f"<div id='search-result-page'><main>{body}</main></div>") == want
    assert read(f"<article>{body}<div class='share-social'>{LONG[:60]}</div></article>") == want


def test_links_within_the_article_stay():
    read, text = htmltext.main_text, LONG.strip()
    assert read(f"<article><h1><a href=/t>Title</a></h1><p>{LONG}</p><ul><li><a href=a>Ref one</a><li><a href=b>Ref two</a></ul>"
                f"<p><a href=c>See there</a>.</p></article>") == f"Title\n{text}\nRef one\nRef two\nSee there."
    assert read(f"<div><h2><a href=/t>Title</a></h2><p>{LONG}</p><p><a href=x>One link</a></p><p>{LONG}</p></div>") \
        == f"Title\n{text}\nOne link\n{text}"
    assert read(f"<div class=x><a name=top><p>{LONG}</p><p>{LONG}</p></div>") == f"{text}\n{text}"
    assert read(f"<p>{LONG}<a href=x>one <a name=y>two</p>") == f"{text} one two"
    assert htmltext.blocks("<p><a href=x>one <a name=y>two")[0][2] == 3
    links = "".join(f"<p><a href={i}>Menu item {i}</a></p>" for i in range(5))
    assert read(f"<body><div><p>{LONG}</p></div><div>{links}</div><div><p>{LONG}</p></div></body>") == f"{text}\n{text}"


def test_ratios_choose_also_among_articles():
    read, text = htmltext.main_text, LONG.strip()
    story = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = f"Title\n{text}\n{text}\nShort.\n{text}"
    cards = "".join(f"<article class=card><h3>Other {i}</h3><p>A few words.</p></article>" for i in range(4))
    assert read(f"<body><div class=story>{story}</div><div class=more>{cards}</div></body>") == want
    assert read(f"<body><div class=story>{story}</div>{cards}</body>") == want
    assert read(f"<body>{cards}<article>{story}</article>{cards}<div>Imprint and more.</div></body>") == want
    assert read(f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p></article></body>") == f"{text}\n{text}"


@pytest.mark.parametrize("page", [
    "<div>x " * 20_000, "<table>" + "<div>" * 20_000 + "<td>x" * 20_000, "<li>" + "<div>" * 20_000 + "<ul><li>x</ul>" * 5_000,
    "<span>" * 20_000 + "x</b>" * 20_000, "<div>" * 20_000 + "</p>x" * 20_000])
def test_deep_pages_take_time_in_proportion(page):
    start = time.process_time()
    assert htmltext.main_text(page)
    assert time.process_time() - start < 4


STORY = "".join(f"<p>Paragraph {k} of the story, with enough words, commas, and full stops to be read.</p>" for k in range(6))


def test_a_page_within_one_form_keeps_its_text():
    marked = f"<nav><a href=/>Home</a></nav><article><h1>Title</h1>{STORY}</article><footer>All rights</footer>"
    plain = f"<nav><a href=/>Home</a></nav><div class=story><h1>Title</h1>{STORY}</div><footer>All rights</footer>"
    for body in (marked, plain):
        alone = htmltext.main_text(f"<html><body>{body}</body></html>")
        assert alone.startswith("Title\nParagraph 0") and "Home" not in alone and "rights" not in alone
        for form in ('form id="aspnetForm" method="post"', 'div role="form"'):
            assert htmltext.main_text(f"<html><body><{form}>{body}</{form.split()[0]}></body></html>") == alone


def test_forms_beside_and_within_the_article_go():
    form = "<form><fieldset><label>Your name, please, and your address. Also this, that, and more.</label><input></fieldset></form>"
    for body in (f"<article><h1>Title</h1>{STORY}{form}</article>", f"<article><h1>Title</h1>{STORY}</article>{form * 9}",
                 f"<div class=story><h1>Title</h1>{STORY}</div>{form}"):
        assert "name" not in htmltext.main_text(f"<html><body>{body}</body></html>")
