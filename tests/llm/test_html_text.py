"""Main text of pages: hand-made pages, broken markup, and the sample pages against a plain cut."""

import html
import re
from collections import Counter

import pytest

from cohortry.llm import queries, text_density
from cohortry.llm.text_density import article_text

SF = "/root/testdata/sf0.01"
LONG = "The old miller counted seven sacks of grain before the river rose over its banks again. "
ARTICLE = f"<h1>A title</h1><p>{LONG * 3}</p><p>Short &amp; sweet.</p><p>{LONG * 2}</p>"
TEXT = "\n\n".join(["A title", (LONG * 3).strip(), "Short & sweet.", (LONG * 2).strip()])
NOISE = {
    "menu": "<nav><ul><li><a href='/a'>One</a><li><a href='/b'>Two</a><li><a href='/c'>Three</a></ul></nav>",
    "link list": "<ul><li><a href='/a'>One</a><li><a href='/b'>Two</a><li><a href='/c'>Three</a></ul>",
    "header": f"<header><h1>Site</h1><p>{LONG}</p></header>",
    "sidebar": f"<aside><p>{LONG * 4}</p></aside>",
    "sidebar class": f"<div class='left-sidebar'><h3>More</h3><p>{LONG * 4}</p></div>",
    "cookies": f"<div id=cookieNotice><p>{LONG * 2}</p></div>",
    "advert": f"<div class=\"ad\">{LONG * 5}</div>",
    "form": f"<form action=x><label>Name {LONG}</label><input value='>'><button>Go</button></form>",
    "script": "<script>if (a < b) document.write('<p>no</p>')</script><style>p > a {}</style>",
    "comments": f"<section id='comments'><h2>Comments</h2><article class='comment'><p>{LONG * 6}</p></article></section>",
    "hidden": f"<div style='display: none'>{LONG}</div><p hidden>{LONG}</p>",
    "role": f"<div role=complementary><p>{LONG * 3}</p></div>",
    "comment markup": f"<!-- <p>{LONG}</p> -->",
    "footer": f"<footer><p>{LONG}</p></footer>",
}


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("shell", [
    "<body>{n}<article>{a}</article>{n}</body>", "<body>{n}<main><article>{a}{n}</article></main></body>",
    "<div id=page>{n}<div class='post-content'>{a}</div>{n}</div>",
    "<body class='has-sidebar ad'>{n}<main>{a}</main>", "<body><article>{n}{a}"])
def test_noise_goes_and_the_article_stays(noise, shell):
    if noise == "header" and "{n}{a}" in shell + "{n}{a}" * ("{a}{n}" in shell):
        pytest.skip("the headings of a header inside the article are its text")
    page = "<!DOCTYPE html><html><head><title>T</title></head>" + shell.format(n=NOISE[noise], a=ARTICLE)
    assert article_text(page) == TEXT


def test_all_noise_at_once():
    noise = "".join(NOISE.values())
    assert article_text(f"<html><body>{noise}<article>{ARTICLE}</article>{noise}</body></html>") == TEXT


def test_short_article_beside_long_noise():
    assert article_text(f"<body><div class=ad>{LONG * 9}</div><article><h1>Hi</h1><p>Me.</article>") == "Hi\n\nMe."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), (" \n", ""), ("<html><body></body></html>", ""), ("plain text\n only", "plain text only"),
    ("<nav><a href=x>A</a></nav><footer>f</footer>", ""), ("<script>x", ""), ("<p>a &lt;b&gt; &#233;&eacute;&nbsp; c", "a <b> éé c"),
    ("<article><p>one<br>two<p>three<b>four</b>five</article>", "one two\n\nthreefourfive"),
    ("<article>a <div>b</div> c</article>", "a\n\nb\n\nc"), ("<article><p>1 < 2 & 3 > 2</p></article>", "1 < 2 & 3 > 2"),
    ("<article><p><b>open<br><p>next</b> on</p></article>", "open\n\nnext on"),
    ("<ARTICLE><P TITLE='a>b'>x</P></ARTICLE>", "x"), ("<article><p>a</p></div></span><p>b", "a\n\nb"),
    ("<article><header><h1>T</h1><p>by x</p></header><p>body text", "T\n\nbody text"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article>", "a\n\nb\n\nc\n\nd\n\ne"),
    ("<article><dl><dt>a<dd>b<dt>c</dl><p>x<hr>y</article>", "a\n\nb\n\nc\n\nx\n\ny"),
    ("<article><pre>a\n  b</pre>한글 \U0001f600</article>", "a b\n\n한글 \U0001f600"),
])
def test_small_pages(page, text):
    assert article_text(page) == text


def test_sections_of_one_article_all_stay():
    sections = "".join(f"<section><h2>Part {i}</h2><p>{LONG * i}</p><p>{LONG}</p></section>" for i in range(1, 6))
    text = article_text(f"<body><div class=ad>{LONG}</div><div>{sections}</div></body>")
    assert [f"Part {i}" in text for i in range(1, 6)] == [True] * 5 and text.count("miller") == 15 + 5


def test_long_and_deep_pages_are_read_whole():
    many = "".join(f"<p>{i} {LONG}</p>" for i in range(20_000))
    assert article_text(f"<article>{many}</article>").count("\n\n") == 19_999
    deep = "<div>" * 30_000 + "<p>" + LONG + "</p>" + "</div>" * 30_000
    assert article_text(deep) == LONG.strip()
    assert article_text("<a href='" * 5_000 + "x") is not None


def plain_cut(page: str) -> str:
    """What lies between the article tags of a sample page, cut at its paragraphs and headings."""
    inside = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = (html.unescape(re.sub("<[^>]+>", " ", b)) for b in re.split("</?(?:p|h1)>", inside))
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_sample_pages_equal_a_plain_cut(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op11_html_text(spark, SF).collect()
    assert len(rows) == len(pages) > 0
    for row in rows:
        assert row["text"] == plain_cut(pages[row["page_id"]]["html"])
        assert row["n_chars"] == len(row["text"]) and row["url"] == pages[row["page_id"]]["url"]


def test_rows_columns_and_empty_tables(spark):
    schema = "page_id long, url string, html string, text string, out int, row string"
    made = [(1, "u", "<p>a", "old", 1, "r"), (1, "u", "<p>a", "old", 1, "r"), (None, None, None, None, None, None)]
    found = text_density.main_text(spark.createDataFrame(made, schema))
    assert found.columns == ["page_id", "url", "html", "text", "out", "row"]
    assert Counter(r["text"] for r in found.collect()) == {"a": 2, "": 1}
    assert text_density.main_text(spark.createDataFrame([], schema)).count() == 0
