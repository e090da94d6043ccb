"""Main-text extraction: parts that go, parts that stay, a plain reading to compare with, and hostile pages."""

import random
import time

import pytest

from tallyloom.llm import html_extract
from tallyloom.llm.html_extract import extract

STAYS = [
    ('<div class="layout has-sidebar"><article><p>text one</p></article><div class="sidebar">s</div></div>', "text one"),
    ('<div id="content" class="no-comments page">some text here</div>', "some text here"),
    ('<article><p>a<svg viewBox="0 0 1 1" /> b</p><p>c</p></article>', "a b\nc"),
    ("<p>x <math><mi>y</mi></math> <button>go</button></p>", "x y go"),
    ('<form id="whole"><div><p>one</p><p>two</p></div></form>', "one\ntwo"),
    ("<form><label>Name</label><input></form><div>text</div>", "text"),
    ('<div class="overflow hidden x">t</div>', "t"),
    ("<div hidden>t</div><p>u</p>", "u"),
    ("<div style='display : none'>t</div><p>u</p>", "u"),
    ("a < b and c > d", "a < b and c > d"),
    ('<p title="a > b">t</p>', "t"),
    ("<p>open <b title='x>never closed</p>", "open never closed"),
    ('<div class="comments"><p>all there is on the page</p></div>', "all there is on the page"),
]


@pytest.mark.parametrize(("html", "text"), STAYS)
def test_what_stays(html, text):
    assert extract(html) == text


def test_comments_go_though_they_are_longer_than_the_article():
    said = "".join(f'<article class="comment"><p>reader {i} said this and that</p></article>' for i in range(50))
    assert extract(f'<article><p>the text</p></article><section class="comments-area">{said}</section>') == "the text"


@pytest.mark.parametrize("name", ["comments", "comments-area", "site-footer", "cookieNotice", "main_menu", "related-posts", "AD"])
def test_names_of_boilerplate(name):
    assert html_extract.names_boilerplate(name)


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "content", "header-free-article", "addition", "", "post", "loading"])
def test_names_of_content(name):
    assert not html_extract.names_boilerplate(name)


def test_generated_articles_come_back_whole():
    """Pages built from known blocks, with boilerplate around and inside, against the blocks themselves."""
    rng = random.Random(5)
    words = ["alpha", "béta", "gamma", "delta", "x < y", "R&D", "“quoted”"]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    for _ in range(60):
        blocks = [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(rng.randint(1, 8))]
        html = ["<html><head><title>t</title><script>if (a<b) { '</p>' }</script></head><body class='has-sidebar no-js'><nav><ul><li><a href=/>menu</a></ul></nav>"]
        html.append(rng.choice(["<article>", "<main>", "<div class=content>", "<article class='post has-comments'>"]))
        for i, b in enumerate(blocks):
            html.append(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>", "<p><b>{}</b></p>"]).format(escape(b)))
            if rng.random() < 0.3:
                html.append("<div class='ad-slot'>buy</div><!-- ad -->")
        tag = html[1].strip("<>").split()[0]
        html.append(f"</{tag}><aside>side</aside><footer>&copy; f</footer></body></html>")
        got = extract("\n".join(html))
        assert got == "\n".join(" ".join(b.split()) for b in blocks)


HOSTILE = {
    "no end of tags": "<a b", "quotes": '<a b="x> ', "quotes of two kinds": "<a x='> '\"", "wrong end tags": "<b>x</i>", "deep": "<div>x", "open paragraphs": "<p>x",
    "open comments": "<!-- ", "signs": "< ", "open scripts": "<script>", "self-closed": "<svg/>x", "lists": "<ul><li>x", "ampersands": "&",
}


@pytest.mark.parametrize("unit", HOSTILE.values(), ids=HOSTILE.keys())
def test_time_is_linear_in_the_page(unit):
    def took(size):
        page = "<i><div>" + unit * (size // len(unit))
        began = time.process_time()
        extract(page)
        return time.process_time() - began

    took(10_000)
    assert took(1_000_000) < 8  # a quadratic pass over a page of this size takes hours


def test_tables(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, "u", "<p>é</p>", 1, "x"), (1, "u", "<p>é</p>", 1, "x"), (None, None, None, 2, None), (2, "v", "", 3, None), (3, "w", "<p>" + "long " * 100_000, 4, None)]
    got = html_extract.main_text(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(tuple(r)[:1] + (r.n_chars,) for r in got.collect() if r.page_id) == [(1, 1), (1, 1), (2, 0), (3, 499_999)]
    assert html_extract.main_text(spark.createDataFrame([], schema)).count() == 0
