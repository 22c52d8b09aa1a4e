from __future__ import annotations

import html
import re

import numpy as np
import pytest

from periodica.llm import html_text as H
from tests.llm.frames import MEDIUM, needs_tables

STORY = [
    "A title of the story",
    "First paragraph of the story, with commas and words that go on for a while, as prose does.",
    "Second one is short.",
    "Third, again prose with <tags> & things to say about it, and some more after that.",
]
MARKED = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>{}</h1><p>{}</p><p>{}</p><p>{}</p></article><footer>about us</footer></body></html>"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(8)
    words = [*"alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split(), "the", "of", "and", "to"]

    def prose(low, high):
        return " ".join(rng.choice(words, rng.integers(low, high))).capitalize() + "."

    pages = []
    for _ in range(120):
        paragraphs = "</p><p>".join(", ".join(prose(2, 30) for _ in range(rng.integers(1, 5))) for _ in range(rng.integers(1, 9)))
        pages.append(MARKED.format(prose(2, 8), paragraphs, prose(1, 20), prose(3, 30)))
    return H.fit_pages(pages)


def around(body):
    return (
        "<body><header><p>Site of things</p></header><ul class='menu'><li><a href=x>Home</a><li><a href=y>About</a></ul>"
        "<div class='cookie-notice'><p>We use cookies, please accept.</p><button>OK</button></div>"
        f"<div class='post-content'>{body}</div>"
        "<div class='sidebar'><h3>Related</h3><p>Another article, long enough to look like prose to anyone.</p></div>"
        "<section id='comments'><h3>Comments</h3><div class='comment'><p>I liked it, it was good, thank you.</p></div></section>"
        "<form><label>Name</label><input></form><footer>&copy; x</footer><script>var p='</p>';</script></body>"
    )


def test_page_of_another_template(model):
    body = "".join(f"<p>{html.escape(s)}</p>" for s in STORY)
    assert H.extract(around(body), model).split("\n") == STORY


def test_markup_inside_blocks(model):
    body = f"<h1>{STORY[0]}</h1><p><b>{STORY[1]}<br><p>a&nbsp;b \n\t c&#233;<br/>d <i>e</i>f</p><!-- no --><blockquote>{STORY[1]}</blockquote>"
    assert H.extract(around(body), model).split("\n") == [STORY[0], STORY[1], "a b cé d ef", STORY[1]]


def test_no_kept_element_stands_in_a_dropped_one(model):
    order = H.parse(around("".join(f"<div><p>{html.escape(s)}</p></div>" for s in STORY)))
    H.decode(order, np.random.default_rng(1).normal(0, 3, len(order)))
    for node in order:
        if node.kept and node.parent and not node.parent.kept:
            up = node.parent
            while up:
                assert not up.kept
                up = up.parent


@pytest.mark.parametrize("page", ["", None, " ", "<", "</p>", "<p", "<div>" * 300, "<b><i></b></i>", "<!--", "<p>&bogus; &#xZZ;</p>", "\x00"])
def test_broken_pages(model, page):
    assert isinstance(H.extract(page, model), str)
    assert H.extract("plain text\n of a page", model) == "plain text of a page"


def test_boosted_trees_learn_an_interaction():
    x = np.random.default_rng(3).random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = H.BoostedTrees().fit(x[:1500], y[:1500], np.ones(1500))
    assert ((model.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.93


def test_odd_frames(spark, model):
    rows = [(1, None, None, "clash"), (None, "u", "", "clash"), (2, "u", MARKED.format(*map(html.escape, STORY)), None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.with_main_text(pages, model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0)] + [(2, len("\n".join(STORY)))] * 2
    assert H.fit(pages.where("page_id = 1")) is None
    assert H.with_main_text(pages.limit(0), H.fit(pages.limit(0))).count() == 0
    assert isinstance(H.fit(spark.createDataFrame([(1, "u", "<p>some words only</p>")], "page_id bigint, url string, html string")), H.BoostedTrees)


@needs_tables
def test_query(spark):
    """The pages of the tables mark their article: what stands in it, read by plain patterns, is the main text."""
    from periodica.llm.queries import op4_boosted_html_text

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    rows = op4_boosted_html_text(spark, MEDIUM).collect()
    assert len(rows) == len(pages)
    same = 0
    for r in rows:
        article = re.split("</article>|<footer>", pages[r.page_id].split("<article>")[1])[0]
        blocks = re.split("</?(?:h1|p)>", re.sub("</?b>", "", article).replace("<br>", " "))
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        same += r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert same >= 0.99 * len(rows)
