"""The line-block distribution: what it decides, and what class words don't."""

import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lineara.llm import html_text

BODY = "The quick brown fox jumps over the lazy dog, again and again, until the evening comes."
TEXT = [f"{BODY} Part {i}." for i in range(4)]
ARTICLE = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in TEXT)
WANT = "\n".join(["Title", *TEXT])


@pytest.mark.parametrize("names", ["layout has-sidebar", "no-sidebar content", "post share-enabled", "entry comments-open", "page ad-free"])
@pytest.mark.parametrize("page", ['<div class="{}"><article>{}</article></div>', '<article class="{}">{}</article>', '<article><div class="{}">{}</div></article>', '<div class="{}">{}</div>'])
def test_no_single_word_kills_an_article(names, page):
    html = "<body><nav>Home</nav>" + page.format(names, ARTICLE) + '<div class="sidebar"><p>Aside words</p></div><footer>foot</footer></body>'
    assert html_text.main_text(html) == WANT


@pytest.mark.parametrize("part", ['<div class="sidebar">{}</div>', '<div id="post-comments">{}</div>', '<section class="commentList">{}</section>', '<div class="cookie-banner">{}</div>', '<div role="complementary">{}</div>', "<aside>{}</aside>"])
def test_boilerplate_inside_an_article_goes(part):
    html = f"<body><article>{ARTICLE}{part.format('<p>Some other words that are no part of it.</p>')}</article></body>"
    assert html_text.main_text(html) == WANT


def test_window_and_threshold_decide():
    """Two blocks far apart: a low threshold joins what a high one or a narrow window parts."""
    far = "".join(f"<p>short {i}</p>" for i in range(6))
    html = f"<body><div><p>{BODY * 3}</p></div><div>{far}</div><div><p>{BODY}</p></div></body>"
    outs = {(w, s): html_text.main_text(html, w, s) for w in (1, 3) for s in (0.01, 0.2, 0.9)}
    assert len(set(outs.values())) > 1
    assert BODY * 3 in outs[(3, 0.9)] and "short" not in outs[(3, 0.9)] and "short 3" in outs[(3, 0.01)]
    # A marked article with next to no text loses to the text that the distribution finds.
    assert html_text.main_text(f"<body><article><p>Ad</p></article><div>{ARTICLE}</div></body>") == WANT


@given(st.lists(st.integers(0, 60), max_size=30), st.integers(1, 4), st.sampled_from([0.05, 0.2, 0.5, 1.0]))
@settings(max_examples=200, deadline=None)
def test_distribution_against_a_plain_version(weights, window, share):
    sums = [sum(weights[max(0, i - window + 1) : i + 1]) for i in range(len(weights) + window - 1)]
    out, at = [], 0
    least = max(1, share * max(sums, default=0))
    while at < len(sums) and any(weights):
        if sums[at] < least:
            at += 1
            continue
        end = at
        while end < len(sums) and sums[end] >= least:
            end += 1
        if at < len(weights):
            out.append((at, max(at + 1, min(end - window + 1, len(weights)))))
        at = end
    assert html_text.distribution(np.array(weights, np.int64), window, share) == out


def test_deep_and_long_markup_takes_linear_time():
    began = time.time()
    assert html_text.main_text("<article>" + "<span>" * 80_000 + "<b><p>" * 8_000 + "x") == "x"
    assert html_text.main_text("<body>" + "<div>word " * 80_000).count("word") == 80_000
    long = "word " * 400_000
    assert html_text.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert time.time() - began < 20


def test_edges(spark):
    """Nulls, repeated rows, broken markup, clashing and extra columns, no rows."""
    made = [(1, "u", f"<article>{ARTICLE}</article>", "x", 1), (1, "u", f"<article>{ARTICLE}</article>", "x", 1), (None, None, "<p>a &lt; b <!-- c", "y", 2), (3, "v", "<article><p unclosed", None, None), (4, None, None, None, None)]
    frame = spark.createDataFrame(made, "page_id long, url string, html string, text string, n_chars int")
    out = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(frame).collect()), key=str)
    assert out == sorted([(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (0, None, "a < b", 5), (3, "v", "", 0), (4, None, "", 0)], key=str)
    assert html_text.extract(frame.limit(0)).count() == 0


P = "<p>" + "Some words of a real paragraph that goes on for a while. " * 4 + "</p>"
TEXT = ("Some words of a real paragraph that goes on for a while. " * 4).strip()


def test_form_around_the_page():
    whole = f"<body><form id='aspnetForm' action='x'><div class='menu'><a>Home</a></div><div>{P * 3}<input><select><option>a</select></div></form></body>"
    assert html_text.main_text(whole) == "\n".join([TEXT] * 3)
    small = f"<body><div>{P * 3}<form><label>Your name, please</label><button>Go</button></form></div></body>"
    assert html_text.main_text(small) == "\n".join([TEXT] * 3)
    assert html_text.main_text(f"<body><form class='newsletter'>{P}</form><article>{P * 2}</article></body>") == "\n".join([TEXT] * 2)


def test_articles_inside_an_article():
    stories = f"<article><h1>News</h1><article><h2>A</h2>{P}</article><article><h2>B</h2>{P}</article></article>"
    assert html_text.main_text(stories) == "\n".join(["News", "A", TEXT, "B", TEXT])
    comments = f"<article><h1>News</h1>{P * 3}<article><h2>Reader</h2>{P}</article><article>No</article></article>"
    assert html_text.main_text(comments) == "\n".join(["News", *[TEXT] * 3])
    named = f"<article><h1>News</h1><article class='comment'>{P}</article><p>Short text.</p></article>"
    assert html_text.main_text(named) == "News\nShort text."
    # A story's own comments go, though the story stays.
    nested = f"<article><h1>News</h1><article>{P * 2}<article>Reader says so</article></article><article>{P}</article></article>"
    assert html_text.main_text(nested) == "\n".join(["News", *[TEXT] * 3])


def test_links_that_belong_to_an_unmarked_article():
    linked = "A first paragraph that is wholly a link to another page, long enough"
    links = "<ul><li><a>One link</a></li><li><a>Two link</a></li><li><a>Three link</a></li></ul>"
    page = f"<body><div><p><a href=x>{linked}</a></p>{P * 2}{links}{P * 2}</div></body>"
    assert html_text.main_text(page) == "\n".join([linked, TEXT, TEXT, "One link", "Two link", "Three link", TEXT, TEXT])
    # Lists around the text, and short lines of links before it, are menus.
    menus = f"<body><h1>Site</h1>{links}<div><p><a>Home</a></p>{P * 2}</div>{links}<p><a>Imprint</a></p></body>"
    assert html_text.main_text(menus) == "\n".join([TEXT] * 2)
    deep = "<div>" * 3000 + P + "<ul><li><a>x</a>" * 3000 + P
    assert TEXT in html_text.main_text(deep)
