"""Layouts of pages that once lost article text."""

import pytest

from lineara.llm import html_text

BODY = "The quick brown fox jumps over the lazy dog, again and again, until the evening comes."


@pytest.mark.parametrize("around", ["<main>{}</main>", '<div role="main">{}</div>', '<div itemprop="articleBody">{}</div>', "{}"])
def test_article_inside_a_marked_part(around):
    html = "<body><nav>Home</nav>" + around.format(f"<article><h1>Title</h1><p>{BODY}</p><article><p>A reader says so.</p></article></article>") + "<footer>foot</footer></body>"
    assert html_text.main_text(html) == f"Title\n{BODY}"


def test_boilerplate_does_not_part_an_unmarked_article():
    long = [f"{BODY} Part {i}. {BODY}" for i in range(6)]
    share = '<ul class="share">' + "".join(f"<li>Share {i}</li>" for i in range(4)) + "</ul>"
    advert = '<div class="advert">' + "".join(f"<p>Buy {i}</p>" for i in range(4)) + "</div>"
    link = '<p><a href="x">A paragraph that is wholly a link</a></p>'
    body = f"<h1>Title</h1>{share}" + "".join(f"<p>{x}</p>" for x in long) + f"{link}{advert}<p>The end.</p>"
    html = f'<body><div class="top"><ul>{"".join(f"<li><a href=x>Go {i}</a></li>" for i in range(5))}</ul></div><div>{body}</div><footer>foot</footer></body>'
    assert html_text.main_text(html) == "\n".join(["Title", *long, "A paragraph that is wholly a link", "The end."])


def test_short_part_in_the_same_container_stays():
    long = [f"{BODY} Part {i}. {BODY}" for i in range(6)]
    links = "<ul>" + "".join(f"<li><a href=x>Other story {i}</a></li>" for i in range(5)) + "</ul>"
    html = f"<body><div>{''.join(f'<p>{x}</p>' for x in long)}{links}<p>The end.</p></div><div>{links}<p>Elsewhere.</p></div></body>"
    assert html_text.main_text(html) == "\n".join([*long, "The end."])
