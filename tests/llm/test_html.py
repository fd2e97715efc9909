"""Main texts of pages whose markup misleads, leaves end tags out, or says nothing."""

import time

import pytest

from quillon.llm.html_text import main_text

A = "The first paragraph tells in plain words what happened that day, and goes on for more than eighty characters."
B = "The second paragraph is of the same kind; it has its own words, and ends like the first one does, with a full stop."
BOTH = f"{A}\n\n{B}"
TEXT = f"<p>{A}</p><p>{B}</p>"


@pytest.mark.parametrize("start, end", [
    ('<div class="content has-sidebar">', "</div>"), ('<div id="page" class="no-comments">', "</div>"), ('<article class="post social-policy">', "</article>"), ('<article id="search-engines-2020">', "</article>"),
    ('<article><section class="menu">', "</section></article>"), ('<form action="x"><div class="wrap">', "</div></form>"), ('<main class="related-work">', "</main>"), ('<div class="main-header-less widget">', "</div>"),
])
def test_misleading_names_keep_the_text(start, end):
    assert main_text(f"<body><nav><a href=x>Home</a></nav>{start}{TEXT}{end}<footer>Imprint</footer></body>") == BOTH


@pytest.mark.parametrize("name", ["sidebar", "site-header", "cookie-notice", "ad ad-slot-3", "x comments", "social_share", "left-sidebar wide", "comment-list"])
def test_known_names_go(name):
    for place in (f'<article>{TEXT}<div class="{name}"><p>Some other words.</p></div></article>', f'<div id="{name.split()[-1]}">Some other words.</div>{TEXT}'):
        if name == "left-sidebar wide" and place.startswith("<div"):
            continue
        assert main_text(place) == BOTH


def test_long_comments_go_all_the_same():
    comments = "".join(f"<p>Reader {k} says a lot about the article, more than the article does.</p>" for k in range(40))
    assert main_text(f'<article>{TEXT}<div id="comments">{comments}</div></article>') == BOTH
    assert main_text(f'{TEXT}<section class="comments">{comments}</section>') == BOTH
    assert "Reader 39" in main_text(f'<div class="comments">{comments}</div>')  # nothing else is left


def test_end_tags_may_be_left_out():
    assert main_text(f'<article><p class="notice">Cookies!<p>{A}<p>{B}</article>') == BOTH
    assert main_text(f'<article><ul><li class="ad">Buy!<li>{A}<li>{B}</ul></article>') == BOTH
    assert main_text(f"<article><dl><dt>Term<dd class=ad>Buy!<dd>{A}</dl><table><tr><td class=ad>Buy!<td>{B}<tr><td>End.</table></article>") == f"Term\n\n{BOTH}\n\nEnd."
    assert main_text(f"<article><p><b>{A}<p>{B}</article>") == BOTH
    assert main_text(f"<article><a href=x>Link<p>{A}</a><p>{B}</article>").endswith(B)
    assert main_text(f"<article><span class=ad>Buy<div>now</span></div><p>{A}</p>") == A


def test_menus_without_marks_go_and_short_paragraphs_stay():
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "About", "Contact", "Shop now"))
    links = "".join(f"<li><a href='{k}'>Another story {k}</a></li>" for k in range(6))
    assert main_text(f"<body>{menu}<h1>Title</h1>{TEXT}{menu}</body>") == f"Title\n\n{BOTH}"
    assert main_text(f"<body>{TEXT}<ul>{links}</ul><p>Correction: price is 5.</p></body>") == f"{BOTH}\n\nCorrection: price is 5."
    assert main_text(f"<body>{TEXT}<div>Yes.</div><div>No!</div><div>Why?</div><div>“Because.”</div>{TEXT}</body>").count("\n\n") == 7
    assert main_text("<div>One</div><div>Two</div>") == "One\n\nTwo"
    assert main_text(f"{TEXT}<div>© 2020 Somebody.</div>") == BOTH


def test_headers_inside_articles_keep_their_headings():
    assert main_text(f"<article><header><h1>Title</h1><p>By somebody</p></header>{TEXT}</article>") == f"Title\n\n{BOTH}"


@pytest.mark.parametrize("piece", ["<p>word ", "<li>word ", "<div>", "<b>", "<div class=ad>x", "<i class=ad>x", "</p>", "<td>x", "<a href=x>y", "<ul><li>"])
def test_time_is_linear(piece):
    seconds = []
    for n in (10_000, 100_000):
        began = time.process_time()
        main_text(piece * n)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 20 * seconds[0] + 1
