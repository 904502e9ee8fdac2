"""Ordinary markup of pages, and pages that would cost time with the square of their length."""
import time

import pytest

from msgsieve.llm.html_blocks import main_text

LONG = "Ten words of plain text that stand in one block."
TEXT = " ".join([LONG] * 4)
CASES = {
    "comments as articles": (f"<main><article><h1>Head</h1><p>{TEXT}</p></article></main><section class='comments'><article><p>{TEXT}</p></article><article><p>Nice.</p></article></section>", f"Head\n\n{TEXT}"),
    "comments inside the article": (f"<article><p>{TEXT}</p><div id='comment-list'><article>{TEXT} {TEXT}</article></div></article>", TEXT),
    "teasers in aside": (f"<article><p>{TEXT}</p></article><aside><article><h2>Other</h2><p>{LONG}</p></article></aside>", TEXT),
    "no container": (f"<body><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul><h1>Head of page</h1><p>Short one.</p><p>{TEXT}</p><p>See <a>this page</a> ok.</p></body>", f"Head of page\n\nShort one.\n\n{TEXT}\n\nSee this page ok."),
    "short paragraphs": ("<body><p>One two.</p><p>Three four five.</p><p>Six.</p></body>", "One two.\n\nThree four five.\n\nSix."),
    "class words": (f"<article><p class='social-history'>{LONG}</p><p class='notice'>No.</p><div class='share-buttons'>Share</div></article>", LONG),
    "whole page form": (f"<form id='aspnet'><nav><a>Home</a></nav><article><h1>Head</h1><p>{TEXT}</p><form>Your mail <button>Go</button></form></article></form>", f"Head\n\n{TEXT}"),
    "wrapper with a side word": (f"<div class='has-sidebar'><div class='sidebar'>Side</div><article><p>{TEXT}</p></article></div>", TEXT),
    "advert longer than the article": (f"<div class='ad'>{TEXT}</div><article><p>{LONG}</p></article>", LONG),
    "form without article": (f"<form><p>{TEXT}</p></form>", TEXT),
    "long talk beside": (f"<div class='layout-alert'><main><p>{LONG}</p></main><div class='replies'>{TEXT * 20}</div></div>", LONG),
    "references": ("<article><p>a&#" + "0" * 6000 + "65;b&#" + "9" * 6000 + ";c&#x41;&amp;</p></article>", "aAb�cA&"),
    "quote that never closes": ("<article><p title='x>One</p><p title=\"y\">Two</p></article>", "One\n\nTwo"),
    "no tag ends": ("<article><p>One <b two <i", "One <b two <i"),
}


@pytest.mark.parametrize("name", CASES)
def test_markup(name):
    page, text = CASES[name]
    assert main_text(page) == text


SHAPES = {"tags that never end": "<a ", "quotes across tags": '<a b="', "quotes and ends": '<a b="> \'', "nested quotes": "<a \"<a '>' ", "open and stray": "<div></b>", "open, side and form": "<form><div class=ad>x",
          "names without end": "<a<", "comments": "<!-- <a ", "raw": "<script></script <", "declarations": "<!a '", "references": "&#", "attributes": "<p class='", "spaces": "<p class  "}


@pytest.mark.parametrize("name", SHAPES)
def test_time_is_linear(name):
    piece = SHAPES[name]
    for tail in ("", ">", "'>", '">end'):
        page = piece * (1_000_000 // len(piece)) + tail
        begin = time.process_time()
        main_text(page)
        assert time.process_time() - begin < 8
