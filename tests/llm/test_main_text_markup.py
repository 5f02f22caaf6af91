"""Broken attributes, hidden styles, compound names and other languages."""

import time

import pytest

from cohortlab.llm import html_text as H

LONG = "This is the text of the article and it's as long as a paragraph has to be for the rules to see that it is one."
FINNISH = "Hallitus päätti eilen illalla, että uuden sairaalan rakentaminen aloitetaan ensi keväänä kaupungin pohjoisosassa."


@pytest.mark.parametrize("tag", ["p data-x=it's", 'p title=it"s', 'p title="it"s"', "p title='a>b'", 'p title="a>b"', "p =x", "p a==b", "p a = 'x y' / b"])
def test_tags_with_odd_quotes(tag):
    assert H.main_text(f"<article><{tag}>{LONG}</p><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"


def test_a_quote_that_opens_a_value_runs_to_the_next_as_in_browsers():
    assert H.main_text(f"<article><p a='>{LONG}</p><p>{LONG}</p></article>") == LONG


@pytest.mark.parametrize(
    "box",
    [
        '<div class="user-comments">', '<section id="postComments">', '<div class="advert-box">', "<div class=inline-ad>", '<div style="display:none">',
        '<div style="color: red; visibility : hidden">', '<div class="newsletter-box">',
    ],
)
@pytest.mark.parametrize("holder", ["main", "article", "div"])
def test_matter_beside_the_article(box, holder):
    assert H.main_text(f"<{holder}><p>{LONG}</p>{box}<p>{LONG} 2</p></div></section><p>{LONG} 3</p></{holder}>").startswith(LONG + "\n" + LONG + " 3")


@pytest.mark.parametrize("name", ["post-content", "ad-free", "no-comments", "comments-open", "article-body", "content-sidebar-wrap", "download-area", "header-inner"])
def test_names_that_only_resemble_boilerplate(name):
    assert H.main_text(f'<div class="{name}"><p>{LONG}</p></div>') == LONG


def test_a_style_that_shows():
    assert H.main_text(f'<div style="display:block; overflow:hidden"><p>{LONG}</p></div>') == LONG


def test_language_without_listed_words():
    assert H.main_text(f"<body><nav><a href=x>Etusivu</a></nav><h1>Otsikko</h1><p>{FINNISH}</p><p>{FINNISH}</p></body>") == f"Otsikko\n{FINNISH}\n{FINNISH}"


def test_many_open_and_stray_tags_take_linear_time():
    start = time.monotonic()
    H.main_text("<b>" * 30_000 + "</i>" * 30_000 + "<hr>" * 30_000 + "x" + "<p a='b" * 3_000)
    assert time.monotonic() - start < 5
