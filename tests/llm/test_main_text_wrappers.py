"""Main text of pages: articles within wrappers, and boilerplate that stays out."""

import pytest

from cohortlab.llm import html_text as H

LONG = "This is a long paragraph of the article that has all of the words which are common in it, and it goes on for a while."
OTHER = "The reader of the page has written this as a comment on it, and it is also long enough to be taken for a part of the text."


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div style="overflow:hidden">', '<div class="overflow-hidden">', '<div class="hidden-xs">', '<div aria-hidden="false">', '<div data-x="hidden">',
        '<div class="hidden md:block">', '<div class="content-sidebar">', '<div class="has-sidebar no-comments">', '<div id="page-form">',
        '<div class="sidebar">', '<div class="comments">', '<div id="related">', '<div class="share notice">', '<form id="aspnetForm">', "<aside>",
        '<body class="hidden sidebar">', "<body hidden>", '<div class="popup"><form>',
    ],
)
@pytest.mark.parametrize("holder", ["article", "main", "main><h1>Title</h1><div class=form><article"])
def test_main_text_is_not_lost_through_its_wrappers(wrapper, holder):
    got = H.main_text(f"<html class=menu>{wrapper}<nav><a href=x>Home</a></nav><{holder}><p>{LONG}</p><p>{LONG}</p></article></main></form></div>")
    assert got.removeprefix("Title\n") == f"{LONG}\n{LONG}"


def test_main_text_without_an_article_in_wrappers():
    for wrapper in ('<div class="content-sidebar">', '<div style="overflow:hidden">', "<form method=post>", '<div class="overflow-hidden">'):
        assert H.main_text(f"<body>{wrapper}<p>{LONG}</p><p>{LONG}</p>") == f"{LONG}\n{LONG}"


def test_boilerplate_stays_out():
    for inside in (f"<div hidden><p>{OTHER}</p></div>", f"<div class='hidden x'><p>{OTHER}</p></div>", f"<form><p>{OTHER}</p></form>",
                   f"<div class='cookie-notice'>{OTHER}</div>", f"<div id=siteFooter>{OTHER}</div>", f"<div class=comment_list>{OTHER}</div>",
                   f"<div class=comments><article class=comment><p>{OTHER}</p></article></div>", f"<aside><article>{OTHER}</article></aside>"):
        for page in (f"<article><p>{LONG}</p></article>{inside}", f"<article><p>{LONG}</p>{inside}</article>", f"<div><p>{LONG}</p></div>{inside}",
                     f"<form><article><p>{LONG}</p></article>{inside}</form>", f"<div class=sidebar><article><p>{LONG}</p>{inside}</article></div>"):
            assert H.main_text(page) == LONG, page
