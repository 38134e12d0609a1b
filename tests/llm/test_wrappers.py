"""Articles inside elements whose names sound like boilerplate, and boilerplate that stays out."""

import pytest

from tessera.llm import htmltext

PROSE = [f"This is sentence number {i} of the article, and it says a few things about the subject." for i in range(12)]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
AROUND = '<nav><a href="/">Home</a> <a href="/a">About us</a></nav>{}<footer>Copyright 2020 Example Company. All rights reserved by the owners of this site.</footer>'


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="content has-sidebar">{}</div>', '<div id="wrap" class="with-header">{}</div>', '<div class="post category-legal">{}</div>', '<div class="related-studies-review">{}</div>', '<form id="aspnetForm">{}</form>',
        '<div class="page no-footer tag-comments">{}</div>', '<form><div class="toolbar-layout"><div id="banner_page">{}</div></div></form>', '<div role="form">{}</div>', '<aside class="widget">{}</aside>',
    ],
)
@pytest.mark.parametrize("around", ["{}", AROUND])
def test_wrappers_keep_the_article(wrapper, around):
    assert htmltext.main_text("<html><body>" + around.format(wrapper.format(BODY)) + "</body></html>") == "\n\n".join(PROSE)


def test_paragraphs_in_rows_of_their_own(wrapper='<div class="row has-sidebar"><p>{}</p></div>'):
    assert htmltext.main_text("".join(wrapper.format(p) for p in PROSE)) == "\n\n".join(PROSE)


@pytest.mark.parametrize("boiler", ['<div class="comments">{}</div>', '<div id="disqus_thread">{}</div>', '<div hidden>{}</div>', '<div style="display: none">{}</div>'])
def test_others_prose_stays_out(boiler):
    short = "The article is short, but it is the article of this page, and so it is what is kept."
    assert htmltext.main_text(f"<p>{short}</p>" + boiler.format(BODY)) == short


@pytest.mark.parametrize("boiler", ['<aside>{}</aside>', '<div class="related">{}</div>', "<footer>{}</footer>", '<div class="newsletter"><form>{}</form></div>'])
def test_a_named_main_part_is_not_outdone(boiler):
    short = "The article is short, but it is the article of this page, and so it is what is kept."
    assert htmltext.main_text(f"<main><p>{short}</p></main>" + boiler.format(BODY)) == short


def test_deep_marks_take_linear_time():
    page = '<div class="menu">' * 3000 + BODY
    assert htmltext.main_text(page) == "\n\n".join(PROSE)
