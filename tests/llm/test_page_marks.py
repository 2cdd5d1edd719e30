"""Class words on the elements around an article do not empty it."""

import pytest

from sheetseam.llm.tag_path import main_text

BODY = "<h1>Head</h1><p>First paragraph, with some text in it; it goes on.</p><p>Second, which is as long as the first one was.</p>"
TEXT = "Head\nFirst paragraph, with some text in it; it goes on.\nSecond, which is as long as the first one was."


@pytest.mark.parametrize(
    "page",
    [
        f'<html class="cookie-consent"><body>{BODY}', f'<body class="home no-sidebar">{BODY}', f'<body class="nav-open">{BODY}',
        f'<div class="content with-sidebar">{BODY}</div>', f'<article class="post has-comments">{BODY}</article>', f'<main id="skip">{BODY}</main>',
        f'<article class="post comments-open">{BODY}</article>', f'<div class="layout sidebar-right">{BODY}<div class="sidebar">Side, bar.</div></div>',
        f'<div class="page overlay">{BODY}<div class="cookie-notice">We use cookies, yes.</div></div>', f'<div class="comments-open">{BODY}</div>',
    ],
)
def test_article_stays(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("mark", ["cookie-notice", "comments", "ad"])
def test_long_marked_texts_stay_out(mark):
    other = "<p>A text of its own, much longer than the article; it says a lot, and then more.</p>" * 8
    assert main_text(f'<body><div>{BODY}</div><div class="{mark}">{other}</div>') == TEXT
