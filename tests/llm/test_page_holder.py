"""What stands beside the element with most of the text belongs to the article as well."""

from sheetseam.llm.tag_path import main_text

LONG = "A long paragraph, with some text in it; it goes on and on, and then it ends here."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">All the news</a></li></ul>'


def test_heading_beside_the_body():
    want = f"Title\n{LONG}\n{LONG}"
    page = f"<h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(f"<article>{page}</article>") == want
    assert main_text(f"<body><div>{MENU}</div><div class=x>{page}</div></body>") == want
    assert main_text(f"<body><h1>Title</h1>{MENU}<div><p>{LONG}</p><p>{LONG}</p></div></body>") == want
    assert main_text(f"<main><h1>Title</h1><article><p>{LONG}</p><p>{LONG}</p></article></main>") == want


def test_one_dominant_section():
    for tag, item in (("ul", "li"), ("blockquote", "p"), ("section", "p")):
        big = "".join(f"<{item}>{LONG}</{item}>" for _ in range(20))
        got = main_text(f"<article><h1>T</h1><p>A short introduction.</p><{tag}>{big}</{tag}><section><h2>End</h2><p>Short.</p></section></article>")
        assert got == "\n".join(["T", "A short introduction.", *[LONG] * 20, "End", "Short."])
