"""Decontamination, extraction, url filter and language ID on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from sheetseam.llm import language_id, latent_leaks, tag_path, url_model
from sheetseam.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice(["th", "an", "on", "re", "ing", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_lcs():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert latent_leaks.common_length(a, b) == t[-1][-1]


def test_leaks(llm):
    rnd = random.Random(2)
    items = [(i, sentence(rnd, 25)) for i in range(30)]
    docs = [(i, sentence(rnd, rnd.choice([5, 40, 300]))) for i in range(60)]
    planted = set()
    for i in range(12):
        words = items[i][1].split()
        if i % 3 == 1:
            for k in range(2, len(words), 6):
                words[k] = "paraphrased"
        if i % 3 == 2:
            words = words[:10] + ["well", "then"] + words[10:]
        text = docs[i][1].split()
        at = rnd.randrange(len(text))
        docs[i] = (i, " ".join(text[:at] + words + text[at:]))
        planted.add((i, i))
    docs += [(100, None), (101, ""), (102, docs[0][1].upper() + "!"), (102, docs[0][1])]
    planted.add((102, 0))
    df = llm.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = llm.createDataFrame([*items, (None, "x y z"), (77, None), (78, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent_leaks.leaks(df, bench).collect()}
    assert got == planted
    blocks = {(r.doc_id, r.item_id) for r in latent_leaks.leaks(df, bench, block_items=7).collect()}
    assert blocks == planted
    assert latent_leaks.leaks(df, bench.where("item_id < 0")).collect() == []
    assert latent_leaks.leaks(df.where("doc_id < 0"), bench).collect() == []


def test_recall_of_the_index(llm):
    """Candidates by latent cosine against a comparison of every document with every item on the words."""
    docs, bench = (llm.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in latent_leaks.leaks(docs, bench).collect()}
    items = [(r.item_id, latent_leaks.tokens(r.text)) for r in bench.collect()]
    terms: dict = {}
    number = lambda ws: [terms.setdefault(w, len(terms)) for w in ws]
    truth = set()
    for r in docs.collect():
        words = latent_leaks.tokens(r.text)
        for i, item in items:
            for at in range(0, len(words), 40):
                part = words[at : at + 40 + 2 * len(item)]
                if latent_leaks.common_length(number(item), number(part)) >= 0.9 * len(item):
                    truth.add((r.doc_id, i))
                    break
    assert truth and len(got & truth) >= 0.9 * len(truth)


PAGE = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies, ok? Yes, we do.</div><nav><a href=x>Home</a> <a href=y>News</a></nav>
<div class="content"><h2>Title
 here</h2><p>Short one.<p><b>A long paragraph, with <a href=y>a link</a> &amp; more &lt;text&gt;; it goes&nbsp;on.<br><p>Third, after a
 break.</p><form><p>Sign up now, please do it.</p></form><ul><li>one</li><li>two</li></ul><div class="ad">Buy, buy, buy!</div><!-- <p>no</p> -->
<script>var t="</p><p>x";</script></div><aside>Side, bar text.</aside>
<section class="comments"><p>Great article, thanks a lot for it, really, thank you so much, it is so good.</p></section><footer>&copy; me</footer>"""


def test_main_text():
    assert tag_path.main_text(PAGE).split("\n") == [
        "Title here", "Short one.", "A long paragraph, with a link & more <text>; it goes on.", "Third, after a break.", "one", "two",
    ]
    assert tag_path.main_text(None) == tag_path.main_text("") == tag_path.main_text("<nav><a>x</a></nav>") == ""
    assert tag_path.main_text("plain  text") == "plain text"
    assert tag_path.main_text("<article><h1>Head</h1><p>Cut &am") == "Head\nCut &am"
    assert tag_path.main_text("<p>a<p>b") == "a\nb"


def test_extract(llm):
    df = llm.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (2, None, None, "old"), (3, "w", "<p>" + "word, " * 50000, "old")], "page_id long, url string, html string, text string")
    rows = tag_path.extract(df, "html").collect()
    assert sorted(r.page_id for r in rows) == [1, 2, 2, 3]
    text = {r.page_id: r.text for r in rows}
    assert text[1] == tag_path.main_text(PAGE) and text[2] == "" and len(text[3].split()) == 50000


def test_articles_of_the_table(llm):
    """On pages with an article element the result is the text of that element."""
    import re
    from html import unescape

    for r in tag_path.extract(llm.read.parquet(f"{SF}/pages.parquet").withColumn("raw", F.col("html")), "html").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.raw, re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body))
        assert r.text == "\n".join(b for b in blocks if b)


def test_rules(llm):
    urls = [
        ("https://A.Example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/1234?x", "example.org", "/en/1234", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/q#f", "x.com", "/de/q", "com/de/", "block"),
        ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"), ("http://example.org", "example.org", "", None, None), ("no scheme", "", "", None, None),
        (None, "", "", None, None), ("", "", "", None, None), ("x://h?a://b/c", "h", "", None, None), ("http://x.net/a\nb", "x.net", "/a\nb", None, None),
    ]
    df = llm.createDataFrame([(k, u[0], "old") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_model.filter_urls(df, "url", URL_RULES).collect()}
    for k, (url, host, path, rule, verdict) in enumerate(urls):
        r = got[k]
        assert (r.url, r.host, r.path, r.rule) == (url, host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_model.filter_urls(df.where("page_id > 99"), "url", URL_RULES).collect() == []
    one_sided = url_model.filter_urls(df.where("page_id = 2 OR page_id = 6"), "url", URL_RULES).collect()
    assert {r.verdict for r in one_sided} == {"allow"}


def test_character_model_separates(llm):
    rnd = random.Random(5)
    rows = [(f"http://site{rnd.randrange(50)}.org/{rnd.choice(['news', 'story', 'essay'])}/{k}", "allow") for k in range(150)]
    rows += [(f"http://casino{rnd.randrange(50)}.com/{rnd.choice(['win', 'bonus', 'spin'])}/{k}", "block") for k in range(150)]
    model = url_model.train(llm.createDataFrame(rows, "u string, v string"), "u", "v")
    assert model.accept_probability("http://site99.org/news/x") > 0.8 and model.accept_probability("http://casino77.com/spin/y") < 0.2
    # every context is a distribution over bytes
    m, context = model.accepted, "http://si"
    base = m.log_prob(context)
    import math

    assert sum(math.exp(m.log_prob(context + chr(c)) - base) for c in range(1, 128)) < 1.01


def test_language_id(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = language_id.train(train, "text", "lang", "doc_id")
    out = language_id.predict(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2), "text", model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    assert (model.weights == 0).mean() > 0.5
    odd = llm.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !? ²", "x"), (4, "the of and " * 50000, None), (4, "the of and", None)], "doc_id long, text string, score string")
    got = {(r.doc_id, len(r.text or "")): (r.lang_pred, r.score) for r in language_id.predict(odd, "text", model).collect()}
    assert all(got[k, n] == ("und", 0.0) for k, n in ((1, 0), (2, 0), (3, 8))) and got[4, 10][0] == got[4, 550000][0] == "en"
    assert language_id.train(train.where("lang = 'none'"), "text", "lang", "doc_id") is None
    assert {r.lang_pred for r in language_id.predict(odd, "text", None).collect()} == {"und"}


@pytest.mark.parametrize("name", ["op1_decontamination", "op7_url_filter", "op10_language_id"])
def test_queries_cover_their_table(llm, name):
    from sheetseam.llm.queries import QUERIES

    out = QUERIES[name](llm, SF)
    rows = {"op7_url_filter": "pages", "op10_language_id": "documents"}.get(name)
    assert rows is None or out.count() == llm.read.parquet(f"{SF}/{rows}.parquet").count()


def test_calibration_sees_every_held_out_url(llm):
    """All rows count: the few of one kind that come last by any order still move the fit."""
    import numpy as np

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=9000)
    y = rnd.random(9000) < 1 / (1 + np.exp(-(1.7 * x - 0.6)))
    a, b = url_model.logistic(llm.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "d double, y boolean").repartition(3))
    pos, neg = y.sum(), len(y) - y.sum()
    t, w = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2)), np.where(y, 0.5 / pos, 0.5 / neg)
    loss = lambda a, b: (w * (np.logaddexp(0, a * x + b) - t * (a * x + b))).sum()
    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
    assert url_model.logistic(llm.createDataFrame([(0.5, True)], "d double, y boolean")) is None


def test_calibration_is_not_cut(llm):
    rows = [(f"http://a{i}.com/x{i}", "allow") for i in range(30)] + [(f"http://b{i}.net/{i}y", "block") for i in range(30)]
    taken = []

    def seen(held):
        taken.append(held.count())
        return 1.0, 0.0

    was, url_model.logistic = url_model.logistic, seen
    try:
        df = llm.createDataFrame(rows, "u string, v string")
        url_model.train(df, "u", "v")
        assert taken == [df.where(F.pmod(F.xxhash64("u"), F.lit(10)) == 0).count()]
    finally:
        url_model.logistic = was
