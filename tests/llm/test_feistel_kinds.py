"""Mail addresses in texts without a digit, and phone numbers in groups of one digit or many groups."""

import re

from pyspark.sql import functions as F

from sheetseam.llm import feistel as P


def apply(llm, values, **options):
    df = llm.createDataFrame(list(enumerate(values)), "k int, text string")
    rows = df.select("k", P.pseudonymised(F.col("text"), "key", **options).alias("o")).collect()
    return [(r.o.text, r.o.kinds) for r in sorted(rows, key=lambda r: r.k)]


def test_mail_without_a_digit(llm):
    df = llm.createDataFrame([(1, "Write to jane.doe@example.com, please.")], "doc_id long, text string")
    r = P.pseudonymise(df, "text", "key").first()
    assert r.n_email == 1 and "jane" not in r.text and re.fullmatch(r"Write to p[0-9a-f]{20}@example\.com, please\.", r.text)


PHONES = ["+33 6 12 34 56 78", "+33 (0)6 12 34 56 78", "+33.6.12.34.56.78", "+33612345678", "+1 (017) 555-7713", "+4 1 2 3 4 5 6 7 8", "+44 (0)20 7183 8750", "+41 79.123.45.67"]


TAILS = {
    "": [], ".": [], ") 5 times": [], " 192.168.17.20": ["ip"], " 21.03.1987": ["date"], " 1987-03-21": ["date"], " 3abc@example.com": ["email"],
    " 4000 0566 5566 5556": ["card"], " 4000056655665556": ["card"],
}


def test_phones(llm):
    """Found whole whatever follows; the value after it is found too."""
    cases = [(p, t, more) for t, more in TAILS.items() for p in PHONES]
    values = [f"call {p}{t}" for p, t, _ in cases]
    out = apply(llm, values)
    for value, (phone, tail, more), (text, kinds) in zip(values, cases, out, strict=True):
        assert kinds == ["phone", *more], value
        shown = text[5 : 5 + len(phone)]
        assert shown != phone and re.sub(r"\d", "0", shown) == re.sub(r"\d", "0", phone)
        if not more:
            assert text[5 + len(phone) :] == tail
    back = [t for t, _ in apply(llm, [t for t, _ in out], back=True)]
    assert [b for b, v in zip(back, values, strict=True) if "@" not in v] == [v for v in values if "@" not in v]


def test_no_phones(llm):
    values = ["+1 234 567", "+1234567", "+" + "1" * 16, "+" + "1" * 4000, "a + 12 34", "+" + "1 " * 7, "+ 33 6 12 34 56 78"]
    assert apply(llm, values) == [(v, []) for v in values]
