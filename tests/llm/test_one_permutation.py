"""Fingerprints estimate Jaccard similarity; the edited texts are as the contract says."""

import hashlib
import random

from pyspark.sql import functions as F

from sheetseam.llm import one_permutation as P


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_estimates(llm):
    rnd = random.Random(3)
    pairs = []
    for n in (6, 20, 60, 200, 900):
        for keep in (0.0, 0.3, 0.7, 1.0):
            a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            b = a[: int(n * keep)] + [f"v{rnd.randrange(10**6)}" for _ in range(n - int(n * keep))]
            pairs.append((" ".join(a), " ".join(b)))
    df = llm.createDataFrame(pairs, "a string, b string")
    df = df.select("a", "b", P.fingerprint(F.col("a")).alias("x"), P.fingerprint(F.col("b")).alias("y")).select("a", "b", P.likeness(F.col("x"), F.col("y")).alias("near"))
    errors, few = [], []
    for r in df.collect():
        s, t = shingles(r.a), shingles(r.b)
        (errors if len(s | t) > 20 else few).append(abs(r.near - len(s & t) / len(s | t)))
        if s == t:
            assert r.near == 1.0
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.05
    assert max(few) < 0.2


def test_report(llm):
    rows = [(5, "Über " * 30), (1, None), (3, "one two three"), (3, "one two three"), (9, "a b c d e f g h"), (7, ""), (2, "x " * 5000), (None, "the null id comes first " * 3)]
    df = llm.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, print string")
    got = P.edit_report(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), 1.0 if shingles(t) == shingles(nxt) else None))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(e[:3] for e in expected)
    by = {r.edited_sha256: r for r in got}
    for _, _, sha, near in expected:
        assert near is None or by[sha].near_next == near
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) in (0, P.BINS * P.LANE_BITS // 4)


def test_next_over_many_ranges(llm):
    df = llm.range(1000).select((F.col("id") * 7919 % 1000).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") * 7919 % 1000).cast("string")).alias("text"))
    rows = P.with_next(df, "doc_id", "text", ["text"]).collect()
    assert sorted((r.doc_id, r.next_text) for r in rows) == [(i, f"t{(i + 1) % 1000}") for i in range(1000)]


def test_single_and_empty(llm):
    df = llm.createDataFrame([(4, "a b")], "doc_id long, text string")
    r = P.edit_report(df, "doc_id", "text").first()
    assert r.near_next == 1.0 and r.n_chars == 3
    assert P.edit_report(df.where("doc_id > 4"), "doc_id", "text").collect() == []
