"""The cube's divergences and ranks equal plain Python's whole-number arithmetic."""

import random
import re
from collections import Counter, defaultdict

import pytest
import pyarrow as pa

from sheetseam.llm import divergence_cube

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[g].update(terms)
        docs[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)

        def rate(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        p = {s: rate(counts[lang, s]) for s in own}
        q = rate(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -f, k) for k, (f, o) in enumerate(far, 1)]
            more = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -f, k) for k, (f, t) in enumerate(more[:50], 1)]
    return sorted(out)


def rows_of(seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgä" for b in ["lpha", "Eta", "ß", "日"]]
    rows = [(None, "xx", "only nulls"), ("", None, None), ("x1y-z", "", "s"), (None, None, "t")]
    for _ in range(400):
        source = rnd.choice(["s0"] * 5 + [f"s{k}" for k in range(9)] + [None])
        sep = rnd.choice([" ", "7", "_", "\n", "[", "\x7f"])
        rows.append((sep.join(rnd.choices(words, weights=range(1, len(words) + 1), k=rnd.choice([0, 1, 5, 60]))), rnd.choice(["en", "en", "de", None]), source))
    return rows + [(("Long wörd " * 30_000), "en", "s1"), ("a" * 70_000, "en", "s1")] + rows[-3:]


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 3)])
def test_against_whole_numbers(llm, monkeypatch, blocks):
    monkeypatch.setattr(divergence_cube, "GROUPS", blocks[0])
    monkeypatch.setattr(divergence_cube, "TERMS", blocks[1])
    rows = rows_of(blocks[0])
    df = llm.createDataFrame([(*r, k, "c") for k, r in enumerate(rows)], "text string, lang string, source string, n long, term string")
    got = sorted(tuple(r) for r in divergence_cube.audit(df).collect())
    assert got == brute(rows, 30)
    assert {r[2] for r in got} == {"pair", "term"}


def test_merged_when_the_tables_are_not_small(llm, monkeypatch):
    monkeypatch.setattr("sheetseam.llm.common.SMALL_ROWS", 0)
    rows = rows_of(5)
    df = llm.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence_cube.audit(df).collect()) == brute(rows, 30)


def test_empty_table_and_no_kept_term(llm):
    shape = "text string, lang string, source string"
    assert divergence_cube.audit(llm.createDataFrame([], shape)).count() == 0
    got = divergence_cube.audit(llm.createDataFrame([("a b", "en", "x"), (None, "en", "y")], shape)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_long_texts_are_cut_behind_terms(monkeypatch):
    text = "Ab cdé " * 500 + "x" * 300 + " y"
    whole = divergence_cube.terms_of(text)
    monkeypatch.setattr(divergence_cube, "PIECE", 7)
    assert divergence_cube.terms_of(text) == whole == Counter({b"ab": 500, "cdé".encode(): 500, b"x" * 300: 1, b"y": 1})


@pytest.mark.parametrize("held", [200, 700, 6 << 20])
def test_counts_in_one_go_and_long_texts_apart(monkeypatch, held):
    """Batches are cut by bytes; a text that is longer than a cut is counted by itself, and as one document."""
    monkeypatch.setattr(divergence_cube, "HELD", held)
    monkeypatch.setattr(divergence_cube, "PIECE", 50)
    texts = ["Ab cdé, ab", None, "", "1 2", "é", "ab " * 400 + "z", "x", "\x00Q\x7fq[Q`", "ab é"]
    rows = [{"lang": "ab"[i % 2], "source": "s" + "xyz"[i % 3], "text": t} for i, t in enumerate(texts * 3)]
    got, want = Counter(), Counter()
    for b in divergence_cube._counted(iter([pa.RecordBatch.from_pylist(rows[i : i + 5]) for i in range(0, len(rows), 5)])):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"], "n"] += r["n"]
            got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    for r in rows:
        for key in ("n", "docs"):
            want[r["lang"], r["source"], "", key] += 0
        for t, n in divergence_cube.terms_of(r["text"]).items():
            want[r["lang"], r["source"], t.decode(), "n"] += n
            want[r["lang"], r["source"], t.decode(), "docs"] += 1
    assert got == want and set(got) == set(want)
