"""The pairs after frequent words are part of the model, wherever they are counted."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheetseam.llm import queries
from sheetseam.llm import trie_lm as T


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def documents():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(40)] + ["The", "É"]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice([3, 42])]) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    rows += [(200 + i, f"new{i} w0 w{i} w1 odd{i} w0 w1 w2") for i in range(12)]
    return rows + [(100, rows[0][1]), (100, rows[0][1]), (101, None), (102, ""), (103, "never w0 seen w1 words w0"), (None, rows[3][1] + " w0 w0")]


def reference(rows, learn):
    """log10 of each text: three words, then two, then one, after every word."""
    train = [tokens(t) for (_, t), y in zip(rows, learn, strict=True) if y]
    c1 = Counter(w for t in train for w in t)
    n, kinds = sum(c1.values()), len(c1)
    c2, c3, s2, s3 = Counter(), Counter(), Counter(), Counter()
    for t in train:
        line = ["<s>", "<s>", *t]
        for u, v, w in zip(line, line[1:], line[2:], strict=False):
            c2[v, w] += 1
            s2[v] += 1
            c3[u, v, w] += 1
            s3[u, v] += 1

    def mixed(c, total, low):
        k = 1 / (1 + T.KAPPA * total**-0.1) if total else 0
        return k * c / max(total, 1) + (1 - k) * low

    def p(u, v, w):
        low = (c1[w] + 0.5) / (n + 0.5 * (kinds + 1))
        return mixed(c3[u, v, w], s3[u, v], mixed(c2[v, w], s2[v], low))

    lines = [["<s>", "<s>", *tokens(t)] for _, t in rows]
    return [sum(math.log10(p(*x)) for x in zip(line, line[1:], line[2:], strict=False)) for line in lines]


@pytest.mark.parametrize(("top", "share"), [(T.TOP, 0.05), (T.TOP, 1e-3), (3, 0.05), (12, 0.05), (12, 1e-3), (T.TOP, 1.0), (5, 1.0)])
def test_frequent_words_change_nothing(llm, monkeypatch, top, share):
    rows = documents()
    learn = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    monkeypatch.setattr(T, "TOP", top)
    monkeypatch.setattr(T, "HOT_SHARE", share)
    monkeypatch.setattr(T, "PAIRS", 300)
    df = llm.createDataFrame(rows, "doc_id long, text string")
    mask = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = T.score_texts(df, "doc_id", "text", mask, all_pairs=True).collect()
    expected = sorted((str(i), len(tokens(t)), s) for (i, t), s in zip(rows, reference(rows, learn), strict=True))
    assert len(got) == len(rows)
    for r, (i, n, score) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.score)), expected, strict=True):
        assert (str(r.doc_id), r.n_tokens) == (i, n)
        assert r.score == pytest.approx(score, abs=n / T.STEP)


def test_the_query_keeps_all_pairs(llm, tmp_path):
    rows = documents()
    llm.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    learn = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    expected = {i: s for (i, _), s in zip(rows, reference(rows, learn), strict=True)}
    for r in queries.op6_lm_scoring(llm, str(tmp_path)).collect():
        assert r.score == pytest.approx(expected[r.doc_id], abs=r.n_tokens / T.STEP)
