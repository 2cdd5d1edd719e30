"""Counts equal a direct count; the model equals its formula and sums to one."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetseam.llm import trie_lm as T


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def documents():
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["The", "É"]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice([3, 42])]) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    return rows + [(100, rows[0][1]), (101, None), (102, ""), (103, "never seen words é"), (104, rows[3][1] + " " + rows[4][1])]


def reference(rows, learn, hot_words):
    """log10 of each text by the documented formula, every word known one by one."""
    train = [tokens(t) for (i, t), y in zip(rows, learn, strict=True) if y]
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
    p1 = lambda w: (c1[w] + 0.5) / (n + 0.5 * (kinds + 1))
    weight = lambda c: 1 / (1 + T.KAPPA * c**-0.1)
    hot = set(hot_words) | {"<s>"}
    known = set(c1) | {"<s>"}

    def p(u, v, w):
        if v not in known or v in hot and u not in known:
            return p1(w)
        low = p1(w)
        if v not in hot:
            k = weight(s2[v])
            low = k * c2[v, w] / s2[v] + (1 - k) * low
        if not s3[u, v]:
            return low
        k = weight(s3[u, v])
        return k * c3[u, v, w] / s3[u, v] + (1 - k) * low

    out = []
    for _, text in rows:
        line = ["<s>", "<s>", *tokens(text)]
        out.append(sum(math.log10(p(u, v, w)) for u, v, w in zip(line, line[1:], line[2:], strict=False)))
    return out, n, c1, (n + 0.5 * (kinds + 1))


def test_against_the_formula(llm):
    rows = documents()
    learn = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    df = llm.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    mask = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = {r.doc_id: r for r in T.score_texts(df, "doc_id", "text", mask).collect()}
    hot = {int(x) for x in T._frequent(df.where(mask))}
    from sheetseam.llm.packed import word_hashes

    known = {w for _, t in rows for w in tokens(t) if w}
    hot_words = [w for w in known if int(word_hashes([w.decode()])[0][0]) in hot]
    assert 0 < len(hot_words)
    scores, n, c1, norm = reference(rows, learn, hot_words)
    for (i, text), score in zip(rows, scores, strict=True):
        r, t = got[i], tokens(text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c1[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c1[w] + 0.5) / norm) for w in t), rel=1e-12)
        assert r.score == pytest.approx(score, abs=len(t) / T.STEP)  # two rounded values a token at most


def test_rare_words_share_their_class(llm, monkeypatch):
    """With room for few words, the others' probability is shared evenly; counts stay exact."""
    rows = documents()
    df = llm.createDataFrame(rows, "doc_id long, text string")
    mask = F.col("doc_id") % 3 != 1
    train = [tokens(t) for i, t in rows if i % 3 != 1]
    c1 = Counter(w for t in train for w in t)
    voc = T._vocabulary(T._vocabulary_table(df.where(mask), np.zeros(0, np.uint64), 8), np.zeros(0, np.uint64))
    assert voc.tokens == sum(c1.values()) and voc.kinds == len(c1) and voc.texts == len(train)
    monkeypatch.setattr(T, "TOP", 5)
    voc = T._vocabulary(T._vocabulary_table(df.where(mask), np.zeros(0, np.uint64), 8), np.zeros(0, np.uint64))
    monkeypatch.undo()
    assert len(voc.hashes) <= 5
    total = ((voc.counts + 0.5) / voc.norm).sum() + 10 ** voc.log_p1()[T.TAIL] + 10 ** voc.log_p1()[T.END]
    assert total == pytest.approx(1.0)


def test_every_context_sums_to_one():
    rnd = random.Random(1)
    n_ids, hot = 12, 2
    log_p1 = np.full(T.TOP + 3, -60.0)
    p = np.array([rnd.random() for _ in range(n_ids)] + [0.5, 0.3])
    p /= p.sum()
    log_p1[:n_ids], log_p1[T.TAIL], log_p1[T.END] = np.log10(p[:n_ids]), np.log10(p[-2]), np.log10(p[-1])
    ws = [*range(n_ids), T.TAIL, T.END]
    grams = Counter()
    for _ in range(400):
        v, u = rnd.choice([*range(n_ids), T.START]), rnd.choice([*range(n_ids), T.START])
        grams[v << 40 | u << 20 | rnd.choice(ws)] += rnd.randint(1, 3)
    keys = np.array(sorted(grams), dtype=np.uint64)
    count = np.array([grams[int(k)] for k in keys], dtype=float)
    totals = Counter()
    for k, c in grams.items():
        totals[k >> 20] += c
    trie = T.Trie.build(keys, count, log_p1, hot, totals, keys)
    for v in [*range(n_ids), T.START]:
        for u in [*range(n_ids), T.START, T.TAIL]:
            row = np.array([v << 40 | u << 20 | w for w in ws], dtype=np.uint64)
            assert (10 ** trie.log10(row, log_p1)).sum() == pytest.approx(1.0, abs=0.004)


def test_elias_fano():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 2, 100, 3000):
        for top in (1, 50, 1 << 20, 1 << 45):
            v = np.sort(rnd.integers(0, top, n).astype(np.uint64))
            s = T.EliasFano(*T.EliasFano.packed(v))
            assert (s.at(np.arange(n)) == v).all()
            if n:
                lo, hi = np.zeros(n, np.int64), np.full(n, n, np.int64)
                at = s.find(v, lo, hi)
                assert (v[at] == v).all()
                missing = np.setdiff1d(rnd.integers(0, top + 5, 50).astype(np.uint64), v)
                assert (s.find(missing, np.zeros(len(missing), np.int64), np.full(len(missing), n, np.int64)) == -1).all()


def test_nothing_to_learn(llm):
    df = llm.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    rows = T.score_texts(df, "doc_id", "text", F.lit(False)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [
        ("1", 3, 0, 0, 0.0, 0.0), ("1", 3, 0, 0, 0.0, 0.0), ("None", 1, 0, 0, 0.0, 0.0),
    ]
    assert T.score_texts(df.where("doc_id > 3"), "doc_id", "text", F.lit(True)).collect() == []


@pytest.mark.parametrize("top", [3, 5, 12])
def test_words_without_a_number_keep_their_n_grams(llm, monkeypatch, top):
    """With room for few words, all others are still known one by one, alone and in n-grams."""
    rows = documents()
    learn = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(T, "TOP", top)
    monkeypatch.setattr(T, "HOT_SHARE", 0.05)
    mask = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = {r.doc_id: r for r in T.score_texts(df, "doc_id", "text", mask).collect()}
    hot = {int(x) for x in T._frequent(df.where(mask))}
    from sheetseam.llm.packed import word_hashes

    known = {w for _, t in rows for w in tokens(t) if w}
    hot_words = [w for w in known if int(word_hashes([w.decode()])[0][0]) in hot]
    assert 0 < len(hot_words) <= top
    scores, n, c1, norm = reference(rows, learn, hot_words)
    for (i, text), score in zip(rows, scores, strict=True):
        r, t = got[i], tokens(text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c1[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c1[w] + 0.5) / norm) for w in t), rel=1e-12)
        assert r.score == pytest.approx(score, abs=len(t) / T.STEP)
