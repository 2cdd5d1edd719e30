"""Removed bytes equal those of a table of all 200-byte windows."""

import random
from collections import Counter

from sheetseam.llm import suffix_merge as S


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans, i = [], 0
        while i < len(b):
            if gone[i]:
                j = i
                while j < len(b) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    passage = " ".join(word() for _ in range(120))
    out = [None, "", "x" * 199, "x" * 200, "ab" * 300, "=" * 1500, passage, passage]
    for _ in range(25):
        t = " ".join(word() for _ in range(rnd.randint(1, 150)))
        for _ in range(rnd.randint(0, 2)):
            i, n = rnd.randrange(len(passage)), rnd.randint(100, 500)
            at = rnd.randrange(len(t))
            t = t[:at] + passage[i : i + n] + t[at:]
        out.append(t)
    for t in rnd.sample(out[8:], 5):
        k = rnd.randrange(len(t))
        out.append(t[:k] + "#" + t[k:])
    return out


def check(llm, rows):
    df = llm.createDataFrame([(i, t, "k") for i, t in enumerate(rows)], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in S.without_repeats(df, "text").collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)


def test_against_all_windows(llm):
    check(llm, texts(1))


def test_long_texts_are_cut_in_chunks(llm, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK_BITS", 9)  # pieces of 512 bytes on the driver's side of the test
    rows = texts(2)
    raw = [t.encode() if t else b"" for t in rows]
    starts = set()
    for data, begins, numbers, offset in S.chunks(raw):
        c = S.Cells(data, begins)
        for first, last in zip(c.first.tolist(), c.last.tolist(), strict=True):
            k = max(i for i, b in enumerate(begins.tolist()) if b <= first)
            for p in range(first, last + 1):
                place = (int(numbers[k]), p - int(begins[k]) + offset)
                assert place not in starts
                starts.add(place)
    assert starts == {(i, p) for i, b in enumerate(raw) for p in range(len(b) - 199)}


def test_small_runs_and_batches(llm, monkeypatch):
    """Runs flushed after nearly every chunk, batches of three rows, and columns called like working ones."""
    from sheetseam.llm.common import batches_of

    monkeypatch.setattr(S, "RUN_BYTES", 2000)
    rows = texts(4)
    with batches_of(llm, 3):
        check(llm, rows)
    df = llm.createDataFrame([(t, 1, 2, 3) for t in rows], "text string, k1 int, k2 int, starts int")
    assert S.without_repeats(df, "text").columns == ["text", "k1", "k2", "starts", "n_bytes", "spans", "kept"]


def test_very_long_texts(llm):
    """One character five million times is repeated in itself; a long text without repeats stays whole."""
    rnd = random.Random(2)
    whole = "".join(chr(97 + rnd.randrange(26)) for _ in range(1_500_000))
    df = llm.createDataFrame([(1, "a" * 5_000_000), (2, whole), (3, "b" * 100 + whole[700_000:700_400])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, [tuple(x) for x in r.spans]) for r in S.without_repeats(df, "text").drop("kept", "text").collect()}
    assert got == {1: (5_000_000, [(0, 5_000_000)]), 2: (1_500_000, [(700_000, 700_400)]), 3: (500, [(100, 500)])}


def test_one_text_and_none(llm):
    check(llm, ["only one " * 100])
    check(llm, ["short"])
    df = llm.createDataFrame([], "doc_id long, text string")
    assert S.without_repeats(df, "text").collect() == []


def test_merge_of_runs():
    rnd = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 7))]
        coded = [S._front_coded(r) for r in runs]
        back = [S._decoded(*c) for c in coded]
        assert [rows for rows, _ in back] == runs
        order, lcp = S.merge_runs(runs, [list(n) for _, n in back])
        merged = [runs[r][k] for r, k in order]
        assert merged == sorted(x for r in runs for x in r)
        assert lcp == [0] * (len(merged) > 0) + [S.mismatch(a, b, 0) for a, b in zip(merged, merged[1:], strict=False)]


def test_windows_share_anchors():
    """Equal windows have their anchor at the same offset, wherever they are."""
    rnd = random.Random(9)
    same = bytes(rnd.choice(b"abc ") for _ in range(260))
    a, b = b"x" * 37 + same + b"y" * 300, b"zq" * 150 + same + b"w"
    import numpy as np

    offsets = []
    for t, at in ((a, 37), (b, 300)):
        c = S.Cells(t, np.zeros(1, np.int64))
        offsets.append([int(c.anchor[np.searchsorted(c.first, at + k, side="right") - 1]) - at for k in range(61)])
    assert offsets[0] == offsets[1]
