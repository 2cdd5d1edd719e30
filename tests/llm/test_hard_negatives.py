"""Windows equal a plain comparison of every anchor with every row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetseam.llm import hard_negatives as H

SHAPE = "vec_id long, label int, embedding array<float>"


def brute(rows, every=10):
    one = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [float(np.float32(x)) for x in v])
        one[i] = min(one.get(i, row), row)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in whole.items() if i != a)
        same = [(-s, i) for s, i in ranked if whole[i][0] == label][:5]
        for p, i in same:
            fits = [(-s, j) for s, j in ranked if whole[j][0] != label and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(a, i, k, j, p, s) for k, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def rows_of(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rnd.choice([-0.5, 0.0, 0.25, 0.3, 1.0, rnd.uniform(-1, 1)]) for _ in range(4)]
        rows.append((i - 40, rnd.randrange(3), v))
    for i in range(60):  # ties: equal vectors of all labels
        rows.append((1000 + i, i % 3, [1.0, 0.5, 0.25, 1.0]))
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0]), (2000, None, [1.0]), (2010, 1, None), (2020, 1, [1.0, None]), (2030, 1, [nan]), (2040, 1, [1.0, -inf]), (2050, 1, []), (2060, 2, [9.0]), (2070, 7, [1.0] * 4), (2080, 1, [0.0] * 6)]
    return rows + odd + rows[:20] + [(1000, 2, [1.0] * 4)]


@pytest.mark.parametrize("seed,rows,anchors,strip,held", [(1, 8192, 4096, 128, 1 << 20), (2, 50, 7, 3, 20)])
def test_against_all_pairs(llm, monkeypatch, seed, rows, anchors, strip, held):
    for name, value in (("ROWS", rows), ("ANCHORS", anchors), ("STRIP", strip), ("HELD", held)):
        monkeypatch.setattr(H, name, value)
    data = rows_of(seed)
    df = llm.createDataFrame([(*r, 1, 2) for r in data], SHAPE + ", id int, anchor int")
    got = sorted(tuple(r) for r in H.mine(df, F.expr("id % 10 = 0")).collect())
    assert got == brute(data)
    assert len(got) > 300


def test_empty_table_and_no_anchor(llm):
    assert H.mine(llm.createDataFrame([], SHAPE), F.expr("id % 10 = 0")).count() == 0
    assert H.mine(llm.createDataFrame([(3, 1, [1.0])], SHAPE), F.expr("id % 10 = 0")).count() == 0


def test_the_stream_alone_reads_every_pair():
    """The iterator needs nothing but sorted keys: fed with all pairs, it finds what the whole operator finds."""
    data = [(i, label, v) for i, label, v in rows_of(3) if i is not None and label is not None and v and len(v) == 4]
    whole = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in data}
    records = []
    for a in whole:
        if a % 10 == 0:
            records += [(H.key_of(a, sum(x * y for x, y in zip(whole[a][1], w, strict=True)), i), whole[i][0] == whole[a][0]) for i, (_, w) in whole.items() if i != a]
    assert sorted(H.windows_of(iter(sorted(records)))) == brute([(i, label, [x / 256 for x in v]) for i, (label, v) in whole.items()])


def test_large_components_stay_exact():
    rows = np.array([[2**40, -(2**40)], [3, 5], [2**61, 2**61]], dtype=np.int64)
    got = H.scores(rows, rows[:2])
    assert got.tolist() == [[H.LARGEST, -2 * 2**40], [-2 * 2**40, 34], [0, H.LARGEST]]
    small = np.array([[2**27, 1]], dtype=np.int64)
    assert H.scores(small, small).tolist() == [[2**54 + 1]]


def test_keys_sort_as_numbers():
    rnd = random.Random(5)
    rows = [tuple(rnd.choice([-(2**62), -5, 0, 7, 2**61]) for _ in range(3)) for _ in range(200)]
    assert sorted(rows, key=lambda r: H.key_of(*r)) == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    packed = H._keys_of(*np.array(rows, dtype=np.int64).T)
    assert packed == b"".join(H.key_of(*r) for r in rows)
