"""Sizes and components equal a comparison of all pairs, also when nodes are small, trees end early and blocks share little."""

import random

import numpy as np
import pytest

from sheetseam.llm import chosen_path as P


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][0], rows[b][0]
            both = len(sets[a] & sets[b])
            if x is not None and y is not None and sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in P.near_duplicates(df).collect())


def documents(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["Ä", "the", "THE"]
    rows, passage = [], [rnd.choice(words) for _ in range(40)]
    for i in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 8, 60, 150]))]
        if i % 3 == 0:
            base += passage
        rows.append((1000 - i, " ".join(base)))
        for j in range(rnd.choice([0, 0, 1, 6])):
            near = list(base)
            for _ in range(rnd.randint(0, 3)):
                if near:
                    near[rnd.randrange(len(near))] = rnd.choice(words)
            rows.append((2000 + 20 * i + j, "\n".join(near)))
    base = [rnd.choice(words) for _ in range(120)]  # a large group: few of its pairs link, all of them share most tokens
    for j in range(60):
        near = list(base)
        for _ in range(rnd.randint(0, 6)):
            near[rnd.randrange(len(near))] = rnd.choice(words)
        rows.append((4000 + j, " ".join(near)))
    return rows


ODD = [(None, "a b c d e f"), (5, None), (6, ""), (7, " \t\n"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "A B c d e F"), (10, "x y z q"), (3, "x y z q"), (10, "k l m n o"), (4, "k l m n o")]


@pytest.mark.parametrize("seed,limit,shared,depth", [(1, 64, 4, 5), (2, 6, 1, 2), (3, 5, 2, 1)])
def test_against_all_pairs(llm, monkeypatch, seed, limit, shared, depth):
    for name, value in (("LIMIT", limit), ("SHARED", shared), ("DEPTH", depth)):
        monkeypatch.setattr(P, name, value)
    rows = documents(seed) + ODD
    df = llm.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, rep long, cls string")
    assert found(df) == brute(rows)


def test_given_documents(llm):
    df = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_sets_by_a_join_and_very_long_texts(llm, monkeypatch):
    monkeypatch.setattr("sheetseam.llm.common.SMALL_ROWS", 0)
    rnd = random.Random(9)
    long = [f"v{rnd.randrange(10**6)}" for _ in range(200_000)]
    other = [w if rnd.random() > 0.015 else "new" for w in long]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:150_000])), (4, "y" * 3_000_000), (5, None)]
    got = found(llm.createDataFrame(rows, "doc_id long, text string"))
    assert [(r[0], r[2]) for r in got] == [("1", 1), ("2", 1), ("3", 3), ("4", 4), ("5", 5)]


def test_empty_table(llm):
    assert P.near_duplicates(llm.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_the_trees_alone():
    """Sets at the threshold meet in some first node nearly always; unlike ones seldom do."""
    rnd = np.random.default_rng(3)
    flat = rnd.integers(0, 2**63, size=(300, 540), dtype=np.uint64)
    near, far = [], []
    for row in flat:
        near.append((np.unique(row[:500]), np.unique(row[40:])))  # 460 of 540 in common: 85.2 %
        far.append((np.unique(row[:300]), np.unique(row[270:])))
    seeds = P.mixed(np.arange(1, P.TREES + 1, dtype=np.uint64))

    def met(pairs):
        tokens = [P.minwise([p[k] for p in pairs]) >> np.uint64(32) for k in (0, 1)]
        hit = np.zeros(len(pairs), dtype=bool)
        for s in seeds:
            own = [set(zip(*(x.tolist() for x in P.picks(np.repeat(s, len(pairs)), t)), strict=True)) for t in tokens]
            hit[[row for row, _ in own[0] & own[1]]] = True
        return hit.mean()

    assert met(near) == 1.0
    assert met(far) < 0.8
    assert P.TREES == 8
