"""Sizes and components equal a comparison of all pairs."""

import random

import pytest

from sheetseam.llm import ngram_join


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][0], rows[b][0]
            both = len(sets[a] & sets[b])
            if x is not None and y is not None and sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))


def documents(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ä", "the", "THE"]
    rows, passage = [], [rnd.choice(words) for _ in range(30)]
    for i in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 5, 8, 30, 120]))]
        if i % 4 == 0:
            base += passage
        rows.append((1000 - i, " ".join(base)))
        for j in range(rnd.choice([0, 0, 1, 6])):
            near = list(base)
            for _ in range(rnd.randint(0, 3)):
                if near:
                    near[rnd.randrange(len(near))] = rnd.choice(words)
            rows.append((2000 + 20 * i + j, "\n".join(near)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(llm, seed):
    rows = documents(seed) + [(None, "a b c d e f"), (5, None), (6, ""), (7, " \t\n"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "A B c d e F")]
    df = llm.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, component_id long, n string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert got == brute(rows)


def test_blocks_and_the_exact_rest(llm, monkeypatch):
    """With tiny blocks the prefix trees miss links; the exact rest finds them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    rows = documents(3)
    df = llm.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert got == brute(rows)


def test_prefix_tree_finds_every_component():
    rnd = random.Random(4)
    for _ in range(60):
        pool = list(range(30))
        sets = [sorted(rnd.sample(pool, rnd.randint(1, 24))) for _ in range(rnd.randint(2, 25))]
        sizes = [len(s) + rnd.choice([0, 0, 1, 2]) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: sizes[i])
        tree = ngram_join.PrefixTree()
        for i in order:
            tree.join(sets[i], sizes[i])
        parent = list(range(len(sets)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                i, j = order[a], order[b]
                both = len(set(sets[i]) & set(sets[j]))
                if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
                    parent[find(a)] = find(b)
        same = lambda f: [[f(a) == f(b) for b in range(len(sets))] for a in range(len(sets))]
        assert same(tree.find) == same(find)


def test_empty(llm):
    df = llm.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(df).collect() == []
