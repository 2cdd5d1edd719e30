"""List ranking and line merge against plain walks over the paths."""

import random
from collections import defaultdict

import pytest

from sheetseam.operators.lines import merge_lines, without_loops, without_triple_points
from sheetseam.operators.ranking import rank_lists
from tests.conftest import line

GEOM = "comp long, geom struct<gtype:string,parts:array<array<array<struct<x:double,y:double>>>>>"


def walk(paths):
    """Chains of paths (tuples of points), sewn where exactly two path ends meet."""
    ends = defaultdict(list)
    for i, p in enumerate(paths):
        ends[p[0]].append(i)
        ends[p[-1]].append(i)
    left, out = set(range(len(paths))), []

    def run(first):
        seq = list(first)
        while len(ends[seq[-1]]) == 2:
            nxt = next((i for i in ends[seq[-1]] if i in left), None)
            if nxt is None:
                break
            left.discard(nxt)
            p = paths[nxt]
            seq += (p if p[0] == seq[-1] else p[::-1])[1:]
        return seq

    for i in range(len(paths)):
        for p in (paths[i], paths[i][::-1]):
            if i in left and len(ends[p[0]]) != 2:
                left.discard(i)
                out.append(run(p))
    while left:
        i = left.pop()
        out.append(run(paths[i]))
    return out


def shape(chain):
    """A chain whatever its direction (of a ring: and its start)."""
    if chain[0] == chain[-1]:
        ring = chain[:-1]
        turns = [ring[k:] + ring[:k] for k in range(len(ring))]
        return ("ring", *min(min(t, [t[0], *t[:0:-1]]) for t in turns))
    return ("open", *min(chain, chain[::-1]))


def found(df):
    return {r.comp: sorted(shape([(round(p.x, 6), round(p.y, 6)) for p in part[0]]) for part in r.geom.parts) for r in df.collect()}


def test_ranks_of_lists_and_rings(spark):
    rnd = random.Random(4)
    ids = rnd.sample(range(10**6), 700)
    lists, at = [], 0
    for size in [1, 1, 2, 3, 5, 64, 65, 200]:
        lists += [("open", ids[at : at + size]), ("ring", ids[at + size : at + 2 * size])]
        at += 2 * size
    rows = []
    for kind, l in lists:
        rows += [(a, b) for a, b in zip(l, l[1:] + [l[0] if kind == "ring" else None])]
    rnd.shuffle(rows)
    got = defaultdict(list)
    for r in rank_lists(spark.createDataFrame(rows, "id long, next long")).collect():
        got[r.ring, r.label].append((-r.rest, r.id))
    for kind, l in lists:
        if kind == "open":
            assert [i for _, i in sorted(got[False, l[-1]])] == l
            assert sorted(-r for r, _ in got[False, l[-1]]) == list(range(1, len(l) + 1))
        else:
            k = l.index(min(l))
            assert [i for _, i in sorted(got[True, min(l)])] == l[k:] + l[:k]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_groups(spark, seed):
    rnd = random.Random(seed)
    groups, rows = {}, []
    for comp in range(60):
        paths = []
        for _ in range(rnd.randint(1, 9)):
            n = rnd.choice([2, 2, 3, 4])
            pts = [(float(rnd.randrange(3)), float(rnd.randrange(3))) for _ in range(n)]
            pts = [p for k, p in enumerate(pts) if k == 0 or p != pts[k - 1]]
            if len(pts) > 1:
                paths.append(tuple(pts))
        if paths:
            groups[comp] = paths
            rows += [(comp, line(*p)) for p in paths]
    df = spark.createDataFrame(rows, GEOM)
    got = found(merge_lines(df))
    assert set(got) == set(groups)
    for comp, paths in groups.items():
        want = walk(paths)
        assert sorted(len(s) for s in got[comp]) == sorted(len(shape(c)) for c in want)
        assert [s for s in got[comp] if s[0] == "open"] == sorted(shape(c) for c in want if c[0] != c[-1])
    # loops: the same rounds on plain walks
    got = found(without_loops(df))
    for comp, paths in groups.items():
        chains = walk(paths)
        while any(c[0] == c[-1] for c in chains) and any(c[0] != c[-1] for c in chains):
            chains = walk([tuple(c) for c in chains if c[0] != c[-1]])
        assert len(got[comp]) == len(chains) and sorted(len(s) for s in got[comp]) == sorted(len(shape(c)) for c in chains)


def test_a_long_chain_and_a_long_ring(spark):
    rnd = random.Random(1)
    n = 30_000
    chain = [((float(k), 0.0), (float(k + 1), 0.0)) for k in range(n)]
    ring = [((float(k), 1.0), (float((k + 1) % n), 1.0)) for k in range(n)]
    rows = [(1, line(*p[:: rnd.choice([1, -1])])) for p in chain] + [(2, line(*p[:: rnd.choice([1, -1])])) for p in ring]
    rnd.shuffle(rows)
    got = {r.comp: r.geom for r in merge_lines(spark.createDataFrame(rows, GEOM)).collect()}
    assert [round(p.x, 6) for p in got[1].parts[0][0]] == [float(k) for k in range(n + 1)]
    xs = [round(p.x, 6) for p in got[2].parts[0][0]]
    assert got[2].gtype == "LINESTRING" and xs[0] == xs[-1] and sorted(xs[:-1]) == [float(k) for k in range(n)]
    assert all(abs(a - b) in (1, n - 1) for a, b in zip(xs, xs[1:]))


def test_triple_points(spark):
    multi = lambda *paths: ("MULTILINESTRING", [[[{"x": float(x), "y": float(y)} for x, y in p]] for p in paths])
    t = (2, 2)
    df = spark.createDataFrame([(1, multi([(0, 0), t, (4, 4)], [(0, 4), t], [t, (4, 0)])), (2, multi([(0, 0), t], [t, (4, 4)], [t, (0, 4)]))], GEOM)
    assert found(without_triple_points(df)) == {
        1: [("open", (0.0, 0.0), (4.0, 4.0)), ("open", (0.0, 4.0), (2.0, 2.0), (4.0, 0.0))],
        2: [("open", (0.0, 4.0), (2.0, 2.0), (4.0, 4.0))],
    }


def test_only_groups_that_lost_a_loop_are_sewn_again(spark, monkeypatch):
    from sheetseam.operators import lines

    a, b, c, p, q = (0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (1.0, 3.0), (4.0, 3.0)
    groups = {1: [(a, b), (b, c), (p, b)], 2: [(a, b), (b, p, q, b), (b, c)], 3: [(p, q), (p, b, q)], None: [(a, b), (b, p, q, b), (b, c)]}
    rows = [(g, ("MULTILINESTRING", [[[{"x": x, "y": y} for x, y in path]] for path in paths])) for g, paths in groups.items()]
    sewn, seen = lines.sewn, []

    def watched(paths):
        seen.append({r.comp for r in paths.select("comp").distinct().collect()})
        return sewn(paths)

    monkeypatch.setattr(lines, "sewn", watched)
    out = {r.comp: [[(round(v.x, 6), round(v.y, 6)) for v in path] for part in r.geom.parts for path in part] for r in without_loops(spark.createDataFrame(rows, GEOM)).collect()}
    assert seen == [{1, 2, 3, None}, {2}]
    assert out[2] == [[a, b, c]] and len(out[1]) == 3 and len(out[3]) == 1 and out[3][0][0] == out[3][0][-1]
    assert len(out[None]) == 3  # no group: left as it is
