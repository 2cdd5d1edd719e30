import random

from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.operators import components as K
from sheetseam.operators import ids as I
from sheetseam.operators import inspect as X
from sheetseam.operators.regions import region_join
from sheetseam.sources import derived as D
from tests.conftest import line, make_layer, rect


def _uf_components(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in parent}


def test_connected_components_vs_union_find(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(1000, 1040)]  # a long path (many rounds)
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "merge_id long, drop_id long")
    got = {r["id"]: r["comp"] for r in K.connected_components(df).collect()}
    assert got == _uf_components(edges)


def test_components_of_giant_groups(spark):
    """A path and a star of many nodes finish in a bounded number of steps."""
    n = 20_000
    path = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("merge_id"), ((F.col("id") + 1) * 7919 % n).alias("drop_id"))
    star = spark.range(n).select(F.lit(5 * n).cast("long").alias("merge_id"), (F.col("id") + 2 * n).alias("drop_id"))
    r = K.connected_components(path.unionByName(star)).groupBy("comp").count().collect()
    assert sorted((x["comp"], x["count"]) for x in r) == [(0, n), (2 * n, n + 1)]


def _shape(*parts):
    return ("POLYGON" if len(parts) == 1 else "MULTIPOLYGON", [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts])


def _box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def _small_boxes():
    import random

    rnd = random.Random(3)
    out = []
    for k in range(60):
        w, s = rnd.randint(0, 95) * 1000, rnd.randint(0, 95) * 1000
        out.append((k, "a", None, _shape([_box(w, s, w + rnd.choice([500, 3000, 40000]), s + rnd.choice([500, 3000, 40000]))])))
    return out


def _regions_of_any_shape(spark, more=0):
    from sheetseam.schemas import REGION_SCHEMA

    rows = [
        ("triangle", _shape([[(0, 0), (90000, 0), (0, 90000), (0, 0)]])),
        ("holed", _shape([_box(0, 0, 100000, 100000), _box(20000, 20000, 80000, 80000)])),
        ("parts", _shape([_box(0, 0, 30000, 30000)], [_box(60000, 60000, 99000, 99000)])),
    ]
    rows += [(f"r{i:03d}", _shape([_box(i * 1000, 0, i * 1000 + 1500, 100000)])) for i in range(more)]
    return spark.createDataFrame(rows, REGION_SCHEMA)


def _meets(box, name):
    """Exact answer for a box and the regions above."""
    w, s, e, n = box
    over = lambda a, b, c, d: w <= c and e >= a and s <= d and n >= b
    if name == "triangle":
        return w + s <= 90000
    if name == "holed":
        return over(0, 0, 100000, 100000) and not (w > 20000 and e < 80000 and s > 20000 and n < 80000)
    if name == "parts":
        return over(0, 0, 30000, 30000) or over(60000, 60000, 99000, 99000)
    i = int(name[1:])
    return over(i * 1000, 0, i * 1000 + 1500, 100000)


def test_regions_of_any_shape_and_number(spark):
    from sheetseam.operators import regions as R

    rows = _small_boxes()
    layer = make_layer(spark, rows)
    want = set()
    for more in (0, 70):
        names = ["triangle", "holed", "parts", *(f"r{i:03d}" for i in range(more))]
        for k, _, _, g in rows:
            ring = g[1][0][0]
            box = (ring[0]["x"], ring[0]["y"], ring[2]["x"], ring[2]["y"])
            want |= {(k, name) for name in names if _meets(box, name)}
        regs = _regions_of_any_shape(spark, more)
        assert (R.small_regions(regs) is None) == (more > 0)
        got = {(r["ufid"], r["region"]) for r in region_join(layer, regs, "ufid").collect()}
        assert got == want


def test_features_that_hold_or_cross_regions(spark):
    from sheetseam.operators import regions as R
    from sheetseam.schemas import REGION_SCHEMA

    small = spark.createDataFrame([("dot", _shape([_box(50000, 50000, 50100, 50100)]))], REGION_SCHEMA)
    layer = make_layer(spark, [
        (1, "a", None, _shape([_box(0, 0, 100000, 100000)])),
        (2, "a", None, _shape([_box(0, 0, 100000, 100000), _box(40000, 40000, 60000, 60000)])),
        (3, "a", None, line((0, 50050), (100000, 50050))),
        (4, "a", None, line((0, 0), (1000, 1000))),
    ])
    want = {(1, "dot"), (3, "dot")}
    assert {(r["ufid"], r["region"]) for r in region_join(layer, small, "ufid").collect()} == want
    cells = R._by_cells(layer.select(F.col("ufid").alias("id"), "geom"), small)
    assert {(r["id"], r["region"]) for r in cells.collect()} == want


def _unions(spark, groups):
    """Unions of groups of polygons (lists of rings as points): ``comp -> geom``."""
    from sheetseam.operators.dissolve import dissolve_polygons

    shape = lambda rings: ("POLYGON", [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]])
    rows = [(comp, shape(rings)) for comp, members in groups.items() for rings in members]
    df = spark.createDataFrame(rows, "comp long, geom struct<gtype:string,parts:array<array<array<struct<x:double,y:double>>>>>")
    return {r.comp: r for r in dissolve_polygons(df).select("comp", "geom", G.area().alias("area")).collect()}


def test_union_of_repeated_overlapping_and_sloped_members(spark):
    import numpy as np

    box = lambda *b: [_box(*b)]
    a, b = box(0, 0, 24000, 36000), box(0, 36000, 24000, 72000)
    sloped = [[(0, 0), (24000, 100), (24000, 36000), (0, 36000), (0, 0)]]
    left = [[(0, -1000), (12000, -1000), (12000, 50), (0, 0), (0, -1000)]]
    right = [[(12000, -1000), (24000, -1000), (24000, 100), (12000, 50), (12000, -1000)]]
    groups = {-1: [a, a, b], -2: [a, box(6000, 0, 30000, 36000), b], -3: [sloped, left, right]}
    want = {-1: 1_728_000_000, -2: 1_944_000_000, -3: 888_000_000}
    rnd = random.Random(1)
    for k in range(150):
        boxes = []
        for _ in range(rnd.randint(1, 7)):
            w, s = rnd.randint(0, 12), rnd.randint(0, 12)
            boxes.append((w, s, w + rnd.randint(1, 6), s + rnd.randint(1, 6)))
        want[k] = len({(x, y) for w, s, e, n in boxes for x in range(w, e) for y in range(s, n)})
        t = rnd.choice([0, 0.3, 1.1])
        turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        groups[k] = [[(np.array(ring, float) @ turn.T + 1e6).tolist() for ring in box(*b)] for b in boxes]
    got = _unions(spark, groups)
    assert {k: r.geom.gtype for k, r in got.items() if r.geom.gtype not in ("POLYGON", "MULTIPOLYGON")} == {}
    assert all(abs(got[k].area - a) < 1e-3 for k, a in want.items())
    three = got[-3].geom
    assert three.gtype == "POLYGON" and len(three.parts[0]) == 1 and len(three.parts[0][0]) == 8
    for r in got.values():  # rings pass no point twice
        assert all(len(set(ring[:-1])) == len(ring) - 1 and ring[0] == ring[-1] for part in r.geom.parts for ring in part)


def test_unions_with_holes_and_touching_rings(spark):
    frame = [[_box(0, 0, 9, 3)], [_box(0, 6, 9, 9)], [_box(0, 3, 3, 6)], [_box(6, 3, 9, 6)]]
    island = [[_box(4, 4, 5, 5)]]
    pinched = [[[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 3), (3, 6), (3, 3), (0, 3)]]]  # a hole that touches the shell
    apart = [[_box(0, 0, 1, 1)], [_box(1, 1, 2, 2)]]  # two boxes that meet in a corner
    holed = [[_box(0, 0, 9, 9), _box(3, 3, 6, 6)], [_box(4, 4, 7, 7)]]
    got = _unions(spark, {1: frame, 2: frame + island, 3: pinched, 4: apart, 5: holed, 6: [[[(0, 0), (1, 1), (0, 0)]]]})
    shells = lambda k: [len(part) for part in got[k].geom.parts]
    assert (got[1].geom.gtype, shells(1), round(got[1].area, 6)) == ("POLYGON", [2], 72)
    assert (got[2].geom.gtype, sorted(shells(2)), round(got[2].area, 6)) == ("MULTIPOLYGON", [1, 2], 73)
    assert (got[3].geom.gtype, shells(3), round(got[3].area, 6)) == ("POLYGON", [2], 81 - 4.5)
    assert (got[4].geom.gtype, shells(4), round(got[4].area, 6)) == ("MULTIPOLYGON", [1, 1], 2)
    assert (got[5].geom.gtype, shells(5), round(got[5].area, 6)) == ("POLYGON", [2], 81 - 5)
    assert got[6].geom.gtype == "NOT CLOSED" and got[6].geom.parts is None


def test_union_of_one_large_group(spark):
    """A strip of cells with a saw-tooth edge between any two: no cell of the grid and no task has to hold the group."""
    n, teeth = 40, 100
    saw = lambda k: [(10 * k + (j % 2), j) for j in range(teeth + 1)]
    members = []
    for k in range(n):
        left, right = saw(k), saw(k + 1)
        ring = [*left[::-1], *right]
        members.append([[*ring, ring[0]]])
    got = _unions(spark, {1: members})[1]
    assert got.geom.gtype == "POLYGON" and abs(got.area - 10 * n * teeth) < 1e-6
    assert len(got.geom.parts[0][0]) == 2 * (teeth + 1) + 2 * (n - 1) + 1


def test_maximal_sets(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3],), ([3, 2, 1],), ([7, 8],), ([8],)], "ids array<long>")
    got = sorted(tuple(r["ids"]) for r in K.maximal_sets(df).collect())
    assert got == [(1, 2, 3), (7, 8)]


def test_dense_rank_by(spark):
    df = spark.createDataFrame([(v,) for v in random.Random(3).sample(range(10_000), 500)], "v long")
    r = I.dense_rank_by(df, "v").collect()
    ordered = sorted(r, key=lambda x: x["v"])
    assert [x["rank"] for x in ordered] == list(range(500))


def test_detect_key_rules(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 2, 6), (2, 3, None)], "a long, b long, c long")
    assert X.detect_key_name(df) == "b"  # one NULL allowed
    df2 = spark.createDataFrame([(1, None), (1, None)], "a long, b long")
    assert X.detect_key_name(df2) == "ufid"  # two NULLs are a repeated value
    assert X.detect_key_name(spark.createDataFrame([], "a long")) == "ufid"
    assert X.detect_key_name(D.read_table(spark, "/root/testdata/sf0.001", "orders")) == "o_orderkey"


def test_dispatch_and_purge(spark):
    rows = [(1, "k", "a", rect(0, 0, 1, 1)), (2, "k", "a", rect(0, 0, 1, 1)), (3, "k", "a", line((0, 0), (1, 1)))]
    layer = make_layer(spark, rows)
    assert X.dispatch_kind(layer) == "polygon"
    assert sorted(r["ufid"] for r in X.purge_minority(layer).collect()) == [1, 2]
    uniform = make_layer(spark, rows[:2])
    assert X.purge_minority(uniform).count() == 2  # a uniform layer is left alone


def test_region_join_exact_for_straddlers(spark):
    regions = D.regions(spark)
    rows = [
        (1, "k", "a", rect(1108000, 4758000, 1132000, 4794000)),  # south
        (2, "k", "a", rect(1108000, 5442000, 1132000, 5478000)),  # straddles the split
        (3, "k", "a", line((2090000, 6190000), (2110000, 6210000))),  # crosses the north-east corner
        (4, "k", "a", line((2101000, 6150000), (2120000, 6100000))),  # bbox overlaps nothing
    ]
    got = sorted((r["ufid"], r["region"]) for r in region_join(make_layer(spark, rows), regions, "ufid").collect())
    assert got == [(1, "south"), (2, "north"), (2, "south"), (3, "north")]


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    assert [(r["k"], r["n"]) for r in I.duplicate_keys(df, "k").collect()] == [(1, 2)]


def test_latest_association_wins(spark):
    import datetime as dt

    t1, t2 = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    log = spark.createDataFrame(
        [(t1, "new_a", 100, [1, 2]), (t2, "new_b", 105, [2, 1]), (t1, "new_a", 101, [3, 4])], I.empty_associations(spark).schema
    )
    got = {tuple(r["comps"]): r["found"] for r in I.latest_ids(log).collect()}
    assert got == {(1, 2): 105, (3, 4): 101}
    one = {tuple(r["comps"]): r["found"] for r in I.latest_ids(log.filter("layer = 'new_a'")).collect()}
    assert one[(1, 2)] == 100


def test_array_helpers(spark):
    from sheetseam.functions.arrays import array_union_agg, normalise_ids

    df = spark.createDataFrame([(1, [3, 1]), (1, [2, 3]), (2, [])], "g long, a array<long>")
    got = {r["g"]: r["u"] for r in df.groupBy("g").agg(array_union_agg("a").alias("u")).collect()}
    assert got == {1: [1, 2, 3], 2: []}
    assert df.select(normalise_ids(F.array(F.lit(3), F.lit(1), F.lit(3)))).first()[0] == [1, 3]
