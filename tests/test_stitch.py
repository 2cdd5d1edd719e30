"""Hand-made stitching cases (one layer per geometry type; cases kept apart by the ``kind`` attribute)."""

import pytest
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.plans.stitching import stitch_layer
from sheetseam.schemas import GEOMETRY
from sheetseam.sources import derived as D
from tests.conftest import line, make_layer, poly, rect

W, H, X0, Y0 = 24000, 36000, 1108000, 4758000


def cell(sc, r):
    return rect(X0 + W * sc, Y0 + H * r, X0 + W * (sc + 1), Y0 + H * (r + 1))


POLY_ROWS = [
    (10, "full", "a", cell(0, 0)), (11, "full", "a", cell(0, 1)),
    (20, "corner", "a", cell(0, 0)), (21, "corner", "a", cell(1, 1)),
    (30, "part", "a", cell(0, 0)), (31, "part", "a", rect(X0 + 12000, Y0 + H, X0 + 36000, Y0 + 2 * H)),
    (40, "nullboth", None, cell(0, 0)), (41, "nullboth", None, cell(0, 1)),
    (50, "nullone", None, cell(0, 0)), (51, "nullone", "a", cell(0, 1)),
    (60, "gap", "a", cell(0, 0)), (61, "gap", "a", rect(X0, Y0 + H + 0.3, X0 + W, Y0 + 2 * H)),
    (70, "overlap", "a", cell(0, 0)), (71, "overlap", "a", rect(X0, Y0 + H - 0.3, X0 + W, Y0 + 2 * H)),
    (80, "sloped", "a", poly([(X0, Y0), (X0 + W, Y0), (X0 + W, Y0 + H + 0.2), (X0, Y0 + H - 0.2), (X0, Y0)])),
    (81, "sloped", "a", poly([(X0, Y0 + H - 0.2), (X0 + W, Y0 + H + 0.2), (X0 + W, Y0 + 2 * H), (X0, Y0 + 2 * H), (X0, Y0 + H - 0.2)])),
    (90, "block", "a", cell(0, 0)), (91, "block", "a", cell(1, 0)), (92, "block", "a", cell(0, 1)), (93, "block", "a", cell(1, 1)),
    (0, "zero", "a", cell(0, 0)), (1, "zero", "a", cell(0, 1)),
    (100, "regions", "a", cell(0, 18)), (101, "regions", "a", cell(0, 19)), (102, "regions", "a", cell(0, 20)),
    (110, "outside", "a", rect(2200000, Y0, 2224000, Y0 + H)),
]

X = 1120000
LINE_ROWS = [
    (10, "chain", "a", line((X, Y0), (X, Y0 + H))), (11, "chain", "a", line((X, Y0 + H), (X, Y0 + 2 * H))),
    (20, "loop", "a", line((X, Y0 + H), (X + 250, Y0), (X + 500, Y0 + H))),
    (21, "loop", "a", line((X, Y0 + H), (X + 250, Y0 + 2 * H), (X + 500, Y0 + H))),
    (30, "tee", "a", line((X - 500, Y0 + H), (X + 500, Y0 + H))), (31, "tee", "a", line((X, Y0 + H), (X, Y0 + 2 * H))),
    (40, "three", "a", line((X, Y0), (X, Y0 + H))), (41, "three", "a", line((X, Y0 + H), (X, Y0 + 2 * H))),
    (42, "three", "a", line((X + 1000, Y0), (X, Y0 + H))),
]


@pytest.fixture(scope="module")
def poly_result(spark):
    layer = make_layer(spark, POLY_ROWS)
    res = stitch_layer(layer, "ufid", "cases_poly", kind="polygon", regions=D.regions(spark))
    rows = res.interim.select("ufid", "kind", "ufid_components", G.area().alias("area"), "geom.gtype").collect()
    return res, {r["kind"]: r for r in rows}, rows


@pytest.fixture(scope="module")
def line_result(spark):
    layer = make_layer(spark, LINE_ROWS)
    res = stitch_layer(layer, "ufid", "cases_line", kind="line", regions=D.regions(spark))
    rows = res.interim.select("ufid", "kind", "ufid_components", G.num_points().alias("n"), "geom.gtype").collect()
    return res, rows


def _by_kind(rows, kind):
    return sorted((list(r["ufid_components"]) for r in rows if r["kind"] == kind))


def test_polygon_cases(poly_result):
    _, _, rows = poly_result
    assert _by_kind(rows, "full") == [[10, 11]]
    assert _by_kind(rows, "corner") == [[20], [21]]
    assert _by_kind(rows, "part") == [[30, 31]]
    assert _by_kind(rows, "nullboth") == [[40, 41]]
    assert _by_kind(rows, "nullone") == [[50], [51]]
    assert _by_kind(rows, "gap") == [[60], [61]]
    assert _by_kind(rows, "overlap") == [[70], [71]]
    assert _by_kind(rows, "sloped") == [[80, 81]]
    assert _by_kind(rows, "block") == [[90, 91, 92, 93]]
    assert _by_kind(rows, "zero") == [[0, 1]]
    assert _by_kind(rows, "regions") == [[100, 101, 102]]
    assert _by_kind(rows, "outside") == []
    assert len(rows) == 15


def test_polygon_union_area_and_type(poly_result):
    _, _, rows = poly_result
    cellarea = float(W * H)
    for r in rows:
        assert r["gtype"] == "POLYGON"
        if r["kind"] in ("full", "part", "nullboth", "zero"):
            assert abs(r["area"] - 2 * cellarea) < 1e-3
        if r["kind"] == "block":
            assert abs(r["area"] - 4 * cellarea) < 1e-3


def test_final_ids_in_component_order(poly_result):
    _, _, rows = poly_result
    comps = sorted((r for r in rows if len(r["ufid_components"]) > 1), key=lambda r: r["ufid_components"][0])
    assert [r["ufid"] for r in comps] == list(range(100_000_000, 100_000_000 + len(comps)))
    singles = [r for r in rows if len(r["ufid_components"]) == 1]
    assert all(r["ufid"] == r["ufid_components"][0] for r in singles)


def test_associations_and_no_collision(poly_result):
    res, _, rows = poly_result
    assoc = res.associations.collect()
    assert len(assoc) == 7
    assert all(a["layer"] == "new_cases_poly" for a in assoc)
    assert res.report.count() == 0


def test_rerun_gives_same_ids(spark, poly_result):
    res, _, rows = poly_result
    log = res.associations
    layer = make_layer(spark, POLY_ROWS)
    again = stitch_layer(layer, "ufid", "cases_poly", kind="polygon", regions=D.regions(spark), associations=log)
    first = {tuple(r["ufid_components"]): r["ufid"] for r in rows}
    second = {tuple(r["ufid_components"]): r["ufid"] for r in again.interim.select("ufid", "ufid_components").collect()}
    assert first == second


def test_line_cases(line_result):
    res, rows = line_result
    assert _by_kind(rows, "chain") == [[10, 11]]
    chain = [r for r in rows if r["kind"] == "chain"][0]
    assert chain["gtype"] == "LINESTRING" and chain["n"] == 3
    assert _by_kind(rows, "loop") == [[20], [21]]
    assert _by_kind(rows, "tee") == [[30], [31]]
    assert _by_kind(rows, "three") == [[40], [41], [42]]
    rep = res.report.collect()
    ns = sorted(r["ref"] for r in rep if "northsouth" in r["msg"])
    assert ns == [40, 41, 42]


def test_features_conserved_on_derived_layer(spark):
    poly_layer = D.load_poly(spark, "/root/testdata/sf0.001")
    res = stitch_layer(poly_layer, "ufid", "poly", kind="polygon", regions=D.regions(spark))
    out = res.interim.select(F.explode("ufid_components").alias("k"))
    assert out.count() == poly_layer.count() == out.distinct().count()
    assert res.layer.count() == 952
    total = res.interim.agg(F.sum(G.area())).collect()[0][0]
    assert abs(total - poly_layer.count() * W * H) < 1.0


def test_attributes_may_have_any_name(spark):
    """Attributes called like working columns keep features apart and come out unchanged."""
    names = ["n", "s", "e", "w", "k", "v", "lo", "hi", "regions", "layer", "comp", "bucket", "found"]
    ddl = "ogc_fid long, ufid long, " + ", ".join(f"{c} long" for c in names) + ", geom " + GEOMETRY.simpleString()
    rows = []
    for i, c in enumerate([None, *names]):  # a pair per column of sheets: equal, or different in one attribute
        for r in (0, 1):
            rows.append((2 * i + r, 2 * i + r, *(r if n == c else 7 for n in names), cell(i, r)))
    layer = spark.createDataFrame(rows, ddl)
    for scope in ("global", "layer"):
        out = stitch_layer(layer, "ufid", "poly", kind="polygon", scope=scope, attrs=names).layer.collect()
        assert len(out) == 1 + 2 * len(names)
        assert all(r[n] in (0, 1, 7) for r in out for n in names)


def test_dense_faces_meet_only_their_neighbours(spark):
    """5,000 short faces beside each other on one sheet line, and one long face over a part of them."""
    from sheetseam.operators import candidates as C
    from sheetseam.plans.stitching import prepare

    n, step, y = 2500, 4, Y0 + H
    rows = [(2 * k + s, "k", "a", rect(X0 + step * k, y - 10 * (1 - s), X0 + step * (k + 1), y + 10 * s)) for k in range(n) for s in (0, 1)]
    rows.append((99_999, "k", "a", rect(X0, y, X0 + 2000, y + 50)))
    cand = C.boundary_candidates(prepare(make_layer(spark, rows), "ufid", D.regions(spark)), True, C.NS)
    met = C._meeting(cand, "ufid", ["kind", "cls"], True, C.NS).count()
    pairs = {(r[0], r[1]) for r in C.face_join(cand, "ufid", ["kind", "cls"], True, C.NS).select("h.k", "l.k").collect()}
    want = {(2 * k, 2 * j + 1) for k in range(n) for j in (k - 1, k, k + 1) if 0 <= j < n}
    want |= {(2 * k, 99_999) for k in range(n) if step * k <= 2000}
    assert pairs == want
    assert met < 40 * len(want)


def test_box_and_regions_are_worked_out_once_per_row(spark):
    """A filter on the flags or on the regions does not repeat the geometry's expressions."""
    from sheetseam.operators import candidates as C
    from sheetseam.plans.stitching import prepare

    layer = make_layer(spark, [(0, "k", "a", cell(0, 0)), (1, "k", "a", cell(0, 1))])
    prepared = prepare(layer, "ufid", D.regions(spark))
    plan = prepared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 2 and plan.count("array_min(") == 2
    bare = layer.select("ufid", "kind", "cls", "geom").withColumn(C.REGIONS, F.array(F.lit("all")))
    plan = C.boundary_candidates(bare, True, C.NS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") <= 2 and plan.count("array_min(") <= 2


def test_sheet_wide_faces_lie_in_few_stretches(spark):
    from sheetseam.operators import candidates as C

    wide = spark.range(40).select((1_108_000.0 + 24_000 * F.col("id")).alias("lo")).withColumn("hi", F.col("lo") + 24_000)
    rows = C._in_stretches(wide, True).count() + C._in_stretches(wide, False).count()
    assert rows < 2 * 40 * 2
