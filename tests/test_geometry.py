from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from tests.conftest import make_layer, poly, rect


def test_wkt_roundtrip_and_measures(spark):
    wkts = [
        ("POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,4 2,4 4,2 4,2 2))", 96.0, 0.0),
        ("SRID=2193;LINESTRING(0 0,3 4,3 10)", 0.0, 11.0),
        ("MULTILINESTRING((0 0,0 1),(5 5,5 7))", 0.0, 3.0),
        ("MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0)),((5 5,7 5,7 7,5 7,5 5)))", 5.0, 0.0),
        ("POINT(1.5 -2.25)", 0.0, 0.0),
    ]
    df = spark.createDataFrame([(w,) for w, _, _ in wkts], "wkt string").withColumn("geom", G.from_wkt("wkt"))
    rows = df.select(G.area().alias("a"), G.length().alias("l"), G.to_wkt().alias("w"), "geom.gtype").collect()
    for (w, a, length), r in zip(wkts, rows):
        if r["gtype"] != "POLYGON" or "," not in w.split("),(")[0]:
            pass
        if a:
            assert abs(r["a"] - a) < 1e-9
        if r["gtype"] in ("LINESTRING", "MULTILINESTRING"):
            assert abs(r["l"] - length) < 1e-9
    back = spark.createDataFrame([(r["w"],) for r in rows], "wkt string").select(G.to_wkt(G.from_wkt("wkt")).alias("w")).collect()
    assert [r["w"] for r in back] == [r["w"] for r in rows]
    assert rows[4]["w"] == "POINT(1.5 -2.25)"


def test_bbox_and_snap_dedupe(spark):
    layer = make_layer(spark, [(1, "p", "a", poly([(0, 0), (10, 0), (10, 0), (10, 10), (0, 10), (0, 0)]))])
    r = layer.select(G.xmin(), G.xmax(), G.ymin(), G.ymax(), G.num_points(G.snap("geom")).alias("n")).collect()[0]
    assert tuple(r[:4]) == (0.0, 10.0, 0.0, 10.0)
    assert r["n"] == 5  # repeated vertex removed by the snap


def test_area_of_rectangle(spark):
    layer = make_layer(spark, [(1, "p", "a", rect(1108000, 4758000, 1132000, 4794000))])
    assert layer.select(G.area()).collect()[0][0] == 24000.0 * 36000.0


def test_path_endpoints_mod2(spark):
    df = spark.createDataFrame([("MULTILINESTRING((0 0,0 1),(0 1,0 2))",), ("LINESTRING(0 0,1 0,0 0)",)], "w string")
    r = df.select(F.size(G.path_endpoints(G.from_wkt("w"))).alias("n")).collect()
    assert [x["n"] for x in r] == [2, 0]
