import os
import tempfile

from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.plans import runner
from sheetseam.plans import utilities as U
from sheetseam.schemas import ASSOCIATIONS_SCHEMA
from sheetseam.sources import derived as D
from sheetseam.sources import store as ST
from tests.conftest import line, make_layer, rect


def test_scan_filters(spark):
    layers = ST.scan_layer_dir(spark, "/root/testdata/sf0.001", ["order", "item"])
    assert sorted(layers) == ["lineitem", "orders"]
    assert len(ST.scan_layer_dir(spark, "/root/testdata/sf0.001")) >= 14


def test_write_export_verify_and_views(spark):
    base = tempfile.mkdtemp(prefix="sheetseam-store-")
    src = os.path.join(base, "src")
    layer = make_layer(spark, [(1, "k", "a", rect(0, 0, 1, 1)), (2, "k", "a", rect(1, 0, 2, 1))])
    ST.write_layer(layer, base + "/store", "new_roads")
    ST.write_layer(layer, base + "/store", "roads")
    stored = ST.scan_stored_layers(spark, base + "/store", ["roads"])
    assert list(stored) == ["new_roads"]
    out = ST.export_layer(stored["new_roads"], src, "new_roads", fmt="json")
    assert out.endswith("src_new/roads")
    back = spark.read.json(out)
    assert back.filter(F.col("geom").startswith("POLYGON((")).count() == 2
    ok = ST.verify_copy(layer, stored["new_roads"], "roads", "new_roads").first()
    assert ok["name_ok"] and ok["type_ok"] and ok["count_ok"]
    assert ST.strip_prefix("new_wen") == "wen"  # a prefix, not a character set
    views = ST.link_views(spark, base + "/store")
    assert views == ["stitch_view_roads"]
    released = ST.release_snapshot(spark, base + "/store", base + "/release")
    assert released == ["roads"] and spark.read.parquet(base + "/release/roads").count() == 2


def test_revisions_and_srid(spark):
    base = tempfile.mkdtemp(prefix="sheetseam-rev-")
    l1 = make_layer(spark, [(1, "k", "a", rect(0, 0, 1, 1))])
    l2 = make_layer(spark, [(1, "k", "b", rect(0, 0, 2, 2))])
    ST.revisioned_write(l1, base, "lakes", 1, "first")
    ST.revisioned_write(l2, base, "lakes", 2, "edit")
    assert ST.read_as_of(spark, base, "lakes", "ufid", 1).first()["cls"] == "a"
    assert ST.read_as_of(spark, base, "lakes", "ufid", 2).first()["cls"] == "b"
    assert ST.srid_of(ST.assign_srid(l1)) == 2193
    assert ST.srid_of(ST.assign_srid(l1, 4326)) == 4326


def test_text_fidelity(spark):
    df = spark.createDataFrame([(1, "Māori", "Y"), (2, "plain", "N")], "id long, name string, macronated string")
    r = ST.text_fidelity(df, ST.utf8_roundtrip(df, "name"), "id", "name", "macronated").first()
    assert (r["n_flagged"], r["n_mismatch"]) == (1, 0)


def test_utilities(spark):
    sheets = D.load_poly(spark, "/root/testdata/sf0.01")  # sheet column 40 exists from sf0.01 on
    edges = {(r["direction"], r["v"]) for r in U.irregular_edges(U.sheet_footprints(sheets)).collect()}
    assert edges == {("EW", 2092000)}
    ml = spark.createDataFrame(
        [(1, ("MULTILINESTRING", [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]], [[{"x": 5.0, "y": 5.0}, {"x": 6.0, "y": 6.0}]]]))],
        "ufid long, geom struct<gtype:string,parts:array<array<array<struct<x:double,y:double>>>>>",
    )
    assert U.remove_loops(ml, "ufid").first()["geom"]["gtype"] == "LINESTRING"


def test_run_import_process_export(spark):
    base = tempfile.mkdtemp(prefix="sheetseam-run-")
    src, store = base + "/shp", base + "/db"
    W, H, X0, Y0 = 24000, 36000, 1108000, 4758000
    a = make_layer(spark, [(1, "k", "a", rect(X0, Y0, X0 + W, Y0 + H)), (2, "k", "a", rect(X0, Y0 + H, X0 + W, Y0 + 2 * H))])
    ST.write_layer(a, src, "lake_poly")
    done = runner.run(spark, src, store, key="ufid")
    assert done["imported"] == ["lake_poly"] and done["processed"] == ["lake_poly"]
    out = spark.read.parquet(base + "/shp_new/lake_poly")
    assert out.count() == 1 and out.first()["ufid"] == 100_000_000
    assoc = runner.read_log(spark, store, runner.ASSOCIATIONS, ASSOCIATIONS_SCHEMA)
    assert assoc.count() == 1
    # a second run reuses the id
    runner.stitch_all(spark, store, key="ufid")
    assert ST.read_stored(spark, store, "new_lake_poly").first()["ufid"] == 100_000_000
    assert line  # keep import used


def test_wkt_numbers_and_heights(spark):
    texts = ["POINT(.5 5.)", "LINESTRING Z (0 0 1, 1.5 2. 3)", "POLYGON ZM((0 0 1 2, 1 0 1 2, 1 1 1 2, 0 0 1 2))", "POINT(1 x)", "MULTIPOINT((1 2))", "POINT EMPTY", "LINESTRING(1 2, 3)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.g for r in df.select("i", G.from_wkt("t").alias("g")).orderBy("i").collect()]
    assert [(g.gtype, [(p.x, p.y) for part in g.parts for path in part for p in path]) for g in got[:3]] == [
        ("POINT", [(0.5, 5.0)]), ("LINESTRING", [(0, 0), (1.5, 2)]), ("POLYGON", [(0, 0), (1, 0), (1, 1), (0, 0)]),
    ]
    assert got[3:] == [None] * 4


def test_two_writes_in_one_revision(spark, tmp_path):
    folder = str(tmp_path)
    write = lambda rows, n: ST.revisioned_write(spark.createDataFrame(rows, "k long, v string"), folder, "x", n, "c")
    write([(1, "a"), (2, "b")], 1)
    write([(1, "c")], 1)
    write([(2, "d")], 2)
    assert sorted((r.k, r.v) for r in ST.read_as_of(spark, folder, "x", "k", 1).collect()) == [(1, "c"), (2, "b")]
    assert sorted((r.k, r.v) for r in ST.read_as_of(spark, folder, "x", "k", 2).collect()) == [(1, "c"), (2, "d")]


def test_excise_in_sub_folders(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "sub" / "two"))
    got = ST.excise_column(spark, str(tmp_path), "b", deep=True)
    assert {n: df.columns for n, df in got.items()} == {"one": ["a"], "sub/two": ["a"]}
