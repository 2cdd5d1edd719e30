"""Unions that are decided within a group's row, against the union by joins."""

from pyspark.sql import functions as F

from sheetseam.functions import grid
from sheetseam.operators import dissolve as DS
from sheetseam.schemas import GEOMETRY
from tests.conftest import poly, rect

PLAIN = [
    (1, rect(0, 0, 2, 3)), (1, rect(0, 3, 2, 6)), (1, rect(2, 3, 4, 6)),
    (2, poly([(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)])), (2, poly([(4, 0), (6, 1), (4, 4), (4, 0)])),
]
ODD = [
    (11, rect(0, 0, 2, 2)), (11, rect(1, 1, 3, 3)),  # crossing
    (12, rect(0, 0, 2, 2)), (12, rect(2, 2, 4, 4)),  # a corner
    (13, rect(0, 0, 4, 2)), (13, rect(1, 2, 3, 4)),  # half an edge
    (14, rect(0, 0, 2, 2)), (14, rect(0, 0, 2, 2)),  # twice
    (15, poly([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 3), (3, 6), (6, 6), (6, 3), (3, 3)])),  # a hole
    (16, poly([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)])),  # a bow tie
    (17, poly([(0, 0), (5, 0), (5, 5), (5.00001, 0), (9, 0), (9, 9), (0, 9), (0, 0)])),  # a slit
    (None, rect(0, 0, 2, 2)), (18, None),
]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "comp long, geom " + GEOMETRY.simpleString())


def _texts(df):
    return {r.comp: r.g for r in df.select("comp", F.to_json("geom").alias("g")).collect()}


def test_plain_groups_take_no_joins(spark, monkeypatch):
    rows = _frame(spark, PLAIN)
    by_joins = _texts(DS._dissolved(rows))
    monkeypatch.setattr(DS, "_dissolved", lambda shapes: 1 / 0)
    assert _texts(DS.dissolve_polygons(rows)) == by_joins


def test_odd_and_large_groups_as_by_joins(spark, monkeypatch):
    rows = _frame(spark, PLAIN + ODD)
    by_joins = _texts(DS._dissolved(rows))
    assert _texts(DS.dissolve_polygons(rows)) == by_joins
    monkeypatch.setattr(DS, "ROW_POINTS", 10)  # the group of three polygons is large now
    assert _texts(DS.dissolve_polygons(rows)) == by_joins


def test_grid_tests_need_no_wide_decimals(spark):
    flags = grid.boundary_flags()
    df = spark.sql("SELECT CAST(v AS decimal(12, 2)) nv, CAST(v AS decimal(12, 2)) sv, CAST(v AS decimal(11, 0)) ev, CAST(v AS decimal(11, 0)) wv FROM VALUES (4794000), (4794000.01), (5862000.49), (5862000.5), (5861999.5), (-1000), (500) AS t(v)")
    got = df.select("nv", flags["n"], flags["e"], grid.on_northsouth("nv"), grid.on_nonstandard("nv")).collect()
    assert [tuple(r)[1:] for r in got] == [
        (True, True, True, False), (False, True, False, False), (False, True, False, True), (False, False, False, False), (False, True, False, True),
        (True, True, False, False), (False, False, False, False),
    ]
    plan = df.select(grid.on_northsouth("nv"), flags["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(2" not in plan and "decimal(3" not in plan  # beyond 18 digits they are no longs
