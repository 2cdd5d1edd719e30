from decimal import Decimal

from pyspark.sql import functions as F

from sheetseam.functions import grid
from sheetseam.functions.geometry import round_numeric


def _eval(spark, values, fn):
    df = spark.createDataFrame([(Decimal(v),) for v in values], "v decimal(18,2)")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_northsouth_golden_vectors(spark):
    # true for 4794000, 5334000; false for 4793000, 366000, 6234000, 5334001
    vals = [4794000, 5334000, 4793000, 366000, 6234000, 5334001]
    assert _eval(spark, vals, grid.on_northsouth) == [True, True, False, False, False, False]


def test_grid_extremes(spark):
    assert _eval(spark, [4758000, 6162000, 4722000, 6198000], grid.on_northsouth) == [True, True, False, False]
    assert _eval(spark, [1108000, 2068000, 1084000, 2092000], grid.on_eastwest) == [True, True, False, False]


def test_nonstandard_list():
    assert len(grid.NONSTANDARD_EDGES) == 99
    assert len(grid.NONSTANDARD_SET) == 70
    east = [v for v in grid.NONSTANDARD_SET if v < 4_000_000]
    assert len(east) == 38 and len(grid.NONSTANDARD_SET) - len(east) == 32


def test_nonstandard_not_standard(spark):
    vals = list(grid.NONSTANDARD_SET)
    ns = _eval(spark, vals, grid.on_northsouth)
    ew = _eval(spark, vals, grid.on_eastwest)
    assert not any(ns) and not any(ew)
    assert all(_eval(spark, vals, grid.on_nonstandard))


def test_truncating_mod(spark):
    # (5000 - 6000) % 36000 = -1000: not on the grid, and no pmod wrap-around
    assert _eval(spark, [5000], grid.on_northsouth) == [False]


def test_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (2.675,)], "v double")
    r0 = [r[0] for r in df.select(round_numeric(F.col("v"), 0)).collect()]
    r2 = [r[0] for r in df.select(round_numeric(F.col("v"), 2)).collect()]
    assert r0[:2] == [Decimal(3), Decimal(-3)]
    assert r2[2] == Decimal("2.68")
