"""Layers derived from the driver's tables (plain integer arithmetic, no geometry on disk).

``poly`` (from ``orders``): one full-sheet rectangle per row.
``line`` (from ``events``): one vertical mid-sheet line per row, plus a fork
for every 7th key that ends at the same upper point (three-way junctions); event k gives
the keys 2k (line) and 2k + 1 (fork).
``slot`` keeps overlapping generations of the 39 x 41 sheet grid apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.schemas import REGION_SCHEMA

# Fixed values of the derived layers.
ROWS, COLS = 39, 41
SHEET_W, SHEET_H = 24000, 36000
X0, Y0 = 1108000, 4758000
LINE_X0 = 1120000
FORK_EVERY, FORK_DX = 7, 1000
REGION_SPLIT_Y = 5460000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _grid_cols(k):
    r = k % ROWS
    sc = F.floor(k / ROWS) % COLS
    slot = F.floor(k / (ROWS * COLS))
    return r.cast("long"), sc.cast("long"), slot.cast("long")


def poly_layer(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    r, sc, slot = _grid_cols(k)
    wv = F.lit(X0) + F.lit(SHEET_W) * sc
    sv = F.lit(Y0) + F.lit(SHEET_H) * r
    return orders.select(
        k.alias("ogc_fid"),
        k.alias("ufid"),
        slot.alias("slot"),
        F.col("o_orderpriority").alias("cls"),
        G.rectangle(wv, sv, wv + SHEET_W, sv + SHEET_H).alias("geom"),
    )


def line_layer(events: DataFrame) -> DataFrame:
    k = F.col("event_id").cast("long")
    r, sc, slot = _grid_cols(k)
    x = F.lit(LINE_X0) + F.lit(SHEET_W) * sc
    y = F.lit(Y0) + F.lit(SHEET_H) * r
    base = events.select(k.alias("k"), x.alias("x"), y.alias("y"), slot.alias("slot"), F.col("event_type").alias("cls"))
    main = base.select(
        (2 * F.col("k")).alias("ogc_fid"),
        (2 * F.col("k")).alias("ufid"),
        "slot",
        "cls",
        G.linestring(G.point("x", "y"), G.point("x", F.col("y") + SHEET_H)).alias("geom"),
    )
    fork = base.filter(F.col("k") % FORK_EVERY == 0).select(
        (2 * F.col("k") + 1).alias("ogc_fid"),
        (2 * F.col("k") + 1).alias("ufid"),
        "slot",
        "cls",
        G.linestring(G.point(F.col("x") + FORK_DX, "y"), G.point("x", F.col("y") + SHEET_H)).alias("geom"),
    )
    return main.unionByName(fork)


def regions(spark: SparkSession, x_range=(1_100_000, 2_100_000), y_range=(4_700_000, 6_200_000)) -> DataFrame:
    """Two crop regions split at a northing off the sheet grid."""
    x0, x1 = x_range
    y0, y1 = y_range
    rows = [("south", (x0, y0, x1, REGION_SPLIT_Y)), ("north", (x0, REGION_SPLIT_Y, x1, y1))]

    def rect(b):
        w, s, e, n = (float(v) for v in b)
        ring = [(w, s), (e, s), (e, n), (w, n), (w, s)]
        return ("POLYGON", [[[{"x": px, "y": py} for px, py in ring]]])

    return spark.createDataFrame([(name, rect(b)) for name, b in rows], REGION_SCHEMA)


def shaped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle, a region with a hole, one of two parts, and three narrow strips for every nation."""
    x, y = X0, Y0

    def box(w, s, e, n):
        return [(w, s), (e, s), (e, n), (w, n), (w, s)]

    shapes = [
        ("triangle", [[[(x, y), (x + 600_000, y), (x, y + 600_000), (x, y)]]]),
        ("holed", [[box(x, y, x + 900_000, y + 900_000), box(x + 100_000, y + 100_000, x + 700_000, y + 700_000)]]),
        ("parts", [[box(x, y, x + 90_000, y + 90_000)], [box(x + 500_000, y + 500_000, x + 910_000, y + 610_000)]]),
    ]
    rows = [
        (name, ("POLYGON" if len(parts) == 1 else "MULTIPOLYGON", [[[{"x": float(a), "y": float(b)} for a, b in ring] for ring in part] for part in parts]))
        for name, parts in shapes
    ]
    fixed = spark.createDataFrame(rows, REGION_SCHEMA)
    strips = read_table(spark, sf_dir, "nation").select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"), "n_nationkey")
    k = 3 * F.col("n_nationkey") + F.col("j")
    w = F.lit(X0) + 13_000 * k
    return fixed.unionByName(strips.select(F.concat(F.lit("strip"), k.cast("string")).alias("region"), G.rectangle(w, F.lit(Y0 - 1000), w + 5000, F.lit(Y0 + 2_000_000)).alias("geom")))


def overlapping_members(orders: DataFrame) -> DataFrame:
    """``(comp, geom)``: a small rectangle per order, many of them overlapping or equal within a customer."""
    k = F.col("o_orderkey").cast("long")
    w, s = (k % 7) * 1000, (F.floor(k / 7) % 5) * 1000
    return orders.select(
        F.col("o_custkey").cast("long").alias("comp"), G.rectangle(w, s, w + (k % 3 + 1) * 2000, s + (F.floor(k / 3) % 4 + 1) * 1500).alias("geom")
    )


def _multi(*paths) -> Column:
    return F.struct(F.lit("MULTILINESTRING").alias("gtype"), F.array(*(F.array(F.array(*p)) for p in paths)).alias("parts"))


def _corner(x: int, y: int) -> Column:
    """A point of the key's own square, whose unit depends on the key."""
    k = F.col("o_orderkey").cast("long")
    unit = 10 * (k % 7 + 1)
    return G.point(F.lit(X0) + x * unit, F.lit(Y0) + 100 * (k % 1000) + y * unit)


def looped_lines(orders: DataFrame) -> DataFrame:
    """``ufid, geom``: multi-lines with and without loops, by the key's remainder: two pieces; with a closed path; with a loop of three paths; only a loop
    of two paths; a loop of two paths with a closed path on it, at the end of a piece; a fork."""
    a, b, c, p, q, r = _corner(0, 0), _corner(1, 0), _corner(2, 0), _corner(1, 3), _corner(4, 3), _corner(6, 5)
    kinds = [
        _multi((a, b), (c, b)),
        _multi((a, b), (b, p, q, b), (b, c)),
        _multi((a, b), (b, p), (q, p), (q, b), (b, c)),
        _multi((p, q), (p, b, q)),
        _multi((a, b), (b, p), (p, q, r, p), (p, c, b)),
        _multi((a, b), (b, c), (p, b)),
    ]
    return _by_remainder(orders, kinds)


def triple_point_lines(orders: DataFrame) -> DataFrame:
    """``ufid, geom``: multi-lines that meet at a point three times (inside a path and at two ends; at three ends), twice, and four times."""
    t, a, b, c, d = _corner(2, 2), _corner(0, 0), _corner(4, 4), _corner(0, 4), _corner(4, 0)
    kinds = [_multi((a, t, b), (c, t), (t, d)), _multi((a, t), (t, b), (t, c)), _multi((a, t), (t, b)), _multi((a, t), (b, t), (c, t), (d, t))]
    return _by_remainder(orders, kinds)


def _by_remainder(orders: DataFrame, kinds: list[Column]) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    return orders.select(k.alias("ufid"), F.element_at(F.array(*kinds), (k % len(kinds) + 1).cast("int")).alias("geom"))


def raw_wkt(orders: DataFrame) -> DataFrame:
    """``ufid, wkt``: texts as they come, by the key's remainder: a polygon, a letter among the numbers, an empty one, a multi-point, a collection, none,
    a missing bracket."""
    k = F.col("o_orderkey").cast("long")
    w, s = (k % 1000) * 10, (k % 77) * 10
    at = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    ring = F.concat_ws(", ", at(w, s), at(w + 10, s), at(w + 10, s + 5), at(w, s + 5), at(w, s))
    kinds = [
        F.concat(F.lit("SRID=2193;POLYGON (("), ring, F.lit("))")), F.concat(F.lit("LINESTRING("), at(w, s), F.lit(", 1 x)")), F.lit("POLYGON EMPTY"),
        F.concat(F.lit("MULTIPOINT(("), at(w, s), F.lit("))")), F.concat(F.lit("GEOMETRYCOLLECTION(POINT("), at(w, s), F.lit("))")), F.lit(None).cast("string"),
        F.concat(F.lit("POLYGON(("), ring, F.lit(")")),
    ]
    return orders.select(k.alias("ufid"), F.element_at(F.array(*kinds), (k % len(kinds) + 1).cast("int")).alias("wkt"))


def joint_lines(suppliers: DataFrame) -> DataFrame:
    """Four lines per supplier: two that meet on a north/south sheet edge, and two more that meet their end on an east/west edge, so that the first pass
    merges two and the second rejects all."""
    k = F.col("s_suppkey").cast("long")
    col, row, slot = k % 39 + 1, F.floor(k / 39) % 38, F.floor(k / (39 * 38))
    x = F.lit(X0) + SHEET_W * col  # an east/west edge
    y = F.lit(Y0) + SHEET_H * row  # a north/south edge
    mid, end = G.point(x - 9100, y), G.point(x, y + 9100)
    shapes = [(G.point(x - 9100, y - 9100), mid), (mid, end), (end, G.point(x + 9100, y + 9100)), (end, G.point(x + 9100, y + 12300))]
    each = F.array(*(F.struct(F.lit(i).alias("i"), G.linestring(*p).alias("geom")) for i, p in enumerate(shapes)))
    rows = suppliers.select(k.alias("k"), slot.cast("long").alias("slot"), F.lit("joint").alias("cls"), F.explode(each).alias("s"))
    ufid = 4 * F.col("k") + F.col("s.i")
    return rows.select(ufid.alias("ogc_fid"), ufid.alias("ufid"), "slot", "cls", F.col("s.geom").alias("geom"))


def _pairs_of(rows: DataFrame, kinds: list[tuple[Column, Column]]) -> DataFrame:
    """Two features, ``2 k`` and ``2 k + 1``, per row ``k, slot``, by the key's remainder."""
    two = F.element_at(F.array(*(F.array(*(F.struct(F.lit(i).alias("i"), g.alias("geom")) for i, g in enumerate(p))) for p in kinds)), (F.col("k") % len(kinds) + 1).cast("int"))
    ufid = 2 * F.col("k") + F.col("s.i")
    return rows.select("k", "slot", F.explode(two).alias("s")).select(ufid.alias("ogc_fid"), ufid.alias("ufid"), "slot", F.lit("near").alias("cls"), F.col("s.geom").alias("geom"))


def _sheet_corner(customers: DataFrame) -> tuple[DataFrame, Column, Column]:
    k = F.col("c_custkey").cast("long")
    rows = customers.select(k.alias("k"), F.floor(k / (39 * 37)).cast("long").alias("slot"), (F.lit(X0) + SHEET_W * (k % 39)).cast("double").alias("x"), (F.lit(Y0) + SHEET_H * (1 + F.floor(k / 39) % 37)).cast("double").alias("y"))
    return rows, F.col("x"), F.col("y")


def near_polygons(customers: DataFrame) -> DataFrame:
    """Pairs of polygons whose faces on a sheet edge are equal only after rounding: the same sloped edge, a gap, an overlap, half of a sloped edge, a corner on a
    sloped edge, crossing edges.  The first and the fourth kind share an edge."""
    rows, x, y = _sheet_corner(customers)
    w, h = 12000.0, 9000.0

    def shape(*pts):
        ring = [G.point(x + dx, y + dy) for dx, dy in (*pts, pts[0])]
        return F.struct(F.lit("POLYGON").alias("gtype"), F.array(F.array(F.array(*ring))).alias("parts"))

    below = lambda l, r: shape((0, -h), (w, -h), (w, r), (0, l))
    above = lambda l, r, e=w: shape((0, l), (e, r), (e, h), (0, h))
    kinds = [
        (below(-0.2, 0.2), above(-0.2, 0.2)), (below(0.0, 0.0), above(0.3, 0.3)), (below(0.0, 0.0), above(-0.3, -0.3)),
        (below(-0.2, 0.2), above(-0.2, 0.0, w / 2)), (below(-0.2, 0.2), shape((w / 2, 0.0), (w, h), (0, h))), (below(-0.2, 0.2), above(0.2, -0.2)),
    ]
    return _pairs_of(rows, kinds)


def near_lines(customers: DataFrame) -> DataFrame:
    """Pairs of lines that need a full look: one along the sheet edge to the other's end, a T on it, a common stretch, a gap of millimetres, both ends in common,
    both along the edge end to end.  The first and the last kind meet in ends only."""
    rows, x, y = _sheet_corner(customers)

    def path(*pts):
        return G.linestring(*(G.point(x + dx, y + dy) for dx, dy in pts))

    up = path((0, 0), (0, 913))
    kinds = [
        (path((-517, 0), (0, 0)), up), (path((-517, 0), (517, 0)), up), (path((-517, 0), (517, 0)), path((0, 0), (813, 0), (813, 913))),
        (path((0, -913), (0, -0.004)), up), (path((0, 0), (313, 0)), path((0, 0), (157, 513), (313, 0))), (path((-517, 0), (0, 0)), path((0, 0), (517, 0))),
    ]
    return _pairs_of(rows, kinds)


def load_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poly_layer(read_table(spark, sf_dir, "orders"))


def load_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_layer(read_table(spark, sf_dir, "events"))
