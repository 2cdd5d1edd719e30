"""DE-9IM of the candidate pairs that the fast path cannot decide, as aggregations over joined edges.

These are pairs whose faces are equal only after rounding (a small gap, a small overlap, a sloped shared edge), and line pairs with a segment on
the sheet line.

* Polygons (``FF2F11212``): the edges of both are cut where they meet and counted on both sides (:mod:`sheetseam.operators.dissolve`).  The pair
  holds if a piece is boundary of both with the interiors on different sides, no side of any piece lies in both, and either keeps boundary of its own.
* Lines (``FF1F00102``): every edge of one meets the edges of the other in its cells.  The pair holds if all contacts are end points of both, there is
  one, and either keeps an end point of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.operators import dissolve
from sheetseam.session import big_join, materialize

#: Metres: contacts closer than this to a point are at that point.
EPS = 1e-6
#: Metres: size of the cells in which the edges of two lines meet.
CELL = 6000.0
#: Edges of the first polygon count one, those of the second this much: sums keep both counts apart.
SECOND = 1 << 20


def _both(pairs: DataFrame, feats: DataFrame, key: str) -> DataFrame:
    """``comp, merge_id, drop_id, second, geom``: both features of every numbered pair."""
    numbered = materialize(pairs.withColumn("comp", F.monotonically_increasing_id()), "slow-pairs")
    sides = numbered.select("comp", "merge_id", "drop_id", F.explode(F.array(F.struct(F.col("merge_id").alias("k"), F.lit(False).alias("second")), F.struct(F.col("drop_id").alias("k"), F.lit(True).alias("second")))).alias("s"))
    shapes = feats.select(F.col(key).alias("k"), F.col("stg").alias("geom"))
    return materialize(big_join(sides.select("comp", "merge_id", "drop_id", "s.k", "s.second"), shapes, "k").drop("k"), "slow-shapes")


def polygons_share_edge(sides: DataFrame) -> DataFrame:
    """``comp`` of the pairs whose polygons touch along a line (``FF2F11212``)."""
    edges = dissolve.ring_edges(sides.select("comp", "second", "geom"), "second")
    net = F.when(F.col("second"), F.lit(SECOND)).otherwise(F.lit(1)).cast("long")
    pieces = dissolve.covered(dissolve.noded(dissolve.added(edges, net)))

    def parts(c: Column) -> tuple[Column, Column]:
        b = F.floor((c + SECOND // 2) / SECOND)
        return c - b * SECOND, b

    a, b = parts(F.col("net"))
    la, lb = parts(F.col("left"))
    ra, rb = la - a, lb - b
    facts = pieces.groupBy("comp").agg(
        F.max((a * b < 0)).alias("shared"), F.max((a * b > 0) | ((la > 0) & (lb > 0)) | ((ra > 0) & (rb > 0))).alias("inside"),
        F.max((a != 0) & (b == 0)).alias("own_a"), F.max((b != 0) & (a == 0)).alias("own_b"),
    )
    return facts.where("shared AND NOT inside AND own_a AND own_b").select("comp")


def _segments(sides: DataFrame) -> DataFrame:
    """``comp, second, ax, ay, bx, by`` of every segment."""
    each = sides.select("comp", "second", F.explode(G.edges("geom")).alias("e")).where("e.b IS NOT NULL AND e.a != e.b")
    return each.select("comp", "second", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _celled(segments: DataFrame, second: bool) -> DataFrame:
    cell = lambda f, a, b, d: F.floor((f(a, b) + d) / CELL).cast("long")
    own = segments.where(F.col("second") == F.lit(second)).drop("second")
    own = own.withColumn("cx", F.explode(F.sequence(cell(F.least, "ax", "bx", -EPS), cell(F.greatest, "ax", "bx", EPS))))
    return own.withColumn("cy", F.explode(F.sequence(cell(F.least, "ay", "by", -EPS), cell(F.greatest, "ay", "by", EPS))))


def _contacts(sides: DataFrame) -> DataFrame:
    """``comp, x, y``: where segments of the two lines meet (``x`` null: along a stretch, or crossing between ends)."""
    segments = _segments(sides)
    a, b = (_celled(segments, s).alias(n) for s, n in ((False, "i"), (True, "j")))
    both = big_join(a, b, [F.col(f"i.{c}") == F.col(f"j.{c}") for c in ("comp", "cx", "cy")])
    both = both.select(F.col("i.comp").alias("comp"), *(F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ij" for c in ("ax", "ay", "bx", "by")))
    for s in "ij":
        both = both.withColumn(f"{s}dx", F.col(f"{s}bx") - F.col(f"{s}ax")).withColumn(f"{s}dy", F.col(f"{s}by") - F.col(f"{s}ay"))
        both = both.withColumn(f"{s}len", F.hypot(f"{s}dx", f"{s}dy"))
    cross = lambda ux, uy, vx, vy: ux * vy - uy * vx
    xs, ys = [], []
    for s, o in (("i", "j"), ("j", "i")):
        for e in "ab":
            x, y = F.col(f"{o}{e}x"), F.col(f"{o}{e}y")
            wx, wy = x - F.col(f"{s}ax"), y - F.col(f"{s}ay")
            along = (wx * F.col(f"{s}dx") + wy * F.col(f"{s}dy")) / F.col(f"{s}len")
            off = F.abs(cross(wx, wy, F.col(f"{s}dx"), F.col(f"{s}dy"))) / F.col(f"{s}len")
            on = (off <= EPS) & (along >= -EPS) & (F.col(f"{s}len") - along >= -EPS)
            both = both.withColumn(f"{s}{e}on", on)
            xs.append(F.when(F.col(f"{s}{e}on"), x))
            ys.append(F.when(F.col(f"{s}{e}on"), y))
    turn = cross(F.col("idx"), F.col("idy"), F.col("jdx"), F.col("jdy"))
    wx, wy = F.col("jax") - F.col("iax"), F.col("jay") - F.col("iay")
    t, u = (F.try_divide(cross(wx, wy, F.col(f"{o}dx"), F.col(f"{o}dy")), turn) for o in "ji")
    both = both.withColumn("crossing", (F.abs(turn) > 1e-12 * F.col("ilen") * F.col("jlen")) & t.between(0, 1) & u.between(0, 1))
    # two contacts of one pair of segments that lie apart: a stretch
    both = both.select("comp", "crossing", F.coalesce(*xs).alias("x"), F.coalesce(*ys).alias("y"), (F.greatest(*xs) - F.least(*xs)).alias("wide"), (F.greatest(*ys) - F.least(*ys)).alias("high"))
    bad = F.when(F.col("x").isNull(), F.col("crossing")).otherwise((F.col("wide") > EPS) | (F.col("high") > EPS))
    rows = both.withColumn("bad", bad).where("bad OR x IS NOT NULL")
    return rows.select("comp", *(F.when(~F.col("bad"), F.col(c)).alias(c) for c in "xy"))


def lines_touch_at_ends(sides: DataFrame) -> DataFrame:
    """``comp`` of the pairs whose lines meet only in end points of both and keep an end point each (``FF1F00102``)."""
    ends = sides.groupBy("comp").agg(*(F.max(F.when(F.col("second") == F.lit(s), G.path_endpoints("geom"))).alias(n) for s, n in ((False, "ends_a"), (True, "ends_b"))))
    met = big_join(materialize(_contacts(sides), "contacts"), ends, "comp")
    for n in "ab":  # the place of the contact among the end points (0: it is none)
        near = F.transform(f"ends_{n}", lambda p: (F.abs(p["x"] - F.col("x")) <= EPS) & (F.abs(p["y"] - F.col("y")) <= EPS))
        met = met.withColumn(f"at_{n}", F.coalesce(F.array_position(near, F.lit(True)), F.lit(0)))
    used = [F.size(F.collect_set(f"at_{n}")).alias(f"used_{n}") for n in "ab"]  # of few end points
    facts = met.groupBy("comp").agg(F.min((F.col("at_a") > 0) & (F.col("at_b") > 0)).alias("at_ends"), *used, *(F.max(F.size(f"ends_{n}")).alias(f"n_{n}") for n in "ab"))
    return materialize(facts.where("at_ends AND used_a < n_a AND used_b < n_b").select("comp"), "touching")


def check_slow_pairs(pairs: DataFrame, feats: DataFrame, key: str, is_poly: bool) -> DataFrame:
    """Those of ``pairs`` (merge_id, drop_id) that hold, by the matching geometry ``stg`` of ``feats``."""
    sides = _both(pairs, feats, key)
    held = polygons_share_edge(sides) if is_poly else lines_touch_at_ends(sides)
    return big_join(sides.where("NOT second").select("comp", "merge_id", "drop_id"), held, "comp").select("merge_id", "drop_id")
