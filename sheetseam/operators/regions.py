"""Crop-region membership (spatial inner join feature x region), for regions of any shape and number.

A feature belongs to a region when an edge of one meets an edge of the other, a path of the feature starts inside the
region, or a ring of the region starts inside the feature.  Inside is the parity of crossings over the edges of *all*
rings, so holes and several parts need no special case.

* A few small regions (checked: ``INLINE_REGIONS``, ``INLINE_EDGES``) are constants of the plan: per row, no shuffle.
* Otherwise both sides are cut into sheet-sized cells and joined on the cell.  Cells wholly inside a region decide at once; features in
  cells that a region edge touches are compared with the edges in their own cells and rows of cells only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.schemas import INTERNAL, REGIONS
from sheetseam.session import big_join, with_once

#: Regions up to this number and total of edges are written into the plan; larger sets are joined by cells.
INLINE_REGIONS, INLINE_EDGES = 64, 2000
CELL_W, CELL_H = 24000.0, 36000.0
#: The box of a feature, worked out once for all regions of the plan.
_BOX = tuple(f"{INTERNAL}{v}" for v in ("x0", "x1", "y0", "y1"))


def _orient(a, b, c) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _on_seg(a, b, p) -> Column:
    return (
        p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    )


def seg_intersects(p1, p2, q1, q2) -> Column:
    """Closed segments p1p2 and q1q2 share at least one point."""
    d1, d2 = _orient(q1, q2, p1), _orient(q1, q2, p2)
    d3, d4 = _orient(p1, p2, q1), _orient(p1, p2, q2)
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    return (
        proper
        | ((d1 == 0) & _on_seg(q1, q2, p1))
        | ((d2 == 0) & _on_seg(q1, q2, p2))
        | ((d3 == 0) & _on_seg(p1, p2, q1))
        | ((d4 == 0) & _on_seg(p1, p2, q2))
    )


def point_in_polygon(p, edges: Column) -> Column:
    """Even-odd crossing number over ring edges (boundary cases go to ``seg_intersects``)."""

    def cross(e):
        a, b = e["a"], e["b"]
        straddles = (a["y"] > p["y"]) != (b["y"] > p["y"])
        xcut = (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(straddles & (p["x"] < xcut), F.lit(1)).otherwise(F.lit(0))

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + cross(e)) % 2 == 1


def _ring_edges(v: Column) -> Column:
    n = F.size(v)
    return F.zip_with(F.slice(v, 1, n - 1), F.slice(v, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _edges(geom="geom") -> Column:
    """Edges of every path or ring (never from one ring to the next)."""
    return F.filter(G.edges(geom), lambda e: e["b"].isNotNull())


def _firsts(geom="geom") -> Column:
    """First vertex of every path or ring."""
    return F.transform(F.flatten(F.col(geom)["parts"] if isinstance(geom, str) else geom["parts"]), lambda p: F.element_at(p, 1))


def _is_area(geom="geom") -> Column:
    return F.col(geom)["gtype"].isin("POLYGON", "MULTIPOLYGON")


def small_regions(regions: DataFrame) -> list[dict] | None:
    """Name, box, edges, ring starts and rectangle flag of the regions; None if they are too many to write into a plan."""
    sized = regions.select("region", "geom", F.size(_edges()).alias("n"))
    total = sized.agg(F.count("*").alias("c"), F.sum("n").alias("e")).first()
    if total.c > INLINE_REGIONS or (total.e or 0) > INLINE_EDGES:
        return None
    out = []
    for r in sized.select("region", _edges().alias("e"), _firsts().alias("f")).orderBy("region").collect():
        edges = [((x.a.x, x.a.y), (x.b.x, x.b.y)) for x in r.e]
        if not edges:
            continue
        xs, ys = [p[0] for e in edges for p in e], [p[1] for e in edges for p in e]
        box = (min(xs), min(ys), max(xs), max(ys))
        corners = {(x, y) for x in box[::2] for y in box[1::2]}
        level = all(p[0] == q[0] or p[1] == q[1] for p, q in edges)
        out.append({
            "region": r.region, "box": box, "edges": edges, "firsts": [(p.x, p.y) for p in r.f],
            "is_rect": len(r.f) == 1 and len(edges) == 4 and level and {e[0] for e in edges} == corners and len(corners) == 4,
        })
    return out


def _points(points) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def _meets(edges: Column, firsts: Column):
    """Test of a feature (struct of edges e, path starts f, is it an area) against a region's edges and ring starts."""

    def test(s: Column) -> Column:
        return (
            F.exists(s["f"], lambda p: point_in_polygon(p, edges))
            | (s["area"] & F.exists(firsts, lambda q: point_in_polygon(q, s["e"])))
            | F.exists(s["e"], lambda e1: F.exists(edges, lambda e2: seg_intersects(e1["a"], e1["b"], e2["a"], e2["b"])))
        )

    return test


def _inline(regs: list[dict], geom: str) -> Column:
    """Sorted names of the regions that the feature (with its box in ``_BOX``) meets: constants and CASE; the exact test (lambdas) runs
    only for features that straddle a region's box, or where the region is no rectangle."""
    x0, x1, y0, y1 = (F.col(c) for c in _BOX)
    names = []
    for r in regs:
        bx0, by0, bx1, by1 = r["box"]
        apart = (x0 > bx1) | (x1 < bx0) | (y0 > by1) | (y1 < by0)
        inside = (x0 >= bx0) & (x1 <= bx1) & (y0 >= by0) & (y1 <= by1)
        theirs = F.array(*[F.struct(F.element_at(_points(e), 1).alias("a"), F.element_at(_points(e), 2).alias("b")) for e in r["edges"]])

        exact = G.let(F.struct(_edges(geom).alias("e"), _firsts(geom).alias("f"), _is_area(geom).alias("area")), _meets(theirs, _points(r["firsts"])))
        found = F.when(apart, F.lit(False))
        if r["is_rect"]:
            found = found.when(inside, F.lit(True))
        names.append(F.when(found.otherwise(exact), F.lit(r["region"])))
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _cells(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """All (cx, cy) of a box."""
    across, up = F.sequence(_cell(x0, CELL_W), _cell(x1, CELL_W)), F.sequence(_cell(y0, CELL_H), _cell(y1, CELL_H))
    return F.flatten(F.transform(across, lambda i: F.transform(up, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def _edge_rows(df: DataFrame, *keep: str) -> DataFrame:
    e = df.select(*keep, F.explode(_edges()).alias("e"))
    return e.select(*keep, F.col("e.a").alias("a"), F.col("e.b").alias("b"))


def _edge_cells(edges: DataFrame, *keep: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    box = _cells(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    return edges.select(*keep, "a", "b", F.explode(box).alias("c")).select(*keep, "a", "b", "c.cx", "c.cy")


def _odd(points: DataFrame, edges: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """``by`` of the points with an odd number of edges of their row of cells to the right of them."""
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    right = ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"])
    hits = big_join(points, edges, on).filter(right)
    return hits.groupBy(*by).count().filter("count % 2 = 1").select(*by)


def _rows_of(edges: DataFrame, *keep: str) -> DataFrame:
    """Edges in every row of cells that they span."""
    a, b = F.col("a"), F.col("b")
    rows = F.sequence(_cell(F.least(a["y"], b["y"]), CELL_H), _cell(F.greatest(a["y"], b["y"]), CELL_H))
    return edges.select(*keep, "a", "b", F.explode(rows).alias("cy"))


def _by_cells(features: DataFrame, regions: DataFrame) -> DataFrame:
    """``(id, region)`` pairs that meet; ``features``: (id, geom)."""
    border = _edge_rows(regions, "region")
    border_cells = _edge_cells(border, "region")
    border_rows = _rows_of(border, "region")
    touched = border_cells.select("region", "cx", "cy").distinct()
    # cells of a region's box without an edge are inside or outside as a whole: their middle decides
    boxes = regions.select("region", F.explode(_cells(G.xmin(), G.xmax(), G.ymin(), G.ymax())).alias("c")).select("region", "c.cx", "c.cy").distinct()
    quiet = big_join(boxes, touched, ["region", "cx", "cy"], "left_anti")
    middles = quiet.select("region", "cx", "cy", F.struct(((F.col("cx") + 0.5) * CELL_W).alias("x"), ((F.col("cy") + 0.5) * CELL_H).alias("y")).alias("p"))
    full = _odd(middles, border_rows, ["region", "cy"], ["region", "cx", "cy"])
    cells = touched.withColumn("full", F.lit(0)).unionByName(full.withColumn("full", F.lit(1)))
    own = features.select("id", _cells(G.xmin(), G.xmax(), G.ymin(), G.ymax()).alias("cs"))
    own = own.select("id", F.size("cs").alias("n"), F.explode("cs").alias("c")).select("id", "n", "c.cx", "c.cy")
    near = big_join(own, cells, ["cx", "cy"]).groupBy("id", "region").agg(F.first("n").alias("n"), F.sum("full").alias("full"))
    whole = near.filter("full = n").select("id", "region")
    open_ = near.filter("full < n").select("id", "region")
    shapes = big_join(open_, features, "id")
    # edges that meet
    mine = _edge_cells(_edge_rows(shapes, "id", "region"), "id", "region")
    theirs = border_cells.select("region", "cx", "cy", F.col("a").alias("ra"), F.col("b").alias("rb"))
    crossing = big_join(mine, theirs, ["region", "cx", "cy"]).filter(seg_intersects(F.col("a"), F.col("b"), F.col("ra"), F.col("rb"))).select("id", "region")
    # a path of the feature starts inside the region
    starts = shapes.select("id", "region", F.posexplode(_firsts()).alias("k", "p")).withColumn("cy", _cell(F.col("p.y"), CELL_H))
    inside = _odd(starts, border_rows, ["region", "cy"], ["id", "region", "k"]).select("id", "region")
    # a ring of the region starts inside the feature
    seeds = regions.select("region", F.explode(_firsts()).alias("p")).withColumns({"cx": _cell(F.col("p.x"), CELL_W), "cy": _cell(F.col("p.y"), CELL_H)})
    areas = big_join(big_join(own.select("id", "cx", "cy"), seeds, ["cx", "cy"]), open_, ["id", "region"])
    areas = big_join(areas, features.filter(_is_area()), "id")
    holding = areas.filter(point_in_polygon(F.col("p"), _edges())).select("id", "region")
    return whole.unionByName(crossing).unionByName(inside).unionByName(holding).distinct()


def with_regions(layer: DataFrame, regions: DataFrame | None, geom: str = "geom", key: str | None = None, keep_outside: bool = False) -> DataFrame:
    """Attach the sorted names of the regions that each feature meets (``None``: one region for all) and drop
    features outside all regions (or keep them with no name).  ``key`` is needed where the regions are too many to write into the plan."""
    if regions is None:
        return layer.withColumn(REGIONS, F.array(F.lit("all")))
    small = small_regions(regions)
    return _with_names(layer, regions, small, geom, key, keep_outside)


def _with_names(layer: DataFrame, regions: DataFrame, small: list[dict] | None, geom: str, key: str | None, keep_outside: bool = False) -> DataFrame:
    if small is not None:
        boxed = with_once(layer, dict(zip(_BOX, (G.xmin(geom), G.xmax(geom), G.ymin(geom), G.ymax(geom)), strict=True)))
        named = with_once(boxed, {REGIONS: _inline(small, geom)}).drop(*_BOX)
        return named if keep_outside else named.filter(F.size(REGIONS) > 0)
    pairs = _by_cells(layer.select(F.col(key).alias("id"), F.col(geom).alias("geom")), regions)
    found = pairs.groupBy("id").agg(F.sort_array(F.collect_set("region")).alias(REGIONS)).withColumnRenamed("id", key)
    both = big_join(layer, found, key, "left" if keep_outside else "inner")
    return both.select(*layer.columns, F.coalesce(REGIONS, F.array().cast("array<string>")).alias(REGIONS) if keep_outside else REGIONS)


def region_join(layer: DataFrame, regions: DataFrame, key: str, geom: str = "geom", extra=()) -> DataFrame:
    """Long form ``(extra..., key, region)``; features outside every region produce no row.  ``extra`` and key together name a feature."""
    small = small_regions(regions)  # looked at once
    if small is not None:
        return _with_names(layer, regions, small, geom, None).select(*extra, key, F.explode(REGIONS).alias("region"))
    named = layer.withColumn("__seam_id", F.struct(*extra, key))
    return _with_names(named, regions, None, geom, "__seam_id").select(*extra, key, F.explode(REGIONS).alias("region"))
