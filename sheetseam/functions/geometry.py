"""Geometry as Column expressions over the nested ``geom`` struct.

Everything here compiles to Catalyst higher-order functions (``transform``,
``filter``, ``aggregate``, ``zip_with``) and so stays inside whole-stage
codegen; nothing calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetseam.schemas import GEOM_DDL

# Snap grid used by the reference both to find and to merge candidates.
SNAP_GRID = 1e-11


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def rectangle(wv, sv, ev, nv) -> Column:
    """Axis-aligned POLYGON, shell counter-clockwise from the south-west corner."""
    ring = F.array(point(wv, sv), point(ev, sv), point(ev, nv), point(wv, nv), point(wv, sv))
    return F.struct(F.lit("POLYGON").alias("gtype"), F.array(F.array(ring)).alias("parts"))


def linestring(*points: Column) -> Column:
    return F.struct(F.lit("LINESTRING").alias("gtype"), F.array(F.array(F.array(*points))).alias("parts"))


def vertices(geom="geom") -> Column:
    """All vertices of a geometry as one array (closing vertices included)."""
    return F.flatten(F.flatten(_c(geom)["parts"]))


def xs(geom="geom") -> Column:
    """All x ordinates (struct-field extraction over the array: no lambda, code-generated)."""
    return vertices(geom)["x"]


def ys(geom="geom") -> Column:
    return vertices(geom)["y"]


def xmin(geom="geom") -> Column:
    return F.array_min(xs(geom))


def xmax(geom="geom") -> Column:
    return F.array_max(xs(geom))


def ymin(geom="geom") -> Column:
    return F.array_min(ys(geom))


def ymax(geom="geom") -> Column:
    return F.array_max(ys(geom))


def snap_value(v: Column, grid: float = SNAP_GRID) -> Column:
    """One ordinate snapped like ``st_snaptogrid``; monotone, so the bbox of a snapped
    geometry is the snapped bbox."""
    g = F.lit(grid)
    return F.rint(v / g) * g


def round_numeric(value: Column, digits: int) -> Column:
    """Round like PostgreSQL ``round(v::numeric, d)``: decimal, half away from zero.

    PostgreSQL turns a float8 into numeric with 15 significant digits (8 decimals for the
    7-digit eastings/northings of projected metres); ``decimal(18,8)`` does the same and stays
    long-backed, so the arithmetic is code-generated instead of ``BigDecimal`` (|v| < 1e10).
    """
    return F.round(value.cast("decimal(18,8)"), digits)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Referring to an outer array expression inside a lambda re-evaluates it for every element;
    binding it first keeps such expressions linear."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dedupe_path(path: Column) -> Column:
    # drop a vertex equal to its predecessor
    return let(path, lambda s: F.filter(s, lambda p, i: (i == 0) | (p != F.element_at(s, i))))


def snap(geom="geom", grid: float = SNAP_GRID) -> Column:
    """``st_snaptogrid(g, grid)``: ``rint(v / grid) * grid`` on each ordinate,
    consecutive duplicates removed, collapsed paths/rings dropped."""
    g = F.lit(grid)
    gcol = _c(geom)
    is_poly = gcol["gtype"].isin("POLYGON", "MULTIPOLYGON")
    min_len = F.when(is_poly, F.lit(4)).otherwise(F.lit(2))

    def snap_path(path):
        snapped = F.transform(path, lambda p: F.struct((F.rint(p["x"] / g) * g).alias("x"), (F.rint(p["y"] / g) * g).alias("y")))
        return _dedupe_path(snapped)

    parts = F.transform(gcol["parts"], lambda part: F.filter(F.transform(part, snap_path), lambda r: F.size(r) >= min_len))
    parts = F.filter(parts, lambda part: F.size(part) > 0)
    return F.when(gcol.isNull(), F.lit(None).cast(GEOM_DDL)).otherwise(
        F.struct(gcol["gtype"].alias("gtype"), parts.alias("parts"))
    )


def _ring_signed_area2(ring: Column) -> Column:
    n = F.size(ring)
    return F.aggregate(
        F.sequence(F.lit(1), n - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"]
        - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"],
    )


def area(geom="geom") -> Column:
    """Planar area: |shell| minus |holes| per part, summed over parts (0 for lines)."""
    gcol = _c(geom)

    def part_area(part):
        shell = F.abs(_ring_signed_area2(F.element_at(part, 1)))
        holes = F.aggregate(F.slice(part, 2, F.size(part)), F.lit(0.0), lambda acc, r: acc + F.abs(_ring_signed_area2(r)))
        return (shell - holes) / 2.0

    total = F.aggregate(F.transform(gcol["parts"], part_area), F.lit(0.0), lambda acc, a: acc + a)
    return F.when(gcol["gtype"].isin("POLYGON", "MULTIPOLYGON"), total).otherwise(F.lit(0.0))


def path_length(path: Column) -> Column:
    n = F.size(path)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc
        + F.when(
            i < n,
            F.hypot(
                F.element_at(path, i + 1)["x"] - F.element_at(path, i)["x"],
                F.element_at(path, i + 1)["y"] - F.element_at(path, i)["y"],
            ),
        ).otherwise(F.lit(0.0)),
    )


def length(geom="geom") -> Column:
    """Total length of all paths/rings."""
    paths = F.flatten(_c(geom)["parts"])
    return F.aggregate(F.transform(paths, path_length), F.lit(0.0), lambda acc, v: acc + v)


def num_points(geom="geom") -> Column:
    return F.size(vertices(geom))


def num_distinct_points(geom="geom") -> Column:
    return F.size(F.array_distinct(vertices(geom)))


def num_parts(geom="geom") -> Column:
    return F.size(_c(geom)["parts"])


def _fmt(v: Column) -> Column:
    # shortest round-trip text of a double, without a trailing ".0"
    s = v.cast("string")
    return F.regexp_replace(s, r"\.0$", "")


def to_wkt(geom="geom") -> Column:
    """WKT text (export edge only)."""
    gcol = _c(geom)

    def path_txt(path):
        return F.concat(F.lit("("), F.array_join(F.transform(path, lambda p: F.concat_ws(" ", _fmt(p["x"]), _fmt(p["y"]))), ","), F.lit(")"))

    def part_txt(part):
        return F.concat(F.lit("("), F.array_join(F.transform(part, path_txt), ","), F.lit(")"))

    t = gcol["gtype"]
    body = (
        F.when(t == "POINT", path_txt(F.element_at(F.element_at(gcol["parts"], 1), 1)))
        .when(t == "LINESTRING", path_txt(F.element_at(F.element_at(gcol["parts"], 1), 1)))
        .when(t == "POLYGON", part_txt(F.element_at(gcol["parts"], 1)))
        .when(t == "MULTILINESTRING", F.concat(F.lit("("), F.array_join(F.transform(gcol["parts"], lambda p: path_txt(F.element_at(p, 1))), ","), F.lit(")")))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(gcol["parts"], part_txt), ","), F.lit(")")))
    )
    return F.when(gcol.isNull(), F.lit(None)).otherwise(F.concat(t, body))


def from_wkt(wkt) -> Column:
    """``ST_GeomFromText``: WKT (optionally with an ``SRID=n;`` prefix) to the geometry struct.

    Coordinates become JSON arrays with ``regexp_replace`` and are parsed with
    ``from_json``; no Python runs per row.
    """
    w = F.upper(F.trim(F.regexp_replace(_c(wkt), r"^\s*SRID=\d+;", "")))
    head = r"^([A-Z]+?)\s*(?:ZM|Z|M)?\s*(?=\(|EMPTY|$)"  # heights and measures are dropped
    gtype = F.regexp_extract(w, head, 1)
    body = F.regexp_replace(w, head, "")
    num = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:E[-+]?[0-9]+)?)"
    js = F.regexp_replace(body, num + r"\s+" + num + r"(?:\s+" + num + r"){0,2}", "[$1,$2]")
    js = F.regexp_replace(F.regexp_replace(js, r"(?<![0-9])\.", "0."), r"\.(?![0-9])", ".0")
    js = F.translate(F.regexp_replace(js, r"\s+", ""), "()", "[]")
    js = F.regexp_replace(js, r"\[\+", "[")
    js = F.regexp_replace(js, r",\+", ",")

    def to_pts(path):
        return F.transform(path, lambda c: F.struct(F.element_at(c, 1).alias("x"), F.element_at(c, 2).alias("y")))

    d2 = F.from_json(js, "array<array<double>>")
    d3 = F.from_json(js, "array<array<array<double>>>")
    d4 = F.from_json(js, "array<array<array<array<double>>>>")
    parts = (
        F.when(gtype.isin("POINT", "LINESTRING"), F.array(F.array(to_pts(d2))))
        .when(gtype == "POLYGON", F.array(F.transform(d3, to_pts)))
        .when(gtype == "MULTILINESTRING", F.transform(d3, lambda p: F.array(to_pts(p))))
        .when(gtype == "MULTIPOLYGON", F.transform(d4, lambda part: F.transform(part, to_pts)))
    )
    made = F.struct(gtype.alias("gtype"), parts.alias("parts"))
    whole = let(made, lambda g: F.when(~F.exists(vertices(g), lambda p: p["x"].isNull() | p["y"].isNull()), g))
    return F.when(body.contains("EMPTY") | parts.isNull(), F.lit(None).cast(GEOM_DDL)).otherwise(whole)


def wkt_reject(wkt, geom) -> Column:
    """Why a text gave no geometry (null if it did): ``no text``, ``empty``, ``type <name>`` for types that are not read, or ``broken``."""
    w = F.upper(F.trim(F.regexp_replace(_c(wkt), r"^\s*SRID=\d+;", "")))
    gtype = F.regexp_extract(w, r"^([A-Z]+?)\s*(?:ZM|Z|M)?\s*(?=\(|EMPTY)", 1)
    known = gtype.isin("POINT", "LINESTRING", "POLYGON", "MULTILINESTRING", "MULTIPOLYGON")
    return (
        F.when(_c(geom).isNotNull(), F.lit(None).cast("string"))
        .when(F.coalesce(F.trim(_c(wkt)), F.lit("")) == "", "no text")
        .when(w.rlike(r"\bEMPTY\s*$"), "empty")
        .when((gtype != "") & ~known, F.concat(F.lit("type "), gtype))
        .otherwise("broken")
    )


def path_endpoints(geom="geom") -> Column:
    """Boundary points by the mod-2 rule: path ends occurring an odd number of times."""
    paths = F.flatten(_c(geom)["parts"])
    ends = F.flatten(F.transform(paths, lambda p: F.array(F.element_at(p, 1), F.element_at(p, -1))))
    return let(
        ends,
        lambda es: F.filter(F.array_distinct(es), lambda e: F.size(F.filter(es, lambda o: o == e)) % 2 == 1),
    )


def geometry_hash(geom="geom") -> Column:
    """Stable content hash used to detect changed geometry."""
    return F.xxhash64(F.to_json(_c(geom)))


def edges(geom="geom") -> Column:
    """Array of segments ``struct<a: point, b: point>`` over every path/ring."""
    paths = F.flatten(_c(geom)["parts"])
    return F.flatten(
        F.transform(
            paths,
            lambda p: F.zip_with(
                F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(1))),
                F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))),
                lambda a, b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
