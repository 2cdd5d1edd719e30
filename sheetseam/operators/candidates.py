"""Candidate pairs across sheet edges: bbox values, boundary flags, face join, relate.

The reference joins every feature with every other under an OR of two face
conditions.  Here each feature is turned into *face rows* (its high face --
north or east -- and its low face -- south or west), and high faces are
equi-joined to low faces on ``(rounded value, attributes, stretch)``; a common crop region is a filter on the names of
the regions.
A face line is cut into stretches of several widths.  A face is at home in the narrowest ones that it fits into, and two faces meet in the stretches that
the longer one is at home in, so a hot ``(value, attributes)`` key is spread over many tasks and thousands of short faces beside each other meet only
their neighbours.  A pair is emitted once, in the stretch that holds the start of the overlap.

The DE-9IM tests of the reference (``FF2F11212`` for polygons, ``FF1F00102``
for lines) are decided relationally when the two faces are exactly equal
(the common case: both pieces were cut on the same sheet line): polygons
must share a boundary stretch of positive length on the line, lines must meet
only in common end points and keep a free end each.  The rare rest goes to
:mod:`sheetseam.operators.relate` (vectorised per pair, only those rows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.functions import grid
from sheetseam.schemas import INTERNAL, REGIONS
from sheetseam.session import big_join, materialize, with_once

#: Widths (metres) of the stretches that a sheet line is cut into; the widest holds a few standard sheets, so that a sheet-wide face is in one or two.
STRETCHES = (3.0, 48.0, 768.0, 12288.0, 98304.0)


@dataclass(frozen=True)
class PassSpec:
    """North/south pass (faces are horizontal lines) or east/west pass (vertical)."""

    name: str  # "ns" | "ew"

    @property
    def along(self) -> str:  # ordinate that is constant on the face
        return "y" if self.name == "ns" else "x"

    @property
    def across(self) -> str:
        return "x" if self.name == "ns" else "y"

    @property
    def high(self) -> tuple[str, str]:  # (bbox value column, flag column)
        return ("nv", "n") if self.name == "ns" else ("ev", "e")

    @property
    def low(self) -> tuple[str, str]:
        return ("sv", "s") if self.name == "ns" else ("wv", "w")

    def filter(self) -> Column:
        return grid.boundary_filter_ns() if self.name == "ns" else grid.boundary_filter_ew()


NS = PassSpec("ns")
EW = PassSpec("ew")


def with_bbox(layer: DataFrame, is_poly: bool, geom: str = "geom") -> DataFrame:
    """Add exact bbox of the matching geometry (snapped for polygons) and rounded ``nv,sv,ev,wv``.

    Snapping is monotone, so the snapped bbox is the bbox snapped: no per-vertex work here.
    """
    digits = 0 if is_poly else 2
    sv = G.snap_value if is_poly else (lambda c: c)
    df = with_once(
        layer,
        {
            "ymax_x": sv(G.ymax(geom)),
            "ymin_x": sv(G.ymin(geom)),
            "xmax_x": sv(G.xmax(geom)),
            "xmin_x": sv(G.xmin(geom)),
        },
    )
    return with_once(
        df,
        {
            "nv": G.round_numeric(F.col("ymax_x"), digits),
            "sv": G.round_numeric(F.col("ymin_x"), digits),
            "ev": G.round_numeric(F.col("xmax_x"), digits),
            "wv": G.round_numeric(F.col("xmin_x"), digits),
        },
    )


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(grid.boundary_flags())


def boundary_candidates(layer: DataFrame, is_poly: bool, spec: PassSpec, geom: str = "geom") -> DataFrame:
    """Features whose bbox edge lies on a known sheet boundary for this pass, with ``stg``
    (the matching geometry: snapped for polygons) computed for the survivors only."""
    df = with_flags(with_bbox(layer, is_poly, geom)).filter(spec.filter())
    return df.withColumn("stg", G.snap(geom) if is_poly else F.col(geom))


def _face_rows(df: DataFrame, key: str, attrs: list[str], is_poly: bool, spec: PassSpec, high: bool) -> DataFrame:
    vcol, fcol = spec.high if high else spec.low
    al, ac = spec.along, spec.across
    exact = F.col(f"{al}max_x") if high else F.col(f"{al}min_x")
    edges = F.filter(G.edges("stg"), lambda e: e["b"].isNotNull())
    on_face = F.filter(edges, lambda e: (e["a"][al] == exact) & (e["b"][al] == exact))
    cols = {
        "k": F.col(key),
        "v": F.col(vcol),
        "exact": exact,
        "lo": F.col(f"{ac}min_x"),
        "hi": F.col(f"{ac}max_x"),
        "regions": F.col(REGIONS),
    }
    if is_poly:
        cols["elems"] = F.transform(
            on_face, lambda e: F.struct(F.least(e["a"][ac], e["b"][ac]).alias("lo"), F.greatest(e["a"][ac], e["b"][ac]).alias("hi"))
        )
    else:
        cols["pts"] = F.array_distinct(F.filter(G.vertices("stg"), lambda p: p[al] == exact))
        cols["ends"] = G.path_endpoints("stg")
        cols["flat"] = F.size(on_face) > 0
    return df.filter(F.col(fcol)).select(*[c.alias(n) for n, c in cols.items()], *attrs)


def _in_stretches(faces: DataFrame, high: bool) -> DataFrame:
    """One row per stretch in which a face can meet faces of the other side.

    Where the high face is the longer one, or both are at home in the same width, they meet on lane 0: the high face in its home, the low
    one in all widths from its home on.  Where the low face is the longer one, on lane 1."""
    last = len(STRETCHES) - 1
    size = F.col("hi") - F.col("lo")
    home = F.lit(last)
    for k in range(last - 1, -1, -1):
        home = F.when(size <= STRETCHES[k], F.lit(k)).otherwise(home)
    # constants by home, looked up: a filter over all places would be interpreted for every row
    place = lambda k, lane: F.struct(F.lit(k).alias("width"), F.lit(lane).alias("lane"))
    if high:
        used = [F.array(place(h, 0), *(place(k, 1) for k in range(h + 1, last + 1))) for h in range(last + 1)]
    else:
        used = [F.array(*(place(k, 0) for k in range(h, last + 1)), place(h, 1)) for h in range(last + 1)]
    rows = faces.withColumn("p", F.explode(F.element_at(F.array(*used), home + 1))).withColumns({"width": F.col("p.width"), "lane": F.col("p.lane")}).drop("p")
    metres = F.element_at(F.array(*(F.lit(w) for w in STRETCHES)), F.col("width") + 1)
    rows = rows.withColumn("metres", metres)
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / F.col("metres")).cast("long"), F.floor(F.col("hi") / F.col("metres")).cast("long"))))


def _meeting(df: DataFrame, key: str, attrs: list[str], is_poly: bool, spec: PassSpec, match_attrs: bool = True) -> DataFrame:
    """High faces ``h`` and low faces ``l`` of one stretch."""
    h = _in_stretches(_face_rows(df, key, attrs, is_poly, spec, high=True), True).alias("h")
    lo = _in_stretches(_face_rows(df, key, attrs, is_poly, spec, high=False), False).alias("l")
    cond = [F.col(f"h.{c}") == F.col(f"l.{c}") for c in ("v", "width", "lane", "bucket")]
    if match_attrs:
        cond += [F.col(f"h.{a}").eqNullSafe(F.col(f"l.{a}")) for a in attrs]
    return big_join(h, lo, cond, "inner")


def face_join(df: DataFrame, key: str, attrs: list[str], is_poly: bool, spec: PassSpec, match_attrs: bool = True) -> DataFrame:
    """Candidate pairs: high face of ``h`` on the same line as low face of ``l``.

    One row per unordered pair, with both sides' face data.
    """
    return _meeting(df, key, attrs, is_poly, spec, match_attrs).filter(
        (F.col("h.k") != F.col("l.k"))
        & (F.col("h.lo") <= F.col("l.hi"))
        & (F.col("l.lo") <= F.col("h.hi"))
        # emit a pair once: in the stretch holding the start of the overlap ...
        & (F.floor(F.greatest(F.col("h.lo"), F.col("l.lo")) / F.col("h.metres")).cast("long") == F.col("h.bucket"))
        # a pair needs a crop region in common
        & F.arrays_overlap("h.regions", "l.regions")
    )


def _poly_fast(h: str = "h", l: str = "l") -> Column:
    return F.exists(
        F.col(f"{h}.elems"),
        lambda i: F.exists(F.col(f"{l}.elems"), lambda j: F.least(i["hi"], j["hi"]) > F.greatest(i["lo"], j["lo"])),
    )


def _line_fast(h: str = "h", l: str = "l") -> Column:
    shared = F.array_intersect(F.col(f"{h}.pts"), F.col(f"{l}.pts"))
    hends, lends = F.col(f"{h}.ends"), F.col(f"{l}.ends")
    return (
        (F.size(shared) > 0)
        & F.forall(shared, lambda p: F.array_contains(hends, p) & F.array_contains(lends, p))
        & (F.size(hends) > F.size(shared))
        & (F.size(lends) > F.size(shared))
    )


def relate_pairs(df: DataFrame, key: str, attrs: list[str], is_poly: bool, spec: PassSpec, geom_source: DataFrame | None = None) -> DataFrame:
    """Join list ``(merge_id, drop_id)``: pairs passing the reference's DE-9IM pattern.

    ``df`` must already carry ``stg``, bbox columns, flags, region names and be boundary-filtered.
    """
    j = face_join(df, key, attrs, is_poly, spec)
    exact_eq = F.col("h.exact") == F.col("l.exact")
    if is_poly:
        fast_ok = exact_eq & _poly_fast()
        slow = ~exact_eq
    else:
        no_flat = ~F.col("h.flat") & ~F.col("l.flat")
        fast_ok = exact_eq & no_flat & _line_fast()
        slow = ~(exact_eq & no_flat)
    pairs = j.select(
        F.greatest("h.k", "l.k").alias("merge_id"),
        F.least("h.k", "l.k").alias("drop_id"),
        fast_ok.alias("fast_ok"),
        slow.alias("slow"),
    ).filter("fast_ok or slow")
    # the candidate pairs are few (features meeting across a line): materialise them, and run
    # the exact per-pair check only when some pair needs it
    obs = Observation()
    pairs = materialize(pairs.observe(obs, F.sum(F.col("slow").cast("long")).alias("slow")), f"candpairs-{spec.name}")
    fast = pairs.filter("fast_ok").select("merge_id", "drop_id")
    slow_pairs = pairs.filter("slow").select("merge_id", "drop_id")
    if not (obs.get["slow"] or 0):
        return fast.distinct()
    from sheetseam.operators import relate

    checked = relate.check_slow_pairs(slow_pairs, df, key, is_poly)
    # a pair can match in both orientations only for zero-height faces
    return fast.unionByName(checked).distinct()


def identify(layer: DataFrame, key: str, attrs: list[str], is_poly: bool, spec: PassSpec, geom: str = "geom") -> DataFrame:
    """Pass identification: bbox -> flags -> boundary filter -> face join -> relate.

    Key and attributes travel under internal names, so an attribute may be called like any working column."""
    names = [f"{INTERNAL}a{i}" for i in range(len(attrs))]
    bare = layer.select(
        F.col(f"`{key}`").alias(INTERNAL + "key"), *[F.col(f"`{a}`").alias(n) for a, n in zip(attrs, names)], F.col(geom).alias("geom"), REGIONS
    )
    cand = boundary_candidates(bare, is_poly, spec)
    return relate_pairs(cand, INTERNAL + "key", names, is_poly, spec)
