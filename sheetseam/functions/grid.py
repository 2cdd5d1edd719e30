"""Sheet-grid predicates on rounded bounding-box values (decimal Columns).

PostgreSQL ``div``/``mod`` truncate toward zero; Spark's ``div`` and ``%``
do the same, so ``pmod`` must not be used here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Standard north/south sheet edges: (y - 6000) divisible by 36000, quotient in (131, 172).
NS_BASE, NS_STEP, NS_MIN_EXCL, NS_MAX_EXCL = 6000, 36000, 131, 172
# Standard east/west sheet edges: (x - 4000) divisible by 24000, quotient in (45, 87).
EW_BASE, EW_STEP, EW_MIN_EXCL, EW_MAX_EXCL = 4000, 24000, 45, 87
# A bbox value is on *some* sheet line when it is a multiple of this.
MAP_SHEET_IDENT = 1000
# Irregular sheet edges, as listed (99 entries, 70 distinct; eastings and northings mixed).
NONSTANDARD_EDGES = (
    5862000, 2092000, 1144000, 1844000, 1868000, 1436000, 5598000, 5034000, 5826000, 5790000,
    1484000, 1500000, 5106000, 5826000, 5973000, 1748000, 4722000, 1620000, 4740000, 5502000,
    1084000, 2084000, 5670000, 1528000, 1116000, 1940000, 1916000, 6114000, 1092000, 5598000,
    4842000, 6198000, 1892000, 5682000, 5070000, 5502000, 6198000, 1940000, 6006000, 5142000,
    1604000, 6114000, 5178000, 1580000, 1868000, 1620000, 1524000, 4878000, 1504000, 1940000,
    5937000, 5538000, 2092000, 1740000, 1764000, 1460000, 1964000, 1980000, 1892000, 1700000,
    5826000, 5214000, 5718000, 5790000, 5466000, 1644000, 5562000, 6198000, 2036000, 5178000,
    6150000, 1716000, 4776000, 5466000, 1844000, 1868000, 2060000, 5502000, 5142000, 1772000,
    1120000, 1740000, 1508000, 1916000, 1084000, 6042000, 6150000, 5430000, 1844000, 1596000,
    5634000, 5538000, 1956000, 1676000, 1868000, 5634000, 1964000, 6234000, 2012000,
)
# ---------------------------------------------------------------------------

NONSTANDARD_SET = tuple(sorted(set(NONSTANDARD_EDGES)))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _integral(v: Column) -> Column:
    # as doubles: a decimal against a long would be compared, and divided, as BigDecimal
    return v.cast("double") == v.cast("long").cast("double")


def _on_grid(v: Column, base: int, step: int, lo: int, hi: int) -> Column:
    # only an integral value can be on the grid; then all arithmetic is on longs
    d = v.cast("long") - F.lit(base)
    q = (d - d % F.lit(step)) / F.lit(step)  # exact: d is a multiple of step when it matters
    return _integral(v) & (d % F.lit(step) == 0) & (q > lo) & (q < hi)


def on_northsouth(v) -> Column:
    """True when a northing lies on a standard north/south sheet edge."""
    return _on_grid(_c(v), NS_BASE, NS_STEP, NS_MIN_EXCL, NS_MAX_EXCL)


def on_eastwest(v) -> Column:
    """True when an easting lies on a standard east/west sheet edge."""
    return _on_grid(_c(v), EW_BASE, EW_STEP, EW_MIN_EXCL, EW_MAX_EXCL)


def on_nonstandard(v) -> Column:
    """True when the value, rounded to an integer (half away from zero), is an irregular edge."""
    return F.floor(_c(v).cast("double") + 0.5).isin(*NONSTANDARD_SET)  # all are positive


def boundary_flags(nv="nv", sv="sv", ev="ev", wv="wv") -> dict[str, Column]:
    """``N/S/E/W``: the rounded bbox value is a multiple of 1000."""

    def on_line(v) -> Column:
        return _integral(_c(v)) & (_c(v).cast("long") % F.lit(MAP_SHEET_IDENT) == 0)

    return {"n": on_line(nv), "s": on_line(sv), "e": on_line(ev), "w": on_line(wv)}


def boundary_filter_ns() -> Column:
    n, s = F.col("n"), F.col("s")
    return (n & on_northsouth("nv")) | (s & on_northsouth("sv")) | on_nonstandard("nv") | on_nonstandard("sv")


def boundary_filter_ew() -> Column:
    e, w = F.col("e"), F.col("w")
    return (e & on_eastwest("ev")) | (w & on_eastwest("wv")) | on_nonstandard("ev") | on_nonstandard("wv")
