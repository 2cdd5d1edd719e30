"""Layer inspection: attribute columns, key detection, geometry-type dispatch and purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetseam.schemas import KEY_FALLBACK_NAME, LINE_TYPES, POLYGON_TYPES, SYSTEM_COLUMNS

NEVER_KEY = ("ogc_fid", "geom")


def select_except(df: DataFrame, omit) -> DataFrame:
    """All columns in ordinal order except ``omit``."""
    omit = set(omit)
    return df.select(*[c for c in df.columns if c not in omit])


def attribute_columns(df: DataFrame, key: str, table: str | None = None) -> list[str]:
    """Columns compared for equality when pairing: all but key, geometry, system columns and a
    column named like the table."""
    skip = {key, *SYSTEM_COLUMNS}
    if table:
        skip.add(table)
    return [c for c in df.columns if c not in skip]


def detect_key(df: DataFrame) -> DataFrame:
    """One row ``(key_column)``: the first column (schema order, not ogc_fid/geom) whose values
    are all distinct (one NULL allowed), else ``'ufid'``.

    One pass counts approximately and discards columns that are clearly repeated; the rest is counted exactly, column by column, up to
    the first key."""
    spark = df.sparkSession
    cols = [c for c in df.columns if c not in NEVER_KEY]
    found = KEY_FALLBACK_NAME
    if cols:
        seen = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)],
            *[F.approx_count_distinct(f"`{c}`", 0.05).alias(f"d{i}") for i, c in enumerate(cols)],
        ).first()
        for i, c in enumerate(cols):
            present = seen[f"c{i}"]
            if not seen.n or seen.n - present > 1 or seen[f"d{i}"] < 0.75 * present:
                continue
            if df.groupBy(f"`{c}`").count().filter("count > 1").isEmpty():
                found = c
                break
    return spark.createDataFrame([(found,)], "key_column string")


def detect_key_name(df: DataFrame) -> str:
    return detect_key(df).collect()[0]["key_column"]


def geometry_types(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.groupBy(F.col(f"{geom}.gtype").alias("gtype")).agg(F.count(F.lit(1)).alias("n"))


def handling_of(gtype: Column) -> Column:
    """polygon / line / skip for a geometry type."""
    return F.when(gtype.isin(*POLYGON_TYPES), F.lit("polygon")).when(gtype.isin(*LINE_TYPES), F.lit("line")).otherwise(F.lit("skip"))


def dispatch(df: DataFrame, geom: str = "geom") -> DataFrame:
    """``(gtype, handling)``: majority geometry type (ties: name) -> polygon / line / skip."""
    t = geometry_types(df, geom).orderBy(F.desc("n"), "gtype").limit(1)
    return t.select("gtype", handling_of(F.col("gtype")).alias("handling"))


def dispatch_kind(df: DataFrame, geom: str = "geom") -> str:
    rows = dispatch(df, geom).collect()
    return rows[0]["handling"] if rows else "skip"


def purge_minority(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Delete the features of the least frequent geometry type when a layer mixes types.

    A uniform layer is returned unchanged."""
    counts = geometry_types(df, geom)
    stats = counts.agg(F.count(F.lit(1)).alias("k"), F.min_by("gtype", F.struct("n", "gtype")).alias("minority"))
    drop = stats.filter(F.col("k") > 1).select(F.col("minority").alias("_t"))
    # one row at most: a broadcast anti-join of a proven single-row frame
    return df.join(F.broadcast(drop), F.col(f"{geom}.gtype") == F.col("_t"), "left_anti")


def layer_extent(df: DataFrame, geom: str = "geom") -> DataFrame:
    from sheetseam.functions import geometry as G

    return df.agg(
        F.min(G.xmin(geom)).alias("xmin"),
        F.min(G.ymin(geom)).alias("ymin"),
        F.max(G.xmax(geom)).alias("xmax"),
        F.max(G.ymax(geom)).alias("ymax"),
    )
