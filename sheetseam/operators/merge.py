"""One merge pass: groups -> merged features, unmerged features, fallback originals.

``union`` dissolves polygons by joins (:mod:`sheetseam.operators.dissolve`); a union that does not close is rejected like a multi-part one.

``linemerge`` sews paths by joins (:mod:`sheetseam.operators.lines`); a group with a junction stays in several pieces and is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.operators.components import connected_components
from sheetseam.operators.dissolve import NOT_CLOSED, dissolve_polygons
from sheetseam.operators.lines import merge_lines
from sheetseam.schemas import BOUNDARY_ERROR_MSG, GROUP, MULTI_TYPES, REGIONS
from sheetseam.session import big_join, materialize

OPS = ("collect", "union", "linemerge")


@dataclass
class MergeResult:
    layer: DataFrame  # ogc_fid, key, attrs..., ufid_components, regions, geom
    report: DataFrame  # ref, msg
    groups: DataFrame  # comp, accepted, gtype
    membership: DataFrame  # id, comp
    written: tuple = ()  # tables that layer, report and groups read; release them when those are done


def collect_geometry(members: DataFrame) -> DataFrame:
    """``(comp, geom)``: ``st_collect`` -- members side by side in one multi-geometry, no dissolve."""
    g = members.select("comp", G.snap("geom").alias("g"))
    agg = g.groupBy("comp").agg(
        F.flatten(F.collect_list("g.parts")).alias("parts"),
        F.max(F.col("g.gtype").startswith("MULTI").cast("int")).alias("has_multi"),
        F.first("g.gtype").alias("t"),
    )
    multi = F.when(F.col("has_multi") == 1, F.lit("GEOMETRYCOLLECTION")).when(
        F.col("t").isin("POLYGON", "MULTIPOLYGON"), F.lit("MULTIPOLYGON")
    ).otherwise(F.lit("MULTILINESTRING"))
    return agg.select("comp", F.struct(multi.alias("gtype"), F.col("parts").alias("parts")).alias("geom"))


def merge_pass(
    layer: DataFrame,
    pairs: DataFrame,
    key: str,
    attrs: list[str],
    op: str,
    table: str,
) -> MergeResult:
    """Apply one join list: returns unmerged + accepted merges + originals of rejected groups."""
    if op not in OPS:
        raise ValueError(f"op must be one of {OPS}")
    cols = layer.columns
    memb = connected_components(pairs)  # id, comp
    # one shuffle of the layer: every feature with its group, or none
    tagged = materialize(big_join(layer, memb.select(F.col("id").alias(key), F.col("comp").alias(GROUP)), key, "left"), "tagged")
    unmerged = tagged.filter(F.col(GROUP).isNull()).select(*cols)
    members = tagged.filter(F.col(GROUP).isNotNull())
    shapes = members.select(F.col(GROUP).alias("comp"), "geom")
    if op == "union":
        geoms = dissolve_polygons(shapes)
    elif op == "linemerge":
        geoms = merge_lines(shapes)
    else:
        geoms = collect_geometry(shapes)
    rejected_types = (*MULTI_TYPES, NOT_CLOSED)
    merged = materialize(geoms.withColumn("accepted", ~F.col("geom.gtype").isin(*rejected_types)), "merged")
    groups = merged.select("comp", "accepted", F.col("geom.gtype").alias("gtype"))

    agg = members.groupBy(GROUP).agg(
        F.max("ogc_fid").alias("ogc_fid"),
        *[F.first(a).alias(a) for a in attrs],
        F.sort_array(F.flatten(F.collect_set("ufid_components"))).alias("ufid_components"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(REGIONS)))).alias(REGIONS),
    )
    accepted = merged.filter("accepted").select(F.col("comp").alias("__comp"), F.col("geom").alias("__geom"))
    ok = big_join(agg, accepted, F.col(GROUP) == F.col("__comp")).withColumn(key, F.col(GROUP)).withColumnRenamed("__geom", "geom").select(*cols)
    rejected = merged.filter(~F.col("accepted")).select(F.col("comp").alias(GROUP))
    fallback_rows = big_join(members, rejected, GROUP)
    fallback = fallback_rows.select(*cols)
    report = fallback_rows.select(F.col(key).cast("long").alias("ref"), F.lit(BOUNDARY_ERROR_MSG.format(table=table)).alias("msg"))
    return MergeResult(unmerged.unionByName(ok).unionByName(fallback), report, groups, memb, (tagged, merged))
