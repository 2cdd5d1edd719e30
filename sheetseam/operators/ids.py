"""Stable composite ids, the associations log and the report log.

Composite features (more than one component) reuse the id of the latest
logged identical component list (C9/K1); the rest get fresh numbers from
``max(1e8, max(logged id) + 1)`` upward, in order of their smallest component
(K2).  Ranking uses range partitioning + per-partition offsets (the
``zipWithIndex`` idea on DataFrames) rather than a global window, so no single
task sees all composites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetseam.schemas import ASSOCIATIONS_SCHEMA, COLLISION_MSG, FINAL_ID_START, INTERNAL, REPORT_SCHEMA
from sheetseam.session import big_join, materialize


def empty_associations(spark) -> DataFrame:
    return spark.createDataFrame([], ASSOCIATIONS_SCHEMA)


def empty_report(spark) -> DataFrame:
    return spark.createDataFrame([], REPORT_SCHEMA)


def latest_ids(assoc: DataFrame) -> DataFrame:
    """Per component list the id of its latest log row (ties: larger id)."""
    return assoc.groupBy(F.sort_array(F.array_distinct("ufid_components")).alias("comps")).agg(F.max_by("ufid", F.struct("ts", "ufid")).alias("found"))


def dense_rank_by(df: DataFrame, order_col: str, out_col: str = "rank") -> DataFrame:
    """0-based rank of ``order_col`` (distinct values) without a single-partition window: ranks within range
    partitions, plus a joined table of one offset per partition."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part, at = INTERNAL + "part", INTERNAL + "at"
    ordered = df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
    tagged = ordered.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.spark_partition_id())
    tagged = materialize(tagged, "ranked")  # fixes partitioning and numbers, so offsets match the rows
    sizes = tagged.groupBy(part).count()
    offsets = sizes.select(F.col(part), (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(INTERNAL + "offset"))  # one row per partition
    both = tagged.join(F.broadcast(offsets), part)
    rank = F.col(INTERNAL + "offset") + F.col(at) - F.shiftleft(F.col(part).cast("long"), 33)
    return both.withColumn(out_col, rank.cast("long")).select(*df.columns, out_col)


def assign_final_ids(
    layer: DataFrame,
    key: str,
    layer_name: str,
    assoc: DataFrame | None = None,
    scope: str = "global",
) -> DataFrame:
    """Replace the interim key of every composite by a stable final id (singles keep theirs)."""
    spark = layer.sparkSession
    have_log = assoc is not None
    assoc = assoc if assoc is not None else empty_associations(spark)
    is_comp = F.size("ufid_components") > 1
    singles = layer.filter(~is_comp)
    own, first, new = INTERNAL + "comps", INTERNAL + "first", INTERNAL + "id"
    comps = layer.filter(is_comp).withColumn(own, F.sort_array(F.array_distinct("ufid_components")))
    found = latest_ids(assoc.filter(F.col("layer") == layer_name) if scope == "layer" else assoc)
    found = found.select(F.col("comps").alias(own), F.col("found").alias(new))
    if have_log:
        looked = big_join(comps, found, own, "left")
        start_row = assoc.agg(F.max("ufid").alias("m")).collect()[0]["m"]
    else:  # first run: nothing to look up
        looked = comps.withColumn(new, F.lit(None).cast("long"))
        start_row = None
    start = max(FINAL_ID_START, (int(start_row) + 1) if start_row is not None else FINAL_ID_START)
    fresh = looked.filter(F.col(new).isNull()).withColumn(first, F.element_at(own, 1))
    fresh = dense_rank_by(fresh, first, INTERNAL + "rank").withColumn(new, F.lit(start) + F.col(INTERNAL + "rank")).drop(INTERNAL + "rank", first)
    reused = looked.filter(F.col(new).isNotNull())
    cols = layer.columns
    out = reused.unionByName(fresh).withColumn(key, F.col(new).cast(layer.schema[key].dataType)).select(*cols)
    return singles.unionByName(out)


def association_rows(final: DataFrame, key: str, layer_name: str, ts: Column | None = None) -> DataFrame:
    """Log rows ``(ts, layer, ufid, ufid_components)`` for composites, ts truncated to the minute."""
    ts = ts if ts is not None else F.date_trunc("minute", F.current_timestamp())
    return final.filter(F.size("ufid_components") > 1).select(
        ts.alias("ts"),
        F.lit(layer_name).alias("layer"),
        F.col(key).cast("long").alias("ufid"),
        F.col("ufid_components").cast("array<bigint>").alias("ufid_components"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys occurring more than once: ``(key, n)``."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def collision_report(df: DataFrame, key: str, table: str) -> DataFrame:
    return duplicate_keys(df, key).select(F.col(key).cast("long").alias("ref"), F.lit(COLLISION_MSG.format(table=table)).alias("msg"))


def stamp(report: DataFrame, ts: Column | None = None) -> DataFrame:
    """Add the report timestamp (``report_rbl`` logs ``current_timestamp``)."""
    return report.select("ref", "msg", (ts if ts is not None else F.current_timestamp()).alias("ts"))


def component_lookup(assoc: DataFrame, ufid: int | None = None) -> DataFrame:
    """When, in which layer and from which components a composite id was built."""
    return assoc.filter(F.col("ufid") == ufid) if ufid is not None else assoc


def reverse_lookup(assoc: DataFrame) -> DataFrame:
    """``(component, ufid, layer, ts)``: which composites a source id went into."""
    return assoc.select(F.explode("ufid_components").alias("component"), "ufid", "layer", "ts")


def report_with_associations(report: DataFrame, assoc: DataFrame) -> DataFrame:
    """Report rows joined to the associations they refer to (``ref = ufid``)."""
    return report.join(assoc.withColumnRenamed("ts", "assoc_ts"), report["ref"] == assoc["ufid"])

