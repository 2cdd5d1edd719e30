"""Stitch a layer: north/south pass, east/west pass on its result, final ids, logs, checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetseam.operators import candidates as C
from sheetseam.operators import ids as I
from sheetseam.operators.inspect import attribute_columns, dispatch_kind
from sheetseam.operators.merge import MergeResult, merge_pass
from sheetseam.operators.regions import with_regions
from sheetseam.schemas import INTERNAL, OUTPUT_PREFIX, REGIONS
from sheetseam.session import big_join, materialize, prepare_session, spread

INTERIM_KEY = INTERNAL + "interim"


@dataclass
class PassResult:
    pairs: DataFrame
    merge: MergeResult


@dataclass
class StitchResult:
    layer: DataFrame  # final layer (components dropped)
    interim: DataFrame  # final layer with ufid_components and regions
    associations: DataFrame  # rows to append to the associations log
    report: DataFrame  # rows to append to the report log (ref, msg, ts)
    passes: dict = field(default_factory=dict)


def default_op(kind: str) -> str:
    return "union" if kind == "polygon" else "linemerge"


def prepare(layer: DataFrame, key: str, regions: DataFrame | None) -> DataFrame:
    """Key as long, regions attached (features outside all regions dropped), components seeded."""
    df = spread(layer).withColumn(key, F.col(key).cast("long"))
    df = with_regions(df, regions, key=key)
    return df.withColumn("ufid_components", F.array(F.col(key)))


def run_pass(df: DataFrame, key: str, attrs: list[str], kind: str, op: str, spec: C.PassSpec, table: str) -> PassResult:
    is_poly = kind == "polygon"
    pairs = C.identify(df, key, attrs, is_poly, spec)  # reads the materialised candidate pairs
    return PassResult(pairs, merge_pass(df, pairs, key, attrs, op, table))


def stitch_layer(
    layer: DataFrame,
    key: str,
    name: str = "layer",
    kind: str | None = None,
    op: str | None = None,
    regions: DataFrame | None = None,
    associations: DataFrame | None = None,
    scope: str = "global",
    attrs: list[str] | None = None,
    first: PassResult | None = None,
) -> StitchResult:
    """Both passes, ids and logs; ``first`` is the north/south pass of this very layer, if it was run already."""
    spark = layer.sparkSession
    prepare_session(spark)
    kind = kind or dispatch_kind(layer)
    if kind not in ("polygon", "line"):
        raise ValueError(f"layer {name}: geometry type not stitched ({kind})")
    op = op or default_op(kind)
    attrs = attrs if attrs is not None else attribute_columns(layer, key, name)
    out_name = OUTPUT_PREFIX + name
    p1 = first
    if p1 is None:
        # the prepared layer feeds the candidates, the anti-join and the member join: write it once
        df = materialize(prepare(layer, key, regions), "prepared")
        p1 = run_pass(df, key, attrs, kind, op, C.NS, f"northsouth_{name}")
    mid = materialize(p1.merge.layer, "pass1")  # pass 2 reads pass 1's result: cut the lineage here
    p2 = run_pass(mid, key, attrs, kind, op, C.EW, f"eastwest_{name}")
    before = p2.merge.layer.withColumn(INTERIM_KEY, F.col(key).cast("long"))
    done = materialize(I.assign_final_ids(before, key, out_name, associations, scope), "final")
    interim = done.drop(INTERIM_KEY)

    assoc_rows = I.association_rows(interim, key, out_name)
    final = interim.drop("ufid_components", REGIONS)
    # a composite rejected in pass 2 is reported by its final id, under which it is logged
    ids = done.filter(F.size("ufid_components") > 1).select(F.col(INTERIM_KEY).alias("ref"), F.col(key).cast("long").alias("final_id"))
    second = big_join(p2.merge.report, ids, "ref", "left").select(F.coalesce("final_id", "ref").alias("ref"), "msg")
    report = (
        p1.merge.report.unionByName(second)
        .unionByName(I.collision_report(final, key, out_name))
    )
    return StitchResult(final, interim, assoc_rows, I.stamp(report), {"ns": p1, "ew": p2})


def stitch_pass_only(layer: DataFrame, key: str, kind: str, spec: C.PassSpec, op: str | None = None, regions=None, name: str = "layer") -> PassResult:
    """One pass on a prepared layer (used by per-operator queries)."""
    prepare_session(layer.sparkSession)
    df = materialize(prepare(layer, key, regions), "prepared")
    attrs = attribute_columns(layer, key, name)
    return run_pass(df, key, attrs, kind, op or default_op(kind), spec, name)
