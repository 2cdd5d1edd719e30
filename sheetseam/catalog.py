"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (``orders`` -> polygon layer, ``events``
-> line layer, others where the operator is generic) over their whole
extent.  Column names equal those of :mod:`sheetseam.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.functions import grid
from sheetseam.functions.arrays import array_union_agg, ids_text, normalise_ids
from sheetseam.operators import candidates as C
from sheetseam.operators import components as K
from sheetseam.operators import ids as I
from sheetseam.operators import inspect as X
from sheetseam.operators import merge as M
from sheetseam.operators.regions import region_join
from sheetseam.plans import runner
from sheetseam.plans import stitching as S
from sheetseam.plans import utilities as U
from sheetseam.schemas import ASSOCIATIONS_SCHEMA, REGIONS
from sheetseam.sources import commits
from sheetseam.sources import derived as D
from sheetseam.sources import store as ST
from sheetseam.session import ensure_checkpoint_dir, materialize, spread

_CACHE: dict = {}


def _memo(kind: str, spark: SparkSession, sf_dir: str, build):
    k = (kind, spark.sparkContext.applicationId, sf_dir)
    if k not in _CACHE:
        _CACHE[k] = build()
    return _CACHE[k]


def _folder(spark) -> str:
    """A new folder in the shared place of intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheetseam/layers-{uuid.uuid4().hex}"


def poly(spark, sf_dir) -> DataFrame:
    return D.poly_layer(spread(D.read_table(spark, sf_dir, "orders")))  # rows are dealt out before they get their geometry


def line(spark, sf_dir) -> DataFrame:
    return D.line_layer(spread(D.read_table(spark, sf_dir, "events")))


def regions(spark) -> DataFrame:
    return _memo("regions", spark, "", lambda: D.regions(spark))


def _stitched(spark, sf_dir, layer: str) -> S.StitchResult:
    src = poly if layer == "poly" else line
    kind = "polygon" if layer == "poly" else "line"
    first = _CACHE.get((f"ns_{layer}", spark.sparkContext.applicationId, sf_dir))  # the first pass, if a query ran it
    return _memo(f"stitch_{layer}", spark, sf_dir, lambda: S.stitch_layer(src(spark, sf_dir), "ufid", layer, kind=kind, regions=regions(spark), first=first))


def _ns(spark, sf_dir, layer: str) -> S.PassResult:
    """The north/south pass alone (reused from a full stitch when one was already built)."""
    full = _CACHE.get((f"stitch_{layer}", spark.sparkContext.applicationId, sf_dir))
    if full is not None:
        return full.passes["ns"]
    src = poly if layer == "poly" else line
    kind = "polygon" if layer == "poly" else "line"
    return _memo(f"ns_{layer}", spark, sf_dir, lambda: S.stitch_pass_only(src(spark, sf_dir), "ufid", kind, C.NS, regions=regions(spark), name=f"northsouth_{layer}"))


def _both(spark, sf_dir) -> DataFrame:
    return poly(spark, sf_dir).withColumn("layer", F.lit("poly")).unionByName(line(spark, sf_dir).withColumn("layer", F.lit("line")))


def _bbox_both(spark, sf_dir) -> DataFrame:
    p = C.with_flags(C.with_bbox(poly(spark, sf_dir), True)).withColumn("layer", F.lit("poly"))
    l = C.with_flags(C.with_bbox(line(spark, sf_dir), False)).withColumn("layer", F.lit("line"))
    return p.unionByName(l)


def _long(c) -> F.Column:
    return F.round(c).cast("long") if not isinstance(c, str) else F.round(F.col(c)).cast("long")


# ---------------------------------------------------------------- sources
def q_scan_layer_dir(spark, sf_dir):
    layers = ST.scan_layer_dir(spark, sf_dir, ["order", "item"])
    return ST.tagged_union({n: df.select(F.lit(1).alias("one")) for n, df in layers.items()}).groupBy("layer").agg(
        F.count(F.lit(1)).alias("features")
    )


def _coast(spark, sf_dir) -> DataFrame:
    """The northern sheet rows of the polygon layer as a layer of its own: other key, attribute names and types."""
    p = poly(spark, sf_dir).where(F.expr("ufid % 39 >= 20"))
    return p.select(F.col("cls").alias("kind"), F.col("ufid").cast("int").alias("coast_id"), F.col("slot").cast("string").alias("zone"), "ogc_fid", "geom")


def _layer_store(spark, sf_dir, *names) -> str:
    """A store with layers, crop regions, a log of an earlier run, an output layer and a system table."""
    folder = _folder(spark)
    for n, make in (("coast", _coast), ("line", line), ("poly", poly)):
        if n in names:
            ST.write_layer(make(spark, sf_dir), folder, n)
    ST.write_layer(poly(spark, sf_dir).select("ufid", "geom"), folder, "new_older")
    ST.write_layer(D.read_table(spark, sf_dir, "region"), folder, "spatial_ref_sys")
    runner.load_regions(spark, folder, D.regions(spark))
    log = spark.range(1).select(F.lit("2020-01-01").cast("timestamp").alias("ts"), F.lit("new_older").alias("layer"), F.lit(100_000_500).cast("long").alias("ufid"), F.array(F.lit(-2).cast("long"), F.lit(-1).cast("long")).alias("ufid_components"))
    log.write.parquet(f"{folder}/{runner.ASSOCIATIONS}")
    return folder


def q_layer_inventory(spark, sf_dir):
    """Layers of a store by name and type: no log, region, system or output table, and only those of the name list."""
    folder = _layer_store(spark, sf_dir, "coast", "line", "poly")
    ST.write_layer(_mixed(spark, sf_dir), folder, "mixed")
    found = runner.inventory(spark, folder, ["line", "poly", "mixed", "new_older", runner.REGIONS, "spatial_ref_sys", runner.ASSOCIATIONS])
    return found.select("layer", "gtype", "features", *(_long(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


def q_verify_copy(spark, sf_dir):
    src = poly(spark, sf_dir)
    ST.write_layer(src.withColumn("geom", G.to_wkt("geom")), folder := _folder(spark), "new_poly")
    copy = spark.read.parquet(f"{folder}/new_poly").withColumn("geom", G.from_wkt("geom"))
    good = ST.verify_copy(src, copy, "poly", "new_poly")
    return good.unionByName(ST.verify_copy(src, line(spark, sf_dir), "poly", "new_line"))


def q_write_layer(spark, sf_dir):
    """A layer written twice: the second write replaces the first."""
    src, folder = poly(spark, sf_dir).select("ufid", "cls"), _folder(spark)
    ST.write_layer(src.withColumn("cls", F.lit("first write")), folder, "new_poly")
    ST.write_layer(src, folder, "new_poly")
    return spark.read.parquet(f"{folder}/new_poly").groupBy("cls").agg(F.count(F.lit(1)).alias("features"))


def _stored(spark, sf_dir) -> str:
    folder = _folder(spark)
    for n, df in (("new_poly", poly(spark, sf_dir)), ("new_polygon", line(spark, sf_dir)), ("new_line", line(spark, sf_dir)), ("poly", poly(spark, sf_dir))):
        ST.write_layer(df.select("ufid"), folder, n)
    return folder


def q_scan_stored_layers(spark, sf_dir):
    """Processed layers by exact name: neither the source layer nor one whose name only begins alike."""
    found = ST.scan_stored_layers(spark, _stored(spark, sf_dir), ["poly", "line"])
    return ST.tagged_union(found).groupBy("layer").agg(F.count(F.lit(1)).alias("features"))


def q_export_layer(spark, sf_dir):
    """A text export with WKT, read back."""
    folder = _folder(spark)
    path = ST.export_layer(poly(spark, sf_dir).select("ufid", "cls", "geom"), folder, "new_poly", "csv")
    back = spark.read.option("header", True).csv(path).withColumn("geom", G.from_wkt("geom"))
    return back.select(F.col("ufid").cast("long").alias("ufid"), "cls", _long(G.area()).alias("area"), _long(G.xmin()).alias("xmin"), _long(G.ymax()).alias("ymax"))


def q_link_views(spark, sf_dir):
    views = ST.link_views(spark, _stored(spark, sf_dir), prefix := "seam_view_")
    union = " UNION ALL ".join(f"SELECT '{v[len(prefix):]}' AS layer, count(*) AS features FROM {v}" for v in views)
    return spark.sql(union)


def q_release_snapshot(spark, sf_dir):
    folder, target = _stored(spark, sf_dir), _folder(spark)
    ST.release_snapshot(spark, folder, target, link=True, prefix="seam_release_")
    return ST.tagged_union(ST.scan_layer_dir(spark, target)).groupBy("layer").agg(F.count(F.lit(1)).alias("features"))


def q_revisioned_write(spark, sf_dir):
    """States after an import, an edit in two writes, a deletion, a revision that is never completed, and a re-insert."""
    src, folder = poly(spark, sf_dir).select("ufid", "cls"), _folder(spark)
    edit = lambda every, cls: src.filter(f"ufid % {every} = 0").withColumn("cls", F.lit(cls))
    first = ST.create_revision(spark, folder, "poly", "import")
    ST.write_in_revision(src, folder, "poly", first)
    ST.complete_revision(spark, folder, "poly", first)
    second = ST.create_revision(spark, folder, "poly", "edit")
    ST.write_in_revision(edit(3, "edited"), folder, "poly", second)
    ST.write_in_revision(edit(6, "edited twice"), folder, "poly", second)
    ST.complete_revision(spark, folder, "poly", second)
    third = ST.create_revision(spark, folder, "poly", "clear out")
    ST.write_in_revision(src.filter("ufid % 4 = 0").select("ufid"), folder, "poly", third, delete=True)
    ST.complete_revision(spark, folder, "poly", third)
    fourth = ST.create_revision(spark, folder, "poly", "stopped")
    ST.write_in_revision(edit(2, "never seen"), folder, "poly", fourth)
    fifth = ST.create_revision(spark, folder, "poly", "put back")
    ST.write_in_revision(edit(8, "put back"), folder, "poly", fifth)
    ST.complete_revision(spark, folder, "poly", fifth)
    states = [ST.read_as_of(spark, folder, "poly", "ufid", r).withColumn("as_of", F.lit(r).cast("long")) for r in (first, second, third, fourth, fifth)]
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("as_of", "cls").agg(F.count(F.lit(1)).alias("features"))


def q_wkt_rejects(spark, sf_dir):
    """Rows read and rows rejected with their reason, as counted by the scan and as listed."""
    good, rejects, counts = ST.ingest_wkt(D.raw_wkt(D.read_table(spark, sf_dir, "orders")), "wkt")
    listed = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("listed"), F.min("ufid").alias("first"))
    read = good.agg(F.lit("read").alias("reason"), F.count(F.lit(1)).alias("listed"), F.min("ufid").alias("first"))
    kind = F.when(F.col("reason").startswith("type "), F.lit("type")).otherwise(F.col("reason"))
    counted = F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))
    return listed.unionByName(read).select("reason", "listed", "first", counted[kind].cast("long").alias("counted"))


def q_wkt_ingest(spark, sf_dir):
    df = _both(spark, sf_dir).select("layer", "ufid", G.to_wkt("geom").alias("wkt"))
    g = df.select("layer", "ufid", G.from_wkt("wkt").alias("geom"))
    return g.select(
        "layer", "ufid", F.col("geom.gtype").alias("gtype"), G.num_points().alias("n_points"),
        _long(G.xmin()).alias("xmin"), _long(G.ymin()).alias("ymin"), _long(G.xmax()).alias("xmax"), _long(G.ymax()).alias("ymax"),
        _long(G.area()).alias("area"), _long(G.length()).alias("length"),
    )


def q_assign_srid(spark, sf_dir):
    """Codes assigned, written and read back: the default one, one that was identified."""
    folder, out = _folder(spark), None
    for name, df, code in (("poly", poly(spark, sf_dir), None), ("line", line(spark, sf_dir), 27200)):
        ST.write_layer(ST.assign_srid(df, code), folder, name)
        back = ST.read_stored(spark, folder, name)
        row = back.groupBy().agg(F.count(F.lit(1)).alias("features")).select(F.lit(name).alias("layer"), F.lit(ST.srid_of(back)).alias("srid"), "features")
        out = row if out is None else out.unionByName(row)
    return out


def q_text_fidelity_check(spark, sf_dir):
    """A copy through a text file, and one in which some rows were read in the wrong encoding."""
    docs = D.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    copy = ST.text_copy(docs, _folder(spark), "documents", "doc_id", "text")
    wrong = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    damaged = copy.withColumn("text", F.when(F.col("doc_id") % 97 == 0, wrong).otherwise(F.col("text")))
    found = [ST.text_fidelity(docs, c, "doc_id", "text").select(F.lit(n).alias("copy"), "n_flagged", "n_mismatch") for n, c in (("whole", copy), ("damaged", damaged))]
    return found[0].unionByName(found[1])


# ---------------------------------------------------------------- projections / predicates
def q_select_except(spark, sf_dir):
    return X.select_except(poly(spark, sf_dir), ["geom", "ogc_fid"])


def q_excise_column(spark, sf_dir):
    layers = ST.excise_column(spark, sf_dir, "o_orderstatus", ["order", "item"])
    frames = [df.groupBy().agg(F.count(F.lit(1)).alias("features")).select(F.lit(n).alias("layer"), F.lit(len(df.columns)).alias("n_columns"), "features") for n, df in sorted(layers.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _edge_values(spark, sf_dir, cols):
    b = _bbox_both(spark, sf_dir)
    return b.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("v")).distinct()


def q_on_northsouth(spark, sf_dir):
    v = _edge_values(spark, sf_dir, ["nv", "sv"])
    return v.select(F.col("v").cast("long").alias("v"), grid.on_northsouth("v").alias("on_ns"))


def q_on_eastwest(spark, sf_dir):
    v = _edge_values(spark, sf_dir, ["ev", "wv"])
    return v.select(F.col("v").cast("long").alias("v"), grid.on_eastwest("v").alias("on_ew"))


def q_on_nonstandard(spark, sf_dir):
    v = _edge_values(spark, sf_dir, ["nv", "sv", "ev", "wv"])
    return v.select(F.col("v").cast("long").alias("v"), grid.on_nonstandard("v").alias("on_irregular"))


def q_bbox_values(spark, sf_dir):
    b = _bbox_both(spark, sf_dir)
    return b.select("layer", "ufid", *[F.col(c).cast("long").alias(c) for c in ("nv", "sv", "ev", "wv")])


def q_boundary_flags(spark, sf_dir):
    return _bbox_both(spark, sf_dir).select("layer", "ufid", "n", "s", "e", "w")


def q_boundary_filter(spark, sf_dir):
    return _bbox_both(spark, sf_dir).select("layer", "ufid", grid.boundary_filter_ns().alias("pass_ns"), grid.boundary_filter_ew().alias("pass_ew"))


def q_snap_to_grid(spark, sf_dir):
    p = poly(spark, sf_dir).withColumn("g", G.snap("geom"))
    return p.select("ufid", G.xmin("g").alias("sxmin"), G.ymin("g").alias("symin"), G.xmax("g").alias("sxmax"), G.ymax("g").alias("symax"))


DETECT_TABLES = ("orders", "lineitem", "customer", "supplier", "part", "nation", "region", "events")


def q_detect_key(spark, sf_dir):
    out = None
    for t in DETECT_TABLES:
        r = X.detect_key(D.read_table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "key_column")
        out = r if out is None else out.unionByName(r)
    return out


def _mixed(spark, sf_dir):
    return poly(spark, sf_dir).unionByName(line(spark, sf_dir))


def q_geometry_type_dispatch(spark, sf_dir):
    frames = {"line": line(spark, sf_dir), "mixed": _mixed(spark, sf_dir), "poly": poly(spark, sf_dir)}
    out = None
    for n, df in frames.items():
        r = X.dispatch(df).select(F.lit(n).alias("layer"), "gtype", "handling")
        out = r if out is None else out.unionByName(r)
    return out


def q_purge_minority_geometry(spark, sf_dir):
    return X.geometry_types(X.purge_minority(_mixed(spark, sf_dir)))


# ---------------------------------------------------------------- joins
def q_region_join(spark, sf_dir):
    return region_join(_both(spark, sf_dir), regions(spark), "ufid", extra=["layer"])


def _poly_cand(spark, sf_dir, spec=C.NS):
    p = S.prepare(poly(spark, sf_dir), "ufid", regions(spark))
    return C.boundary_candidates(p, True, spec)


def q_face_join(spark, sf_dir):
    j = C.face_join(_poly_cand(spark, sf_dir), "ufid", ["slot", "cls"], True, C.NS)
    return j.select(F.greatest("h.k", "l.k").alias("merge_id"), F.least("h.k", "l.k").alias("drop_id")).distinct()


def q_attr_null_safe(spark, sf_dir):
    """Attributes as keys of the face join, null equal to null; every fifth feature has no class."""
    src = poly(spark, sf_dir).withColumn("cls", F.when(F.col("ufid") % 5 != 0, F.col("cls")))
    cand = C.boundary_candidates(S.prepare(src, "ufid", regions(spark)), True, C.NS)
    j = C.face_join(cand, "ufid", ["slot", "cls"], True, C.NS)
    return j.select(F.greatest("h.k", "l.k").alias("merge_id"), F.least("h.k", "l.k").alias("drop_id"), F.col("h.cls").alias("cls")).distinct()


def q_relate_polygons(spark, sf_dir):
    return _ns(spark, sf_dir, "poly").pairs


def q_relate_lines(spark, sf_dir):
    return _ns(spark, sf_dir, "line").pairs


def _near_pairs(spark, sf_dir, layer, is_poly: bool) -> DataFrame:
    df = materialize(S.prepare(layer(D.read_table(spark, sf_dir, "customer")), "ufid", regions(spark)), "prepared")
    return C.identify(df, "ufid", ["slot", "cls"], is_poly, C.NS)


def q_relate_near_polygons(spark, sf_dir):
    """Polygons with sloped edges, gaps, overlaps and corners at a sheet edge."""
    return _near_pairs(spark, sf_dir, D.near_polygons, True)


def q_relate_near_lines(spark, sf_dir):
    """Lines along a sheet edge, with T-junctions, common stretches and gaps."""
    return _near_pairs(spark, sf_dir, D.near_lines, False)


def q_order_join_list(spark, sf_dir):
    return _ns(spark, sf_dir, "poly").pairs.orderBy("merge_id", "drop_id")


def q_unmerged_anti_join(spark, sf_dir):
    pairs = _ns(spark, sf_dir, "poly").pairs
    ids = pairs.select(F.explode(F.array("merge_id", "drop_id")).alias("ufid"))
    return poly(spark, sf_dir).join(ids, "ufid", "left_anti").select("ufid")


def q_member_join(spark, sf_dir):
    return _ns_members(spark, sf_dir, "poly").select("ufid", "comp", "slot", "cls", _long(G.xmin()).alias("xmin"), _long(G.ymin()).alias("ymin"))


def q_fallback_join(spark, sf_dir):
    r = _ns(spark, sf_dir, "line").merge
    bad = r.groups.filter(~F.col("accepted")).select("comp")
    return _ns_members(spark, sf_dir, "line").join(bad, "comp").select("ufid", "comp", "slot", "cls", _long(G.length()).alias("length"))


# ---------------------------------------------------------------- aggregations
def q_array_union_agg(spark, sf_dir):
    li = D.read_table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(ids_text(array_union_agg(F.array("l_partkey", "l_suppkey"))).alias("ids"))


def q_connected_components(spark, sf_dir):
    return K.group_lists_text(_ns(spark, sf_dir, "poly").merge.membership)


def q_maximal_sets(spark, sf_dir):
    r = _ns(spark, sf_dir, "poly")
    cands = r.pairs.select(F.array("merge_id", "drop_id").alias("ids")).unionByName(
        K.group_lists(r.merge.membership).select(F.col("flist").alias("ids"))
    )
    return K.maximal_sets(cands).select(ids_text("ids").alias("flist"))


def _ns_members(spark, sf_dir, layer):
    src = poly(spark, sf_dir) if layer == "poly" else line(spark, sf_dir)
    return src.join(_ns(spark, sf_dir, layer).merge.membership.withColumnRenamed("id", "ufid"), "ufid")


def q_merge_attributes(spark, sf_dir):
    m = _ns_members(spark, sf_dir, "poly")
    return m.groupBy("comp").agg(F.max("ogc_fid").alias("ogc_fid"), F.first("slot").alias("slot"), F.first("cls").alias("cls"))


def q_collect_geometry(spark, sf_dir):
    g = M.collect_geometry(_ns_members(spark, sf_dir, "poly"))
    return g.select("comp", F.col("geom.gtype").alias("gtype"), G.num_parts().alias("n_parts"))


def q_dissolve_polygons(spark, sf_dir):
    g = M.dissolve_polygons(_ns_members(spark, sf_dir, "poly"))
    return g.select(
        "comp", F.col("geom.gtype").alias("gtype"), _long(G.area()).alias("area"), G.num_distinct_points().alias("n_vertices"),
        _long(G.xmin()).alias("xmin"), _long(G.ymin()).alias("ymin"), _long(G.xmax()).alias("xmax"), _long(G.ymax()).alias("ymax"),
    )


def _line_facts():
    return [F.col("geom.gtype").alias("gtype"), G.num_parts().alias("n_parts"), G.num_points().alias("n_vertices"), _long(G.length()).alias("length")]


def q_merge_lines(spark, sf_dir):
    """Accepted groups and the pieces of those with a junction."""
    g = M.merge_lines(_ns_members(spark, sf_dir, "line"))
    return g.select("comp", (F.col("geom.gtype") != "MULTILINESTRING").alias("accepted"), *_line_facts())


def q_layer_extent(spark, sf_dir):
    out = None
    for n, df in (("line", line(spark, sf_dir)), ("poly", poly(spark, sf_dir))):
        e = X.layer_extent(df).select(F.lit(n).alias("layer"), *[_long(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
        out = e if out is None else out.unionByName(e)
    return out


def q_assemble_components(spark, sf_dir):
    st = _stitched(spark, sf_dir, "poly")
    return st.interim.filter(F.size("ufid_components") > 1).select(
        F.element_at("ufid_components", 1).alias("comp"), ids_text("ufid_components").alias("components")
    )


def q_duplicate_keys(spark, sf_dir):
    return I.duplicate_keys(D.read_table(spark, sf_dir, "lineitem"), "l_orderkey")


def q_distinct_rows(spark, sf_dir):
    p = poly(spark, sf_dir)
    exploded = S.with_regions(p, regions(spark)).select("ufid", "slot", "cls", F.explode(REGIONS).alias("region"))
    return exploded.dropDuplicates(["ufid"]).select("ufid", "slot", "cls")


def q_normalise_ids(spark, sf_dir):
    li = D.read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ids_text(normalise_ids(F.array("l_suppkey", "l_partkey", "l_suppkey", "l_orderkey"))).alias("ids"))


# ---------------------------------------------------------------- set operations
def q_union_ids(spark, sf_dir):
    p = _ns(spark, sf_dir, "poly").pairs
    return p.select(F.explode(F.array("merge_id", "drop_id")).alias("id")).distinct()


def q_union_merged_fallback(spark, sf_dir):
    r = _ns(spark, sf_dir, "line").merge
    out = r.layer
    bad = r.groups.filter(~F.col("accepted")).select("comp")
    fb = r.membership.join(bad, "comp").select(F.col("id").alias("ufid"), F.lit("fallback").alias("kind"))
    kind = F.when(F.size("ufid_components") > 1, F.lit("merged")).otherwise(F.lit("unmerged"))
    rest = out.join(fb, "ufid", "left_anti").select("ufid", kind.alias("kind"))
    return rest.unionByName(fb)


def q_union_regions(spark, sf_dir):
    out = _ns(spark, sf_dir, "poly").merge.layer
    return out.select("ufid", F.array_join(REGIONS, ",").alias("regions"))


# ---------------------------------------------------------------- ids and logs
def _final_ids(spark, sf_dir, layer):
    st = _stitched(spark, sf_dir, layer)
    return st.interim.filter(F.size("ufid_components") > 1).select("ufid", ids_text("ufid_components").alias("components"))


def _second_run_log(spark, sf_dir) -> DataFrame:
    """A log of earlier runs of the polygon layer: for every group an older id, for most a newer one, for some a second
    one of the same time; every seventh group was logged with one member less."""
    groups = _stitched(spark, sf_dir, "poly").interim.filter(F.size("ufid_components") > 1).select("ufid_components")
    first = F.element_at("ufid_components", 1)
    logged = F.when(first % 7 == 0, F.slice("ufid_components", 1, F.size("ufid_components") - 1)).otherwise(F.col("ufid_components"))
    rows = groups.select(first.alias("f"), logged.alias("ufid_components"))
    row = lambda ts, base: F.struct(F.lit(ts).cast("timestamp").alias("ts"), (F.lit(base) + F.col("f")).alias("ufid"))
    each = F.array_compact(F.array(
        row("2020-01-01", 200_000_000), F.when(F.col("f") % 3 != 0, row("2021-01-01", 300_000_000)), F.when(F.col("f") % 5 == 0, row("2021-01-01", 400_000_000)),
    ))
    return rows.select(F.explode(each).alias("r"), "ufid_components").select("r.ts", F.lit("new_poly").alias("layer"), "r.ufid", "ufid_components")


def q_stable_ids(spark, sf_dir):
    """A second run: logged ids are used again (the latest, of equal times the larger), changed groups get new ones."""
    layer = _stitched(spark, sf_dir, "poly").passes["ew"].merge.layer
    out = I.assign_final_ids(layer, "ufid", "new_poly", _second_run_log(spark, sf_dir))
    return out.filter(F.size("ufid_components") > 1).select("ufid", ids_text("ufid_components").alias("components"))


def q_component_by_id(spark, sf_dir):
    """What the first composite was built from."""
    a = I.component_lookup(_stitched(spark, sf_dir, "poly").associations, 100_000_000)
    return a.select("layer", "ufid", ids_text("ufid_components").alias("components"))


def q_allocate_ids(spark, sf_dir):
    return _final_ids(spark, sf_dir, "line")


def q_assign_final_ids(spark, sf_dir):
    st = _stitched(spark, sf_dir, "poly")
    return st.layer.select("ufid", (F.col("ufid") >= F.lit(100_000_000)).alias("is_composite"))


def q_finalise_layer(spark, sf_dir):
    st = _stitched(spark, sf_dir, "poly")
    f = st.interim
    return f.select(
        "ufid", "ogc_fid", "slot", "cls", F.col("geom.gtype").alias("gtype"), _long(G.area()).alias("area"),
        _long(G.xmin()).alias("xmin"), _long(G.ymin()).alias("ymin"), _long(G.xmax()).alias("xmax"), _long(G.ymax()).alias("ymax"),
        F.size("ufid_components").cast("long").alias("n_components"),
    )


def q_stitch_layer(spark, sf_dir):
    st = _stitched(spark, sf_dir, "line")
    f = st.interim
    return f.select(
        "ufid", "ogc_fid", "slot", "cls", F.col("geom.gtype").alias("gtype"), _long(G.length()).alias("length"),
        G.num_points().cast("long").alias("n_points"), F.size("ufid_components").cast("long").alias("n_components"),
    )


def q_append_associations(spark, sf_dir):
    a = _stitched(spark, sf_dir, "poly").associations
    return a.select("layer", "ufid", ids_text("ufid_components").alias("components"))


def q_append_report(spark, sf_dir):
    return _stitched(spark, sf_dir, "line").report.select("ref", "msg")


def q_component_lookup(spark, sf_dir):
    a = _stitched(spark, sf_dir, "poly").associations
    return I.reverse_lookup(a).select("component", "ufid")


def q_duplicate_check(spark, sf_dir):
    return I.duplicate_keys(_stitched(spark, sf_dir, "poly").layer, "ufid")


def q_single_part_filter(spark, sf_dir):
    g = _ns(spark, sf_dir, "line").merge.groups
    return g.select("comp", F.col("accepted"))


def q_drop_components(spark, sf_dir):
    st = _stitched(spark, sf_dir, "poly")
    return st.layer.select(*[c for c in st.layer.columns if c != "geom"])


def q_assoc_lookup(spark, sf_dir):
    return I.latest_ids(_second_run_log(spark, sf_dir)).select(ids_text("comps").alias("components"), F.col("found").alias("ufid"))


def q_contains_join(spark, sf_dir):
    a = _stitched(spark, sf_dir, "poly").associations
    src = poly(spark, sf_dir).select(F.col("ufid").alias("member"), "slot")
    return I.reverse_lookup(a).withColumnRenamed("component", "member").join(src, "member").select("ufid", "member", "slot")


def _joints(spark, sf_dir) -> S.StitchResult:
    """Lines that the first pass merges and the second one rejects."""
    return _memo("joints", spark, sf_dir, lambda: S.stitch_layer(D.joint_lines(D.read_table(spark, sf_dir, "supplier")), "ufid", "joints", kind="line", regions=regions(spark)))


def q_report_assoc_join(spark, sf_dir):
    """Composites of the first pass that the second one rejected, with what they were built from."""
    st = _joints(spark, sf_dir)
    return I.report_with_associations(st.report, st.associations).select("ref", "msg", "ufid", ids_text("ufid_components").alias("components"))


def q_fallback_join_ew(spark, sf_dir):
    """Members of groups that the second pass rejected: they go back as the first pass left them."""
    st = _joints(spark, sf_dir)
    own = st.interim.select("ufid", ids_text("ufid_components").alias("components"), G.num_points().alias("n_points"))
    refused = st.report.where(F.col("msg").contains("eastwest")).select(F.col("ref").alias("ufid"))
    return own.join(refused, "ufid", "left_semi")


# ---------------------------------------------------------------- plans
def q_identify_pass(spark, sf_dir):
    out = None
    for name, src, is_poly in (("poly", poly, True), ("line", line, False)):
        df = materialize(S.prepare(src(spark, sf_dir), "ufid", regions(spark)), "prepared")
        pairs = C.identify(df, "ufid", ["slot", "cls"], is_poly, C.NS).select(F.lit(name).alias("layer"), "merge_id", "drop_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def q_merge_pass(spark, sf_dir):
    out = _ns(spark, sf_dir, "poly").merge.layer
    return out.select(
        "ufid", "ogc_fid", F.size("ufid_components").cast("long").alias("n_components"), F.col("geom.gtype").alias("gtype"),
        _long(G.area()).alias("area"), _long(G.ymin()).alias("ymin"), _long(G.ymax()).alias("ymax"),
    )


def q_stitch_all(spark, sf_dir):
    """All layers of a store in one plan, published together; ids go on from the log of an earlier run."""
    folder = _layer_store(spark, sf_dir, "coast", "line", "poly")
    merged = _memo("merged", spark, sf_dir, lambda: runner.merge_store(spark, folder))
    done = runner.stitch_all(spark, folder, token="run", merged=merged)
    keys = {"coast": "coast_id", "line": "ufid", "poly": "ufid"}
    rows = [df.select(F.lit(n).alias("layer"), F.col(keys[n]).cast("long").alias("id"), F.size(F.array(*(F.col(c).cast("string") for c in df.columns if c != "geom"))).alias("n_columns")) for n, df in done.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    new = F.col("id") >= 100_000_000
    return every.groupBy("layer").agg(
        F.count(F.lit(1)).alias("features"), F.count(F.when(new, 1)).alias("composites"), F.min(F.when(new, F.col("id"))).alias("first_id"),
        F.max(F.when(new, F.col("id"))).alias("last_id"), F.sum(F.when(new, F.col("id"))).alias("id_sum"), F.max("n_columns").alias("n_columns"),
    )


class _Stop(Exception):
    pass


def q_publish_layers(spark, sf_dir):
    """Runs that stop after each of their writes, one that is repeated, and one that another run overtakes: what the store shows after each."""
    folder = _layer_store(spark, sf_dir, "coast", "line", "poly")
    merged = _memo("merged", spark, sf_dir, lambda: runner.merge_store(spark, folder))
    shown = []

    def show(step: str) -> None:
        now = commits.state(spark, folder)
        log = commits.read_log(spark, now, runner.ASSOCIATIONS, ASSOCIATIONS_SCHEMA)
        by_id = log.groupBy("ufid").agg(F.count_distinct("ufid_components").alias("n"))
        twice = by_id.agg(F.count(F.lit(1)).alias("ids"), F.count(F.when(F.col("n") > 1, 1)).alias("clashes"), F.max("ufid").alias("last_id"))
        logged = log.agg(F.count(F.lit(1)).alias("logged"))
        both = logged.crossJoin(twice)  # two one-row aggregates
        shown.append(both.select(F.lit(step).alias("step"), F.lit(now.version).cast("long").alias("version"), F.lit(len(now.layers)).cast("long").alias("layers"), "logged", "ids", "clashes", "last_id"))

    def stop_at(place: str):
        def check(step: str) -> None:
            if step == place:
                raise _Stop

        return check

    for place in ("layers", runner.ASSOCIATIONS, runner.REPORT):
        try:
            runner.publish(spark, folder, merged, "first", names=["coast"], before_commit=stop_at(place))
        except _Stop:
            show(f"stopped after {place}")
    runner.publish(spark, folder, merged, "first", names=["coast"])
    show("first")
    runner.publish(spark, folder, merged, "first", names=["coast"])
    show("repeated")

    def overtake(step: str) -> None:
        if step == runner.REPORT:
            runner.publish(spark, folder, merged, "other", names=["coast"])

    runner.publish(spark, folder, merged, "second", names=["line"], before_commit=overtake)
    show("overtaken")
    out = shown[0]
    for s in shown[1:]:
        out = out.unionByName(s)
    return out


def q_derive_irregular_edges(spark, sf_dir):
    return U.irregular_edges(U.sheet_footprints(poly(spark, sf_dir)))


def q_extent_hits_irregular(spark, sf_dir):
    out = None
    for n, df in (("line", line(spark, sf_dir)), ("poly", poly(spark, sf_dir))):
        r = U.extent_hits_irregular(df).select(F.lit(n).alias("layer"), "hits")
        out = r if out is None else out.unionByName(r)
    return out


def q_geometry_changed(spark, sf_dir):
    before = poly(spark, sf_dir)
    after = _ns(spark, sf_dir, "poly").merge.layer.select("ufid", "geom")
    return U.geometry_changed(before, after, "ufid").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_loop_removal(spark, sf_dir):
    """Multi-lines with loops of one path, of several, on each other and alone."""
    layer = D.looped_lines(D.read_table(spark, sf_dir, "orders"))
    return U.remove_loops(layer, "ufid").select("ufid", *_line_facts())


def q_triple_point_bypass(spark, sf_dir):
    layer = D.triple_point_lines(D.read_table(spark, sf_dir, "orders"))
    return U.triple_point_bypass(layer, "ufid").select("ufid", *_line_facts())


def q_import_process_export(spark, sf_dir):
    """A whole run over a folder with the polygon layer and its crop regions: import, stitch with key detection, dispatch and logs,
    export; the exported layer and the log are read back."""
    source, store = _folder(spark), _folder(spark)
    ST.write_layer(poly(spark, sf_dir), source, "poly")
    ST.write_layer(D.regions(spark), source, runner.REGIONS)
    runner.run(spark, source, store)
    out = spark.read.parquet(f"{source}_new/poly")
    log = runner.read_log(spark, store, runner.ASSOCIATIONS, ASSOCIATIONS_SCHEMA).groupBy("ufid").agg(F.count(F.lit(1)).alias("logged"))
    return out.join(log, "ufid", "left").groupBy("cls").agg(
        F.count(F.lit(1)).alias("features"), F.sum((F.col("ufid") >= 100_000_000).cast("long")).alias("composites"), F.count("logged").alias("logged"), _long(F.sum(G.area())).alias("area")
    )


def q_region_join_shapes(spark, sf_dir):
    """Regions that are no rectangles, and more of them than are written into a plan."""
    return region_join(poly(spark, sf_dir), D.shaped_regions(spark, sf_dir), "ufid")


def q_dissolve_overlaps(spark, sf_dir):
    """Union of members that overlap, repeat or lie apart."""
    g = M.dissolve_polygons(D.overlapping_members(D.read_table(spark, sf_dir, "orders")))
    return g.select(
        "comp", _long(G.area()).alias("area"), _long(G.xmin()).alias("xmin"), _long(G.ymin()).alias("ymin"), _long(G.xmax()).alias("xmax"), _long(G.ymax()).alias("ymax")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_layer_dir": q_scan_layer_dir,
    "layer_inventory": q_layer_inventory,
    "verify_copy": q_verify_copy,
    "wkt_ingest": q_wkt_ingest,
    "wkt_rejects": q_wkt_rejects,
    "assign_srid": q_assign_srid,
    "text_fidelity_check": q_text_fidelity_check,
    "select_except": q_select_except,
    "excise_column": q_excise_column,
    "on_northsouth": q_on_northsouth,
    "on_eastwest": q_on_eastwest,
    "on_nonstandard": q_on_nonstandard,
    "bbox_values": q_bbox_values,
    "boundary_flags": q_boundary_flags,
    "boundary_filter": q_boundary_filter,
    "snap_to_grid": q_snap_to_grid,
    "detect_key": q_detect_key,
    "geometry_type_dispatch": q_geometry_type_dispatch,
    "purge_minority_geometry": q_purge_minority_geometry,
    "region_join": q_region_join,
    "face_join": q_face_join,
    "attr_null_safe": q_attr_null_safe,
    "relate_polygons": q_relate_polygons,
    "relate_lines": q_relate_lines,
    "relate_near_polygons": q_relate_near_polygons,
    "relate_near_lines": q_relate_near_lines,
    "order_join_list": q_order_join_list,
    "unmerged_anti_join": q_unmerged_anti_join,
    "member_join": q_member_join,
    "fallback_join": q_fallback_join,
    "array_union_agg": q_array_union_agg,
    "connected_components": q_connected_components,
    "maximal_sets": q_maximal_sets,
    "merge_attributes": q_merge_attributes,
    "collect_geometry": q_collect_geometry,
    "dissolve_polygons": q_dissolve_polygons,
    "merge_lines": q_merge_lines,
    "layer_extent": q_layer_extent,
    "assemble_components": q_assemble_components,
    "duplicate_keys": q_duplicate_keys,
    "distinct_rows": q_distinct_rows,
    "normalise_ids": q_normalise_ids,
    "union_ids": q_union_ids,
    "union_merged_fallback": q_union_merged_fallback,
    "union_regions": q_union_regions,
    "region_join_shapes": q_region_join_shapes,
    "import_process_export": q_import_process_export,
    "dissolve_overlaps": q_dissolve_overlaps,
    "write_layer": q_write_layer,
    "scan_stored_layers": q_scan_stored_layers,
    "export_layer": q_export_layer,
    "link_views": q_link_views,
    "release_snapshot": q_release_snapshot,
    "revisioned_write": q_revisioned_write,
    "component_by_id": q_component_by_id,
    "stable_ids": q_stable_ids,
    "allocate_ids": q_allocate_ids,
    "assign_final_ids": q_assign_final_ids,
    "finalise_layer": q_finalise_layer,
    "stitch_layer": q_stitch_layer,
    "append_associations": q_append_associations,
    "append_report": q_append_report,
    "component_lookup": q_component_lookup,
    "duplicate_check": q_duplicate_check,
    "single_part_filter": q_single_part_filter,
    "drop_components": q_drop_components,
    "assoc_lookup": q_assoc_lookup,
    "contains_join": q_contains_join,
    "report_assoc_join": q_report_assoc_join,
    "fallback_join_ew": q_fallback_join_ew,
    "identify_pass": q_identify_pass,
    "merge_pass": q_merge_pass,
    "stitch_all": q_stitch_all,
    "publish_layers": q_publish_layers,
    "derive_irregular_edges": q_derive_irregular_edges,
    "extent_hits_irregular": q_extent_hits_irregular,
    "geometry_changed": q_geometry_changed,
    "loop_removal": q_loop_removal,
    "triple_point_bypass": q_triple_point_bypass,
}
