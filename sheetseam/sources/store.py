"""Layer stores: a folder with one Parquet folder/file per layer (any Hadoop file system).

Covers reading with name filters, overwriting writes, exports with WKT text,
copy verification, SRID metadata, column excision, view linking, snapshot
release, revisioned writes and the UTF-8 round-trip check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.schemas import DEFAULT_SRID, OUTPUT_PREFIX
from sheetseam.session import materialize
from sheetseam.sources import commits


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_layers(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """``(layer name, path)`` for each entry of ``folder`` (``x.parquet`` or a folder ``x`` of Parquet files), by name."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith((".", "_")):
            continue
        if st.isDirectory() and not list(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "*.parquet")) or []):
            continue  # a folder of layers, not a layer
        layer = name[: -len(".parquet")] if name.endswith(".parquet") else name
        out.append((layer, st.getPath().toString()))
    return sorted(out)


def _keep(name: str, filters) -> bool:
    return not filters or any(f in name for f in filters)


def all_layers(spark: SparkSession, folder: str, wanted=lambda name: True) -> dict[str, DataFrame]:
    """Layers of a folder by name: those written into it, and those published by commits (which come before a folder of the same name)."""
    published = {n: e for n, e in commits.state(spark, folder).layers.items() if wanted(n)}
    plain = {n: spark.read.parquet(p) for n, p in list_layers(spark, folder) if n not in published and wanted(n)}
    return dict(sorted((plain | {n: commits.read_layer(spark, e) for n, e in published.items()}).items()))


def read_stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One layer of a store."""
    found = all_layers(spark, folder, lambda n: n == name)
    if name not in found:
        raise FileNotFoundError(f"no layer {name} in {folder}")
    return found[name]


def scan_layer_dir(spark: SparkSession, folder: str, filters=None) -> dict[str, DataFrame]:
    """Every layer whose name contains any filter string (no filter: all)."""
    return all_layers(spark, folder, lambda n: _keep(n, filters))


def scan_stored_layers(spark: SparkSession, folder: str, filters=None) -> dict[str, DataFrame]:
    """Processed layers: name starts with ``new_`` and equals ``new_`` + a filter item."""
    exact = {OUTPUT_PREFIX + f for f in filters or ()}
    return all_layers(spark, folder, lambda n: n.startswith(OUTPUT_PREFIX) and (not filters or n in exact))


def tagged_union(layers: dict[str, DataFrame]) -> DataFrame:
    frames = [df.withColumn("layer", F.lit(n)) for n, df in sorted(layers.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_layer(df: DataFrame, folder: str, name: str, overwrite: bool = True) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def strip_prefix(name: str, prefix: str = OUTPUT_PREFIX) -> str:
    """Remove a real prefix (not a character set)."""
    return name[len(prefix):] if name.startswith(prefix) else name


def export_layer(df: DataFrame, source_folder: str, name: str, fmt: str = "parquet") -> str:
    """Write a result layer to ``<source>_new/<name without new_>``; text formats carry WKT."""
    target = f"{source_folder.rstrip('/')}_new/{strip_prefix(name)}"
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(target)
    else:
        out = df.withColumn("geom", G.to_wkt("geom")) if "geom" in df.columns else df
        getattr(out.write.mode("overwrite").option("header", True), fmt)(target)
    return target


def verify_copy(src: DataFrame, dst: DataFrame, src_name: str, dst_name: str, layers_grew: bool = True) -> DataFrame:
    """One row: do name, geometry type set and feature count agree after a copy?"""
    def side(df, tag):
        return df.agg(
            F.count(F.lit(1)).alias(f"{tag}_features"),
            F.sort_array(F.collect_set("geom.gtype")).alias(f"{tag}_types"),
        )

    j = side(src, "source").crossJoin(side(dst, "copy"))  # two single-row aggregates
    if layers_grew:
        name_ok = strip_prefix(dst_name) == strip_prefix(src_name)
    else:
        name_ok = dst_name == src_name
    return j.select(
        F.lit(name_ok).alias("name_ok"),
        (F.col("source_types") == F.col("copy_types")).alias("type_ok"),
        (F.col("source_features") == F.col("copy_features")).alias("count_ok"),
        "source_features",
        "copy_features",
    )


def ingest_wkt(df: DataFrame, wkt: str, geom: str = "geom") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Read geometry from text: the rows that have one, the rejected rows with their ``reason``, and the number of rows per outcome (``read`` or the kind of
    reason), counted by the one scan that writes both."""
    parsed = df.withColumn(geom, G.from_wkt(wkt)).withColumn("reason", G.wkt_reject(wkt, geom))
    kinds = {"read": F.col("reason").isNull(), **{k: F.col("reason") == k for k in ("no text", "empty", "broken")}, "type": F.col("reason").startswith("type ")}
    seen = Observation()
    kept = materialize(parsed.observe(seen, *(F.count(F.when(c, 1)).alias(k) for k, c in kinds.items())), "wkt")
    rejects = kept.where("reason IS NOT NULL").drop(geom)
    return kept.where("reason IS NULL").drop("reason", *({wkt} - {geom})), rejects, dict(seen.get)


def assign_srid(df: DataFrame, srid: int | None = None, geom: str = "geom") -> DataFrame:
    """Attach the EPSG code as column metadata (identified code, else the default)."""
    code = int(srid) if srid is not None else DEFAULT_SRID
    return df.withMetadata(geom, {"srid": code})


def srid_of(df: DataFrame, geom: str = "geom") -> int:
    return int(df.schema[geom].metadata.get("srid", DEFAULT_SRID))


def excise_column(spark: SparkSession, folder: str, column: str, filters=None, deep: bool = False) -> dict[str, DataFrame]:
    """Drop ``column`` from every layer of a folder (deep: also sub-folders, skipping ``_new``)."""
    out = {n: df.drop(column) for n, df in scan_layer_dir(spark, folder, filters).items()}
    if deep:
        fs, p = _fs(spark, folder)
        for st in fs.listStatus(p):
            sub = st.getPath()
            if st.isDirectory() and "_new" not in sub.getName() and not list(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(sub, "*.parquet")) or []):
                for n, df in excise_column(spark, sub.toString(), column, filters, deep=True).items():
                    out[f"{sub.getName()}/{n}"] = df
    return out


def link_views(spark: SparkSession, folder: str, prefix: str = "stitch_view_") -> list[str]:
    """A temp view ``<prefix><layer>`` for each stored ``new_`` layer; types come from Parquet."""
    names = []
    for n, df in scan_stored_layers(spark, folder).items():
        v = prefix + strip_prefix(n)
        df.createOrReplaceTempView(v)
        names.append(v)
    return names


def release_snapshot(spark: SparkSession, folder: str, target: str, link: bool = False, prefix: str = "stitch_view_") -> list[str]:
    """Materialise every linked view as a layer ``<target>/<layer>`` (overwrite)."""
    if link:
        link_views(spark, folder, prefix)
    out = []
    for t in spark.catalog.listTables():
        if t.isTemporary and t.name.startswith(prefix):
            layer = t.name[len(prefix):]
            spark.table(t.name).write.mode("overwrite").parquet(f"{target.rstrip('/')}/{layer}")
            out.append(layer)
    return sorted(out)


CREATED, COMPLETE = "created", "complete"


def _marks(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``revision_id, mark, comment, at``: when a revision was created and when it was completed."""
    place = f"{folder.rstrip('/')}/{name}__marks"
    fs, p = _fs(spark, place)
    schema = "revision_id long, mark string, comment string, at timestamp"
    return spark.read.schema(schema).parquet(place) if fs.exists(p) else spark.createDataFrame([], schema)


def _mark(spark: SparkSession, folder: str, name: str, revision: int, mark: str, comment: str) -> None:
    row = spark.range(1).select(F.lit(revision).cast("long").alias("revision_id"), F.lit(mark).alias("mark"), F.lit(comment).alias("comment"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{folder.rstrip('/')}/{name}__marks")


def create_revision(spark: SparkSession, folder: str, name: str, comment: str) -> int:
    """Open the next revision of a layer; what is written in it stays unseen until it is completed."""
    last = _marks(spark, folder, name).agg(F.max("revision_id").alias("m")).first()["m"]
    revision = 1 if last is None else last + 1
    _mark(spark, folder, name, revision, CREATED, comment)
    return revision


def write_in_revision(df: DataFrame, folder: str, name: str, revision: int, delete: bool = False) -> None:
    """Add rows to an open revision: new states of features, or (``delete``) the keys of features to remove."""
    extra = {"revision_id": F.lit(revision).cast("long"), "created": F.current_timestamp(), "deleted": F.lit(delete)}
    df.withColumns(extra).write.mode("append").parquet(f"{folder.rstrip('/')}/{name}__revisions")


def complete_revision(spark: SparkSession, folder: str, name: str, revision: int, comment: str = "") -> None:
    """Make a revision visible."""
    _mark(spark, folder, name, revision, COMPLETE, comment)


def revisioned_write(df: DataFrame, folder: str, name: str, revision: int, comment: str) -> str:
    """Write an edit as (part of) a revision and complete it."""
    write_in_revision(df, folder, name, revision)
    complete_revision(df.sparkSession, folder, name, revision, comment)
    return f"{folder.rstrip('/')}/{name}__revisions"


def read_as_of(spark: SparkSession, folder: str, name: str, key: str, revision: int) -> DataFrame:
    """State of a revisioned layer at ``revision``: one row per key, the latest of the completed revisions up to it; keys deleted last are gone."""
    complete = _marks(spark, folder, name).where((F.col("mark") == COMPLETE) & (F.col("revision_id") <= revision)).select("revision_id").distinct()
    hist = spark.read.option("mergeSchema", True).parquet(f"{folder.rstrip('/')}/{name}__revisions").join(complete, "revision_id", "left_semi")
    rest = [c for c in hist.columns if c not in (key, "created")]
    latest = hist.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("revision_id", "created")).alias("__row"))
    return latest.select(key, "__row.*").where("NOT deleted").select(*[c for c in hist.columns if c not in ("created", "deleted")])


_NON_ASCII = r"[^\x00-\x7F]"


def text_fidelity(before: DataFrame, after: DataFrame, key: str, text: str, flag: str | None = None) -> DataFrame:
    """Rows flagged as carrying non-ASCII text (``flag`` column = 'Y', else detected) whose text
    differs after a copy: ``(n_flagged, n_mismatch)``."""
    flagged = F.col(flag) == "Y" if flag else F.col(text).rlike(_NON_ASCII)
    digest = F.sha2(F.col(text).cast("binary"), 256)  # only flagged rows and digests are shuffled
    b = before.filter(flagged).select(F.col(key).alias("k"), digest.alias("b"))
    a = after.select(F.col(key).alias("k"), digest.alias("a"))
    j = b.join(a, "k", "left")
    return j.agg(F.count(F.lit(1)).alias("n_flagged"), F.coalesce(F.sum((~F.col("b").eqNullSafe(F.col("a"))).cast("long")), F.lit(0)).alias("n_mismatch"))


def utf8_roundtrip(df: DataFrame, text: str) -> DataFrame:
    """The text column encoded to UTF-8 bytes and decoded again (what a file copy does)."""
    return df.withColumn(text, F.decode(F.encode(F.col(text), "UTF-8"), "UTF-8"))


def text_copy(df: DataFrame, folder: str, name: str, key: str, text: str) -> DataFrame:
    """Key and text written as a JSON text file and read back."""
    path = export_layer(df.select(key, text), folder, name, "json")
    return df.sparkSession.read.schema(df.select(key, text).schema).json(path)
