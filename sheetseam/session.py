"""Session helpers: configuration that matters at scale, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app: str = "sheetseam",
    driver_memory: str | None = None,
) -> SparkSession:
    """Build (or reuse) a session with AQE on.

    On a cluster the master and checkpoint folder come from the submit
    configuration; locally (tests, bench) we fill them in.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # never broadcast on the planner's guess (file size says nothing about exploded
        # geometry); AQE still broadcasts a side whose *measured* shuffle size is small
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
    )
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    prepare_session(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sheetseam`` importable in executor Python workers (grouped pandas steps).

    The package is zipped once per SparkContext and added with ``addPyFile``, which Spark copies
    to every executor; nothing else relies on the driver's working folder."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="sheetseam-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def prepare_session(spark: SparkSession) -> str:
    """Package shipped to executors and a reliable checkpoint folder in place."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    it is used as is.  Only when it is unset and the master is ``local`` a private folder
    under the system temp dir is created; elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sheetseam-ckpt-"))
    return sc.getCheckpointDir()


def spread(df):
    """Deal a table read from fewer splits than there are cores over all of them, so that per-row work does not
    run in a few tasks.  Such a table is small by its number of splits; larger ones are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_once(df, columns: dict):
    """``df`` with columns that are worked out once per row.

    They come out of a generator of one row, through which Spark moves no filter: below a plain projection a filter repeats the
    expression of a column for every mention of it, and geometry expressions are dear."""
    from pyspark.sql import functions as F

    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def big_join(left, right, on, how: str = "inner"):
    """Join two frames that both grow with the data: sort-merge, never a planner broadcast.

    The hint holds whatever the session's broadcast threshold is; AQE may still
    split skewed partitions of the sort-merge join.
    """
    return left.hint("merge").join(right, on, how)


def materialize(df, label: str = "t"):
    """Cut the lineage by writing ``df`` as Parquet under the checkpoint folder and reading it back.

    The folder is the shared one named by ``spark.checkpoint.dir`` (never a machine-local temp
    dir on a cluster); a lost executor re-reads files instead of recomputing the plan.  Parquet
    is compact for the nested geometry and gives the planner real sizes (a checkpointed frame keeps
    its plan's estimate, which multiplies over the rounds of a loop).  ``release`` removes the files.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheetseam/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*frames) -> None:
    """Remove the files of materialised frames that no later plan reads (others are left alone)."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            df._written_path = None
