"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import big_join, materialize, prepare_session

#: Rows per Arrow batch where the session does not set it; operators that hold more than a batch bound it by bytes themselves.
BATCH_ROWS = 1000
_ROWS_KEY, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ready(spark: SparkSession) -> SparkSession:
    """Package on the executors, checkpoint folder in place, small Arrow batches (unless the session chose a size)."""
    prepare_session(spark)
    if spark.conf.get(_ROWS_KEY) == _ROWS_DEFAULT:
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    return spark


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of a few large rows, for jobs that run inside."""
    before = spark.conf.get(_ROWS_KEY)
    spark.conf.set(_ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_KEY, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    return materialize(df, f"llm-{label}")


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


#: Rows of a table that may be broadcast; beyond them the same join sorts both sides.
SMALL_ROWS = 100_000


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a written table of short rows: broadcast if it was counted to be small (no hot key then), merged if not."""
    return left.join(F.broadcast(right), on, how) if right.count() <= SMALL_ROWS else big_join(left, right, on, how)


def shards(spark: SparkSession) -> int:
    """Number of shards for packed work: a few for each of the session's shuffle partitions (which grow with
    the input), so that one shard stays small and partitions even out."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
