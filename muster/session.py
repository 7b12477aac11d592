"""What the library takes from the running session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast when it has at most this many rows and takes so many bytes.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 << 20
_DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``df`` worked out now, and whether it is small enough to be broadcast.

    Rows and bytes of no more than ``BROADCAST_ROWS + 1`` rows are counted on Spark before
    any comes to the driver.  A small result becomes a local table; any other is written to
    the shared folder and read from there.
    """
    spark = df.sparkSession
    first = df.limit(BROADCAST_ROWS + 1)
    written = F.octet_length(F.to_json(F.struct(*[df[c] for c in df.columns])))
    size = first.select(written.alias("bytes")).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).first()
    if size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:
        return spark.createDataFrame(first.toArrow(), df.schema), True
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), False


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side whose size was checked; else leave the join to shuffle and
    to the adaptive skew split."""
    return F.broadcast(df) if small else df


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files when they are done.  Others leave them
    until the driver happens to collect its garbage, so that steps that are written one after
    the other take up the disk together."""
    before = spark.conf.get(_DROPS_SHUFFLES, None)
    spark.conf.set(_DROPS_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROPS_SHUFFLES)
        else:
            spark.conf.set(_DROPS_SHUFFLES, before)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the cluster.

    A folder of this machine is used only when no shared one is set and the
    session itself runs on this machine only.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="muster-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
