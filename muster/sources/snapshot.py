"""A keyed snapshot that batches are applied to, and that costs little to read.

Every batch becomes a run, a folder of Parquet files dealt to buckets by a hash of the key.
When a level has ``FANOUT`` runs they are merged into one of the next level, in which each
key has its current row only, so a snapshot of n batches has at most ``FANOUT - 1`` runs on
each of about log(n) levels, and a row is rewritten once per level.  A manifest of one row
names the runs that count.  It is written to one of two places in turn, and the newest one
that is whole counts, so it moves from one state to the next or does not: a batch that fails
before leaves nothing behind that is read, and its next attempt overwrites it.  Batches come
in order from one writer; one that the manifest knows already is left out.

Runs are kept in twice ``FANOUT`` places per level and take turns, so a reader that still
has the manifest before the last sees its files, and no more than that is on disk.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from muster.operators.state import latest_per_key

FANOUT = 8
BUCKETS = 8
_MANIFEST = (
    "version long, last_batch long, made array<long>, runs array<struct<level: int, place: int>>, "
    "row string"
)
# Columns a run has besides those of its rows.
_OWN = ("run_level", "run_place", "run_bucket", "batch_id")


@dataclass(frozen=True)
class Manifest:
    """What counts: the last batch, how many runs each level ever had, the live ones,
    oldest first within their level, and the type of a row."""

    version: int = 0
    last_batch: int | None = None
    made: tuple[int, ...] = ()
    runs: tuple[tuple[int, int], ...] = ()
    row: str | None = None

    def place(self, level: int) -> int:
        """Where the next run of a level goes."""
        return (self.made[level] if level < len(self.made) else 0) % (2 * FANOUT)

    def add(self, level: int, batch: int | None, merged: Sequence[tuple[int, int]] = ()) -> Manifest:
        """With one more run on ``level`` in place of those merged into it."""
        made = [*self.made, *[0] * (level + 1 - len(self.made))]
        run = (level, self.place(level))
        made[level] += 1
        rest = tuple(r for r in self.runs if r not in merged)
        last = self.last_batch if batch is None else batch
        return Manifest(self.version + 1, last, tuple(made), (*rest, run), self.row)

    def full_level(self) -> tuple[int, list[tuple[int, int]]] | None:
        """The lowest level whose runs are to be merged."""
        for level in range(len(self.made)):
            runs = [r for r in self.runs if r[0] == level]
            if len(runs) >= FANOUT:
                return level, runs
        return None


def read_manifest(spark: SparkSession, target: str) -> Manifest:
    try:
        rows = spark.read.schema(_MANIFEST).json([f"{target}/manifest-*"]).collect()
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return Manifest()
    found = [
        Manifest(
            r.version, r.last_batch, tuple(r.made), tuple((x.level, x.place) for x in r.runs), r.row
        )
        for r in rows
        if r.version is not None
    ]
    return max(found, key=lambda m: m.version, default=Manifest())


def _write_manifest(spark: SparkSession, target: str, manifest: Manifest) -> None:
    row = (
        manifest.version, manifest.last_batch, list(manifest.made), list(manifest.runs), manifest.row,
    )
    (
        spark.createDataFrame([row], _MANIFEST)
        .coalesce(1)
        .write.mode("overwrite")
        .json(f"{target}/manifest-{manifest.version % 2}")
    )


def _path(target: str, run: tuple[int, int]) -> str:
    return f"{target}/run_level={run[0]}/run_place={run[1]}"


def _write_run(df: DataFrame, target: str, run: tuple[int, int], keys: Sequence[str]) -> None:
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    (
        df.withColumn("run_bucket", bucket)
        .repartition(BUCKETS, "run_bucket")
        .write.mode("overwrite")
        .partitionBy("run_bucket")
        .parquet(_path(target, run))
    )


def _read_runs(
    spark: SparkSession, target: str, manifest: Manifest, runs: Sequence[tuple[int, int]]
) -> DataFrame:
    row = StructType.fromJson(json.loads(manifest.row))
    paths = [_path(target, r) for r in runs]
    reader = spark.read.schema(row).option("basePath", target)
    return reader.parquet(*paths).select(row.fieldNames())


def apply_snapshot(
    df: DataFrame, target: str, keys: Sequence[str], order: Sequence[str], batch_id: int
) -> None:
    """Upserts ``df`` into the snapshot at ``target``; a batch applied before changes
    nothing.  A batch costs what it changes, and its share of the merges."""
    spark = df.sparkSession
    manifest = read_manifest(spark, target)
    if manifest.last_batch is not None and batch_id <= manifest.last_batch:
        return
    if set(_OWN) & set(df.columns):
        raise ValueError(f"rows of a snapshot have no columns {_OWN}")
    newest = latest_per_key(df, keys, order).withColumn("batch_id", F.lit(batch_id).cast("long"))
    _write_run(newest, target, (0, manifest.place(0)), keys)
    manifest = replace(manifest, row=newest.schema.json()).add(0, batch_id)
    _write_manifest(spark, target, manifest)
    merge_levels(spark, target, keys, order, manifest)


def merge_levels(
    spark: SparkSession,
    target: str,
    keys: Sequence[str],
    order: Sequence[str],
    manifest: Manifest | None = None,
) -> None:
    """Merges every level that is full into the next one."""
    manifest = manifest or read_manifest(spark, target)
    while full := manifest.full_level():
        level, runs = full
        rows = _read_runs(spark, target, manifest, runs)
        merged = latest_per_key(rows, keys, [*order, "batch_id"])
        _write_run(merged, target, (level + 1, manifest.place(level + 1)), keys)
        manifest = manifest.add(level + 1, None, runs)
        _write_manifest(spark, target, manifest)


def read_snapshot(
    spark: SparkSession,
    target: str,
    keys: Sequence[str],
    order: Sequence[str],
    schema: str | None = None,
) -> DataFrame:
    """The current row of each key: the greatest ``order``, then the latest batch.  Where
    nothing was applied so far there are no rows, of ``schema``."""
    manifest = read_manifest(spark, target)
    if not manifest.runs:
        if schema is None:
            raise FileNotFoundError(f"no snapshot at {target}")
        return spark.createDataFrame([], schema)
    rows = _read_runs(spark, target, manifest, manifest.runs)
    return latest_per_key(rows, keys, [*order, "batch_id"]).drop("batch_id")


def compact_snapshot(
    spark: SparkSession, source: str, target: str, keys: Sequence[str], order: Sequence[str]
) -> None:
    """Writes the current rows of ``source`` as the first batch of a new snapshot."""
    apply_snapshot(read_snapshot(spark, source, keys, order), target, keys, order, -1)
