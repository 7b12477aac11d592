"""Deduplication, coalescing, rates, and a graceful end of streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.sources.snapshot import apply_snapshot

# The trigger of a run that handles what is there, in as many batches as the source
# makes of it, and ends.
ONCE = {"availableNow": True}


def dedupe_stream(
    watch: DataFrame, keys: Sequence[str] = ("resource_version",), lateness: str = "1 hour"
) -> DataFrame:
    """A change that is delivered again within ``lateness`` is handled once."""
    return watch.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def latest_stream(watch: DataFrame, keys: Sequence[str] = ("owner",)) -> DataFrame:
    """The newest state per owner.  Older versions that arrive late change nothing.

    Run in update mode: each micro-batch emits the owners that changed.
    """
    rest = [c for c in watch.columns if c not in (*keys, "resource_version")]
    top = F.max_by(F.struct(*rest), "resource_version").alias("top")
    return (
        watch.groupBy(*keys)
        .agg(F.max("resource_version").alias("resource_version"), top)
        .select(*keys, "resource_version", "top.*")
    )


def error_rate(watch: DataFrame, width: str, lateness: str = "1 hour") -> DataFrame:
    """Errors by category and tumbling window, for a stream (update mode) or a table.

    Of a stream, a change that is delivered again within ``lateness`` counts once.
    """
    errors = watch.filter("change = 'ERROR'")
    if watch.isStreaming:
        errors = dedupe_stream(errors, lateness=lateness)
    return (
        errors.groupBy(F.window("ts", width), F.col("error_category").alias("category"))
        .agg(F.count("*").alias("n"))
        .select("category", F.col("window.start").alias("window_start"), "n")
    )


def upsert_stream(
    df: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    mode: str = "update",
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Applies every micro-batch of ``df`` to the snapshot at ``target``."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_snapshot(batch, target, keys, order, batch_id)

    return start(df, apply, checkpoint, mode, trigger or ONCE)


def start(
    df: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Runs ``df``: by default over all that is there, then ends; with another trigger,
    such as ``{"processingTime": "10 seconds"}``, until it is stopped."""
    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stop_stream(query: StreamingQuery, drain: bool = True) -> bool:
    """Ends a query after the data it has already seen; True if it ended cleanly.

    An error of the query is raised here rather than lost.
    """
    if drain and query.isActive:
        query.processAllAvailable()
    query.stop()
    failure = query.exception()
    if failure is not None:
        raise failure
    return not query.isActive
