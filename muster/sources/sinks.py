"""Sinks: configuration texts and error reports (keyed snapshots are in ``snapshot``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_config(rendered: DataFrame, path: str) -> None:
    """Rendered texts, one folder per file name."""
    rendered.write.mode("overwrite").partitionBy("file").parquet(path)


def report(errors: DataFrame, target: str, batch_id: int | None = None) -> None:
    """Appends one record per failed item.

    With ``batch_id`` (from a stream) the batch has its own folder, and a batch that is
    delivered again does not report twice.
    """
    records = errors.select("object", "category", "message", "time")
    if batch_id is None:
        records.write.mode("append").parquet(target)
    else:
        records.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def report_of_watch(watch: DataFrame) -> DataFrame:
    """Report records of the failed events of a change stream."""
    message = F.concat(
        F.lit("change "), F.col("resource_version").cast("string"), F.lit(" of "), "kind", F.lit(" failed")
    )
    return watch.filter("change = 'ERROR'").select(
        F.col("owner").alias("object"),
        F.col("error_category").alias("category"),
        message.alias("message"),
        F.col("ts").alias("time"),
    )
