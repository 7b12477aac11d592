"""Contiguous shards of nearly equal byte size.

Documents are put in order of their id, sizes are summed over all that come before (from
the totals of range partitions, see ``running_totals``), and the line of bytes is cut at
equal targets.  A document belongs to the shard its middle byte lies in, so a shard
differs from its target by half a document at each end at most.

NULL text counts as empty; NULL ids come first; equal rows are interchangeable; empty
tables give no rows; more shards than documents leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import named, running_totals, settle


def assign_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    The size is the text's UTF-8 bytes plus 1.  Only ids, sizes and checksums are
    shuffled, never texts.  Other columns of ``docs`` are not read.
    """
    return _assigned(docs, shards, id_col, text_col)


def _assigned(
    docs: DataFrame, shards: int, id_col: str, text_col: str, row: str | None = None
) -> DataFrame:
    """The same, with a number of the row as ``row`` if ``docs`` has a column of that name."""
    extra = ["row"] if row else []
    text = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(
        named(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
        *[named(row).alias("row") for _ in extra],
    )
    placed = running_totals(rows, [], ["doc_id", "size", "text_crc32"], ["size", "one"], "shard")
    placed = settle(
        placed.select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(
                F.lit(shards - 1),
                F.expr(f"({shards} * (2 * size_before + size)) div (2 * size_total)"),
            ).cast("int").alias("shard"),
            F.col("one_before").alias("place"),
            *extra,
        ),
        "shard",
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), *extra
    )


def cut_points(assigned: DataFrame) -> DataFrame:
    """The first and last id of each shard, its documents and its bytes: one row per shard."""
    return assigned.groupBy("shard").agg(
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
        F.count("*").alias("documents"),
        F.sum("size").alias("bytes"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents below ``path``/shard=N, each shard as ``files`` files or so.

    Rows go where ``assign_shards`` puts them, also those that share an id or have none; for
    that the documents are written once to the shared folder, with a number for each row.
    A column ``shard`` of the documents is replaced.
    """
    row, slot = _unused(docs, "_row"), _unused(docs, "_slot")
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    places = _assigned(rows, shards, id_col, text_col, row).select(
        F.col("row").alias(row), "shard", F.col("slot").alias(slot)
    )
    (
        rows.drop("shard")
        .join(places, row)
        .drop(row)
        .repartitionByRange(max(1, shards * files), "shard", slot)
        .sortWithinPartitions("shard", slot)
        .drop(slot)
        .write.partitionBy("shard")
        .parquet(path)
    )


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
