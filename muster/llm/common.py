"""Helpers the operators of this package share.

Words are maximal runs of anything but ASCII white space.  Intermediate tables go to the
folder all executors share, never to a machine's own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.session import work_dir

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """The words of a text in order; of NULL none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` loops over it."""
    return F.transform(F.array(value), body)[0]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return functools.reduce(
        lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names]
    )


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], name: str
) -> DataFrame:
    """Add, for each value, its sum over earlier rows of the same group and over the group.

    Rows are dealt by range of (group, order), so a group of any size spans many
    partitions; per-partition totals, one row for each group and partition, give the
    offsets.  Adds ``<value>_before`` and ``<value>_total``.  Rows equal in ``order`` take
    any order among themselves, which is then fixed by the written table.
    """
    by, order, values = list(by), list(order), list(values)
    df = settle(df.withColumn("_tie", F.monotonically_increasing_id()), name)
    keys = [*by, *order, "_tie"]
    ranged = settle(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name
    )
    totals = ranged.groupBy(*by, "_part").agg(
        *[F.sum(v).alias(f"_sum_{v}") for v in values]
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_part",
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(group).alias(f"{v}_total") for v in values],
    )
    here = (
        Window.partitionBy(*by, "_part")
        .orderBy(*order, "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = ranged.select(
        "*", *[F.coalesce(F.sum(v).over(here), F.lit(0)).alias(f"_in_{v}") for v in values]
    )
    joined = rows.join(offsets, _same(rows, offsets, [*by, "_part"]))
    return joined.select(
        *[rows[c] for c in df.columns if c != "_tie"],
        *[(rows[f"_in_{v}"] + offsets[f"_off_{v}"]).alias(f"{v}_before") for v in values],
        *[offsets[f"{v}_total"] for v in values],
    )
