"""The stream of change events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.operators.state import union_kinds
from muster.schema import WATCH


def watch(
    spark: SparkSession, paths: Mapping[str, str], format: str = "json", **options: str
) -> DataFrame:
    """One change stream out of a folder per kind, each event with its owner.

    An event of the primary kind is owned by the object itself, so its ``owner`` may be
    left out of the file in favour of ``name``.
    """
    schema = T.StructType([*WATCH.fields, T.StructField("name", T.StringType())])
    streams = []
    for kind, path in paths.items():
        events = spark.readStream.schema(schema).format(format).options(**options).load(path)
        streams.append(
            events.withColumns(
                {"kind": F.lit(kind), "owner": F.coalesce("owner", "name")}
            ).drop("name")
        )
    return union_kinds(*streams)
