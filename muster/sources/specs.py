"""Cluster spec documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.schema import SPEC, SPEC_FIELD_OF_ROLE

CORRUPT = "corrupt"


def read_specs(spark: SparkSession, path: str, corrupt: bool = False) -> DataFrame:
    """One row per JSON document (one per line), with the fixed schema.

    Fields the schema does not know are dropped, absent ones are NULL.  A line that is
    no document gives a row of NULLs; with ``corrupt`` its text is kept beside.
    """
    schema = SPEC
    reader = spark.read.option("mode", "PERMISSIVE")
    if corrupt:
        schema = T.StructType([*SPEC.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)


# A line that begins a YAML document, with the line end before it.
YAML_MARK = "\n---\n"


def yaml_loader() -> type:
    """The loader of plain data: libyaml's where PyYAML has it, several times faster."""
    import yaml

    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def yaml_to_json(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Lines of JSON (``value``) out of YAML files, one per YAML document, from what is there
    or as a stream of files.

    Spark reads the files cut at document marks, so one large file is read by many tasks
    and is in no memory whole.  What lies between two marks may still be several documents
    (a mark may be followed by a comment, or by a carriage return).  Directives are left out.
    """
    reader = spark.readStream if stream else spark.read
    texts = reader.option("lineSep", YAML_MARK).options(**options).text(path)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import re

        import yaml

        loader = yaml_loader()
        for batch in batches:
            plain = (re.sub(r"(?m)^%(YAML|TAG) .*$", "", text) for text in batch["value"])
            documents = (d for text in plain for d in yaml.load_all(text, loader))
            lines = [json.dumps(d) for d in documents if d is not None]
            yield pd.DataFrame({"value": pd.Series(lines, dtype="object")})

    return texts.mapInPandas(convert, "value string")


def parse_specs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Spec rows out of a column of JSON documents, each of which is parsed once: a filter on
    the rows would otherwise be moved below and parse them again."""
    return lines.select(F.explode(F.array(F.from_json(column, SPEC))).alias("doc")).select("doc.*")


def spec_documents(role_groups: DataFrame) -> DataFrame:
    """One spec row per cluster, with all its roles and role groups: the inverse of
    ``flatten_role_groups`` for rows that carry their cluster.  ``override_map`` of a role
    group and ``role_override_map`` of its role (both file -> prop -> value) are taken if
    present.

    Role groups meet in their cluster at once, since a document is one row: rows that were
    joined on ``cluster_id`` are not shuffled again.
    """
    group = SPEC["spec"].dataType["masters"].dataType["roleGroups"].dataType.valueType
    empty_overrides = F.lit(None).cast("map<string,map<string,string>>")

    def has(column: str) -> Column:
        return F.col(column) if column in role_groups.columns else empty_overrides

    config = F.struct(
        F.col("cores").cast("bigint").alias("cores"),
        F.col("memory").alias("memory"),
        F.col("store_path").alias("storePath"),
    )
    no_map = F.lit(None).cast("map<string,string>")
    body = F.struct(
        config.alias("config"),
        has("override_map").alias("configOverrides"),
        no_map.alias("envOverrides"),
        no_map.alias("cliOverrides"),
        F.col("replicas").alias("replicas"),
        F.lit(None).cast(group["selector"].dataType).alias("selector"),
    )
    cluster = ["cluster", "namespace", "version", "stopped", "secret", "max_port_retries"]
    if "cluster_id" in role_groups.columns:
        cluster = ["cluster_id", *cluster]
    member = F.struct(F.col("role_group"), body.alias("body"))
    whole = role_groups.groupBy(*cluster).agg(
        *[
            c
            for r, field in SPEC_FIELD_OF_ROLE.items()
            for c in (
                F.collect_list(F.when(F.col("role") == r, member)).alias(field),
                F.first(
                    F.when(F.col("role") == r, has("role_override_map")), ignorenulls=True
                ).alias(f"{field}_overrides"),
            )
        ]
    )

    def role(field: str) -> Column:
        held = F.struct(
            F.lit(None).cast(group["config"].dataType).alias("config"),
            F.col(f"{field}_overrides").alias("configOverrides"),
            no_map.alias("envOverrides"),
            no_map.alias("cliOverrides"),
            F.map_from_entries(field).alias("roleGroups"),
        )
        return F.when(F.size(field) > 0, held).alias(field)

    return whole.select(
        F.struct(
            F.col("cluster").alias("name"), F.col("namespace"), F.col("cluster").alias("uid")
        ).alias("metadata"),
        F.struct(
            F.col("version"),
            F.col("stopped"),
            F.struct(
                F.col("secret").alias("secret"),
                F.lit(None).cast("string").alias("logDir"),
                F.col("max_port_retries").cast("bigint").alias("maxPortRetries"),
            ).alias("config"),
            empty_overrides.alias("configOverrides"),
            no_map.alias("envOverrides"),
            no_map.alias("cliOverrides"),
            *[role(field) for field in SPEC_FIELD_OF_ROLE.values()],
        ).alias("spec"),
    )
