"""Property catalog documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster import catalog as built_in
from muster.catalog import Catalog

_RANGES = "array<struct<fromVersion:string,to_version:string,value:string>>"
_PROPERTY = f"""struct<
  propertyNames: array<struct<name:string, kind:struct<type:string, file:string>>>,
  datatype: struct<type:string, unit:struct<name:string, regex:string>>,
  defaultValues: {_RANGES}, recommendedValues: {_RANGES},
  roles: array<struct<name:string, required:boolean>>,
  asOfVersion: string,
  expandsTo: array<struct<property:struct<propertyNames:array<struct<name:string>>>, value:string>>,
  description: string>"""
CATALOG_SCHEMA = f"""
  version string,
  spec struct<units: array<struct<unit:struct<name:string, regex:string>>>>,
  properties array<struct<property:{_PROPERTY}>>"""


def first_existing(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """JSON documents of the first path that exists, as one document per file."""
    for path in paths:
        try:
            return spark.read.schema(schema).option("multiLine", True).json(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no catalog at any of {list(paths)}")


def read_catalog(spark: SparkSession, paths: Sequence[str]) -> Catalog:
    """The catalog of the first path that exists, exploded to its five tables."""
    doc = first_existing(spark, paths, CATALOG_SCHEMA)
    unit = doc.select(F.inline("spec.units")).select("unit.name", "unit.regex").toDF("unit", "regex")
    prop = (
        doc.select(F.explode("properties.property").alias("p"))
        .withColumn("n", F.explode("p.propertyNames"))
        .withColumn("prop", F.col("n.name"))
    )

    def values(field: str, kind: str) -> DataFrame:
        return prop.select("prop", F.lit(kind).alias("value_kind"), F.inline(f"p.{field}")).select(
            "prop",
            "value_kind",
            F.col("fromVersion").alias("from_version"),
            "to_version",
            "value",
        )

    return Catalog.of(
        unit=unit,
        property=prop.select(
            "prop",
            F.col("n.kind.type").alias("kind"),
            F.col("n.kind.file").alias("file"),
            F.col("p.datatype.type").alias("datatype"),
            F.col("p.datatype.unit.name").alias("unit"),
            F.col("p.asOfVersion").alias("as_of"),
        ),
        property_role=prop.select("prop", F.inline("p.roles")).select(
            "prop", F.col("name").alias("role"), "required"
        ),
        property_value=values("defaultValues", "default").unionByName(
            values("recommendedValues", "recommended")
        ),
        property_expansion=prop.select("prop", F.inline("p.expandsTo")).select(
            "prop",
            F.explode("property.propertyNames.name").alias("expands_to"),
            "value",
        ),
    )


def catalog_document() -> dict:
    """The built-in catalog as a document ``read_catalog`` reads."""

    def ranges(prop: str, kind: str) -> list[dict]:
        rows = [v for v in built_in.PROPERTY_VALUES if v[0] == prop and v[1] == kind]
        return [{"fromVersion": f, "to_version": t, "value": v} for _, _, f, t, v in rows]

    def one(row: tuple) -> dict:
        prop, kind, file, datatype, unit, as_of = row
        roles = [
            {"name": r, "required": required}
            for p, r, required in built_in.property_role_rows()
            if p == prop
        ]
        expands = [
            {"property": {"propertyNames": [{"name": to}]}, "value": value}
            for p, to, value in built_in.PROPERTY_EXPANSIONS
            if p == prop
        ]
        return {
            "propertyNames": [{"name": prop, "kind": {"type": kind, "file": file}}],
            "datatype": {
                "type": datatype,
                "unit": unit and {"name": unit, "regex": built_in.UNITS[unit]},
            },
            "defaultValues": ranges(prop, "default"),
            "recommendedValues": ranges(prop, "recommended"),
            "roles": roles,
            "asOfVersion": as_of,
            "expandsTo": expands,
        }

    return {
        "version": "0.1.0",
        "spec": {"units": [{"unit": {"name": n, "regex": r}} for n, r in built_in.UNITS.items()]},
        "properties": [{"property": one(row)} for row in built_in.PROPERTIES],
    }
