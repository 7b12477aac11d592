"""Properties against the property catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.catalog import Catalog
from muster.functions.checks import fits_datatype, fits_unit
from muster.operators.properties import PROPERTY_STRUCT, property_struct
from muster.schema import (
    BUILT_IN_PROPERTIES,
    KEY,
    LAYER_MISSING,
    OVERRIDE_LAYERS,
    RESERVED_PORT_PROPERTIES,
)

def match_catalog(props: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds the definition of each row's (prop, file), and ``known`` / ``wrong_role``."""
    return (
        props.join(catalog.side(catalog.definitions(), "definitions"), ["prop", "file"], "left")
        .withColumn("known", F.col("roles").isNotNull())
        .withColumn(
            "wrong_role",
            F.coalesce(~F.array_contains("roles", F.col("role")), F.lit(False)),
        )
        .drop("roles")
    )


def _is_built_in() -> Column:
    pairs = ", ".join(f"('{prop}', '{file}')" for prop, file in BUILT_IN_PROPERTIES)
    return F.expr(f"(prop, file) IN ({pairs})")


def status(catalog: Catalog) -> Column:
    """The first test a matched property fails, or ``ok``.

    Reads ``layer``, ``value``, ``version_rank`` and what ``match_catalog`` adds.
    """
    value = F.col("value")
    reserved = F.col("layer").isin(OVERRIDE_LAYERS) & F.col("prop").isin(
        RESERVED_PORT_PROPERTIES
    )
    return (
        F.when(F.col("version_rank").isNull(), "invalid_version")
        .when(value.isNull(), "missing_required")
        .when(reserved, "reserved_port")
        .when(_is_built_in(), "ok")
        .when(~F.col("known"), "uncatalogued")
        .when(F.col("wrong_role"), "wrong_role")
        .when(F.col("as_of_rank") > F.col("version_rank"), "not_yet_available")
        .when(~fits_datatype(value, F.col("datatype")), "bad_type")
        .when(F.col("unit").isNotNull() & F.col("pattern").isNull(), "unknown_unit")
        .when(~fits_unit(value, F.col("unit"), catalog.units, F.col("pattern")), "bad_unit")
        .otherwise("ok")
    )


def values_for_version(props: DataFrame, catalog: Catalog) -> DataFrame:
    """The default and recommended values in force for each row's (prop, version_rank).

    An equi-join on the property with the version range as a further condition.
    ``available`` says whether the version has the property at all.
    """
    ranges = catalog.side(catalog.ranges(), "ranges")
    rank = F.col("version_rank")
    in_force = (F.col("from_rank") <= rank) & (F.col("open_ended") | (rank <= F.col("to_rank")))
    return (
        props.join(ranges, "prop")
        .filter(in_force)
        .withColumn("available", F.col("as_of_rank") <= rank)
        .drop("from_rank", "to_rank", "open_ended", "preference", "as_of_rank")
    )


def with_fills(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds ``fills``: what the row's role must have in its version, with values, as an
    array of (file, prop, layer, value).

    Of a small catalog the stretches of versions are broadcast and looked up row by row.  Of
    any other, each distinct (role, version) is answered once, and the answers are joined
    back, in several salts for each partition, since a few roles and versions have all the
    rows.
    """
    none = F.array().cast(PROPERTY_STRUCT)
    if not catalog.is_small(catalog.fills, "fills"):
        return _with_answers(df, catalog).withColumn("fills", F.coalesce("fills", none))
    ranges = catalog.side(catalog.fills().withColumnRenamed("role", "fill_role"), "fills")
    rank = F.col("version_rank")
    here = (
        (F.col("role") == F.col("fill_role"))
        & (F.col("since_rank") <= rank)
        & (F.col("until_rank").isNull() | (rank < F.col("until_rank")))
    )
    return (
        df.join(ranges, here, "left")
        .withColumn("fills", F.coalesce("fills", none))
        .drop("fill_role", "since_rank", "until_rank")
    )


def fills_of_versions(asked: DataFrame, catalog: Catalog) -> DataFrame:
    """(role, version_rank, fills) for distinct (role, version_rank): versions and cuts of a
    role in one order, and for each version the last cut at or before it."""
    cuts = catalog.fills().select(
        "role", F.col("since_rank").alias("version_rank"), F.lit(False).alias("asks"), "fills"
    )
    asks = asked.select("role", "version_rank", F.lit(True).alias("asks")).withColumn(
        "fills", F.lit(None).cast(cuts.schema["fills"].dataType)
    )
    upto = Window.partitionBy("role").orderBy("version_rank", "asks")
    found = F.last("fills", ignorenulls=True).over(
        upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cuts.unionByName(asks)
        .withColumn("found", found)
        .filter("asks")
        .select("role", "version_rank", F.col("found").alias("fills"))
    )


def _with_answers(df: DataFrame, catalog: Catalog) -> DataFrame:
    parts = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = df.select("role", "version_rank").filter("version_rank IS NOT NULL").distinct()
    answers = fills_of_versions(asked, catalog).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    salt = F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int")
    return df.withColumn("salt", salt).join(answers, ["role", "version_rank", "salt"], "left").drop("salt")


def expand_implied(
    props: DataFrame, catalog: Catalog, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``props`` and, below every other layer, what they imply.

    ``merge_layers`` afterwards lets explicit values win, so no anti-join is needed:
    an implied row survives exactly where nothing else sets its property.
    """
    own = property_struct(*[F.col(c) for c in ("layer", "file", "prop", "value")])
    none = F.array().cast(PROPERTY_STRUCT)
    implied = F.when(
        F.col("value").isNotNull(), F.col("implied_props").cast(PROPERTY_STRUCT)
    )
    rows = F.concat(F.array(own).cast(PROPERTY_STRUCT), F.coalesce(implied, none))
    triggers = catalog.side(catalog.implied_by_trigger(), "implied_by_trigger")
    entries = props.join(triggers, ["prop", "role"], "left").select(*KEY, *keep, F.inline(rows))
    return entries.select(*KEY, *keep, "layer", "file", "prop", "value")


def merge_and_check(long: DataFrame, catalog: Catalog) -> DataFrame:
    """The highest layer of each (K, file, prop) of ``long``, with its ``status``.

    Like ``merge_layers``, but a row of ``LAYER_MISSING`` survives where nothing else
    sets its property.
    """
    merged = (
        long.groupBy(*KEY, "file", "prop")
        .agg(
            F.max(F.struct("layer", "value")).alias("top"),
            F.max("version_rank").alias("version_rank"),
        )
        .select(*KEY, "file", "prop", "version_rank", "top.layer", "top.value")
    )
    return check_merged(merged, catalog)


def check_merged(merged: DataFrame, catalog: Catalog) -> DataFrame:
    """Merged properties (K, version_rank, file, prop, layer, value) with their ``status``."""
    layer = F.when(F.col("layer") != LAYER_MISSING, F.col("layer"))
    return (
        match_catalog(merged, catalog)
        .withColumn("status", status(catalog))
        .select(*KEY, "file", "prop", "value", layer.alias("layer"), "status")
    )
