"""Typed configuration to properties, and layers of properties to one value each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.schema import (
    ENV,
    KEY,
    LAYER_GROUP_CONFIG,
    LAYER_GROUP_OVERRIDE,
    LAYER_ROLE_CONFIG,
    LAYER_ROLE_OVERRIDE,
    MASTER_RPC_PORT,
    METRICS,
    ROLES,
    SPARK_DEFAULTS,
    SPARK_ENV,
)


@dataclass(frozen=True)
class Rule:
    """``value`` (SQL over a role-group row) sets ``prop`` of ``file`` for ``role``.

    A NULL value sets nothing.  ``role`` None means every role.
    """

    role: str | None
    file: str
    prop: str
    value: str
    layer: int


def _typed_config(prefix: str, layer: int) -> list[Rule]:
    return [
        Rule("slave", SPARK_ENV, "SPARK_WORKER_CORES", f"CAST({prefix}cores AS STRING)", layer),
        Rule("slave", SPARK_ENV, "SPARK_WORKER_MEMORY", f"{prefix}memory", layer),
        Rule(
            "history-server",
            SPARK_DEFAULTS,
            "spark.history.store.path",
            f"{prefix}store_path",
            layer,
        ),
    ]


# fixed values: which property each typed setting becomes
RULES: tuple[Rule, ...] = (
    Rule(None, SPARK_DEFAULTS, "spark.authenticate",
         "CASE WHEN secret IS NOT NULL THEN 'true' END", LAYER_ROLE_CONFIG),
    Rule(None, SPARK_DEFAULTS, "spark.authenticate.secret", "secret", LAYER_ROLE_CONFIG),
    Rule(None, SPARK_DEFAULTS, "spark.port.maxRetries",
         "CAST(coalesce(max_port_retries, 0) AS STRING)", LAYER_ROLE_CONFIG),
    Rule(None, METRICS, "*.sink.prometheusServlet.class",
         "'org.apache.spark.metrics.sink.PrometheusServlet'", LAYER_ROLE_CONFIG),
    Rule(None, METRICS, "*.sink.prometheusServlet.path", "'/metrics'", LAYER_ROLE_CONFIG),
    Rule(None, METRICS, "*.source.jvm.class",
         "'org.apache.spark.metrics.source.JvmSource'", LAYER_ROLE_CONFIG),
    Rule("master", ENV, "SPARK_MASTER_PORT", f"'{MASTER_RPC_PORT}'", LAYER_ROLE_CONFIG),
    *_typed_config("", LAYER_GROUP_CONFIG),
)
# The same settings made for a whole role, for rows that have them.
ROLE_LEVEL_RULES: tuple[Rule, ...] = tuple(_typed_config("role_", LAYER_ROLE_CONFIG))


def register_rule(
    role: str | None,
    file: str,
    prop: str,
    value: str,
    layer: int = LAYER_ROLE_CONFIG,
    rules: Sequence[Rule] = RULES,
) -> tuple[Rule, ...]:
    """``rules`` and one more.  The value is SQL over the row, so it stays in the JVM."""
    if role is not None and role not in ROLES:
        raise ValueError(f"unknown role {role!r}, should be one of {ROLES}")
    return (*rules, Rule(role, file, prop, value, layer))


# Fields in the order in which layers of a property are sorted to be merged.
PROPERTY_STRUCT = "array<struct<file:string,prop:string,layer:int,value:string>>"


def property_struct(layer: Column, file: Column, prop: Column, value: Column) -> Column:
    return F.struct(
        file.alias("file"),
        prop.alias("prop"),
        layer.cast("int").alias("layer"),
        value.alias("value"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _per_role(rules: Sequence[Rule], entry: Callable[[Rule], str], kind: str) -> Column:
    """An array of what ``entry`` makes of each rule of the row's role; one CASE per role
    keeps foreign rules from running."""

    def entries(role: str) -> str:
        texts = [entry(r) for r in rules if r.role in (None, role)]
        return f"WHEN {_literal(role)} THEN CAST(array({', '.join(texts)}) AS {kind})"

    return F.expr(f"CASE role {' '.join(entries(role) for role in ROLES)} END")


def derived_array(rules: Sequence[Rule] = RULES) -> Column:
    """All properties the rules set for one row, as an array of (file, prop, layer, value).

    What a rule leaves unset has a NULL value, and a NULL layer, which is below all others.
    It is for the caller to filter out after it has exploded the array, where the filter is
    compiled with the rest.
    """

    def entry(r: Rule) -> str:
        return (
            f"named_struct('file', {_literal(r.file)}, 'prop', {_literal(r.prop)}, 'layer', "
            f"CASE WHEN ({r.value}) IS NOT NULL THEN {r.layer} END, "
            f"'value', CAST({r.value} AS STRING))"
        )

    return _per_role(rules, entry, PROPERTY_STRUCT)


def derived_names(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the properties the rules set for one row, as an array; NULL for what a
    rule leaves unset."""

    def entry(r: Rule) -> str:
        return f"CASE WHEN ({r.value}) IS NOT NULL THEN {_literal(r.prop)} END"

    return _per_role(rules, entry, "array<string>")


def derive_properties(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per property that typed configuration sets: K, layer, file, prop, value."""
    rows = df.select(*KEY, F.inline(derived_array(rules))).filter("value IS NOT NULL")
    return rows.select(*KEY, "layer", "file", "prop", "value")


def override_array() -> Column:
    """The override maps that ``flatten_role_groups`` keeps in its rows, as an array of
    (file, prop, layer, value); a NULL value has a NULL layer, below all others."""
    no_files = F.create_map().cast("map<string,map<string,string>>")
    no_entries = F.create_map().cast("map<string,string>")

    def entries(of: Column, layer: int, file: Column) -> Column:
        return F.transform(
            F.map_entries(F.coalesce(of, no_entries)),
            lambda e: property_struct(
                F.when(e["value"].isNotNull(), F.lit(layer)), file, e["key"], e["value"]
            ),
        )

    def of_files(maps: str, layer: int) -> Column:
        per_file = F.transform(
            F.map_entries(F.coalesce(F.col(maps), no_files)),
            lambda f: entries(f["value"], layer, f["key"]).cast(PROPERTY_STRUCT),
        )
        return F.flatten(per_file)

    return F.concat(
        of_files("role_config_overrides", LAYER_ROLE_OVERRIDE),
        entries(F.col("role_env_overrides"), LAYER_ROLE_OVERRIDE, F.lit(ENV)).cast(PROPERTY_STRUCT),
        of_files("config_overrides", LAYER_GROUP_OVERRIDE),
        entries(F.col("env_overrides"), LAYER_GROUP_OVERRIDE, F.lit(ENV)).cast(PROPERTY_STRUCT),
    )


def merge_layers(long: DataFrame, keys: Sequence[str] = (*KEY, "file", "prop")) -> DataFrame:
    """The value of the highest layer for each key, and that layer.

    A NULL value sets nothing, so it never hides a lower layer; two values of one
    layer (two properties may imply a third) are settled by the greater text.  The
    whole key is the grouping key: rows of a role group, however many, spread over
    partitions and are combined before the shuffle.
    """
    return (
        long.filter("value IS NOT NULL")
        .groupBy(*keys)
        .agg(F.max(F.struct("layer", "value")).alias("top"))
        .select(*keys, "top.value", "top.layer")
    )
