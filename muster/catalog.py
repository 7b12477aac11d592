"""The property catalog: which properties exist, for whom, and with what values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.functions.checks import java_pattern_of
from muster.functions.versions import after_rank, version_rank
from muster.operators.properties import PROPERTY_STRUCT, property_struct
from muster.schema import ENV, LAYER_FILLED, LAYER_IMPLIED, LAYER_MISSING
from muster.session import broadcast_if, settled

# ---------------------------------------------------------------- fixed values
# The catalog this engine ships with.  Names, patterns, versions and values must
# be exactly these for derived configurations to be right.
UNITS = {
    "password": r"^[a-zA-Z]\w{5,20}$",
    "directory": r"^(.+)/([^/]+)$",
    "memory": r"(^\p{N}+)(?:\s*)((?:b|k|m|g|t|p|kb|mb|gb|tb|pb)\b$)",
}

# prop, kind, file, datatype, unit, as_of
PROPERTIES = [
    ("SPARK_WORKER_CORES", "file", "spark-env.sh", "integer", None, "0.6.2"),
    ("SPARK_WORKER_MEMORY", "file", "spark-env.sh", "string", "memory", "0.6.2"),
    ("SPARK_DAEMON_MEMORY", "file", "spark-env.sh", "string", "memory", "0.6.2"),
    ("spark.eventLog.enabled", "file", "spark-defaults.conf", "bool", None, "1.0.0"),
    ("spark.eventLog.dir", "file", "spark-defaults.conf", "string", "directory", "1.0.0"),
    ("spark.history.fs.logDirectory", "file", "spark-defaults.conf", "string", "directory", "1.1.0"),
    ("spark.history.store.path", "file", "spark-defaults.conf", "string", "directory", "2.3.0"),
    ("spark.authenticate", "file", "spark-defaults.conf", "bool", None, "1.0.0"),
    ("spark.authenticate.secret", "file", "spark-defaults.conf", "string", "password", "1.0.0"),
    ("spark.port.maxRetries", "file", "spark-defaults.conf", "integer", None, "1.1.1"),
    ("SPARK_NO_DAEMONIZE", "env", None, "bool", None, "2.0.0"),
    ("SPARK_CONF_DIR", "env", None, "string", None, "1.1.1"),
]

# prop, roles, required
PROPERTY_ROLES = [
    ("SPARK_WORKER_CORES", ["slave"], False),
    ("SPARK_WORKER_MEMORY", ["slave"], False),
    ("SPARK_DAEMON_MEMORY", ["master", "slave", "history-server"], False),
    ("spark.eventLog.enabled", ["master", "slave", "history-server"], False),
    ("spark.eventLog.dir", ["master", "slave"], False),
    ("spark.history.fs.logDirectory", ["history-server"], True),
    ("spark.history.store.path", ["history-server"], False),
    ("spark.authenticate", ["master", "slave", "history-server"], False),
    ("spark.authenticate.secret", ["master", "slave", "history-server"], False),
    ("spark.port.maxRetries", ["master", "slave", "history-server"], True),
    ("SPARK_NO_DAEMONIZE", ["master", "slave", "history-server"], True),
    ("SPARK_CONF_DIR", ["master", "slave", "history-server"], True),
]

# prop, value_kind, from_version, to_version (inclusive), value
PROPERTY_VALUES = [
    ("SPARK_DAEMON_MEMORY", "default", "0.6.2", "1.4.1", "512m"),
    ("SPARK_DAEMON_MEMORY", "default", "1.5.0", None, "1g"),
    ("spark.eventLog.enabled", "default", "1.0.0", None, "false"),
    ("spark.eventLog.enabled", "recommended", "1.0.0", None, "true"),
    ("spark.eventLog.dir", "default", "1.0.0", None, "/tmp/spark-events"),
    ("spark.eventLog.dir", "recommended", "1.0.0", None, "/stackable/log"),
    ("spark.history.fs.logDirectory", "default", "1.1.0", None, "/tmp/spark-events"),
    ("spark.history.fs.logDirectory", "recommended", "1.0.0", None, "/stackable/log"),
    ("spark.authenticate", "default", "1.0.0", None, "false"),
    ("spark.authenticate", "recommended", "1.0.0", None, "true"),
    ("spark.authenticate.secret", "recommended", "1.0.0", None, "secret"),
    ("spark.port.maxRetries", "default", "1.1.1", None, "16"),
    ("spark.port.maxRetries", "recommended", "1.1.1", None, "0"),
    ("SPARK_NO_DAEMONIZE", "recommended", "2.0.0", None, "true"),
    ("SPARK_CONF_DIR", "recommended", "1.1.1", None, "/stackable/config"),
]

# prop, expands_to, value
PROPERTY_EXPANSIONS = [
    ("spark.eventLog.dir", "spark.eventLog.enabled", "true"),
    ("spark.history.fs.logDirectory", "spark.eventLog.enabled", "true"),
    ("spark.authenticate.secret", "spark.authenticate", "true"),
]
# ------------------------------------------------------------------------------

UNIT_SCHEMA = "unit string, regex string"
PROPERTY_SCHEMA = (
    "prop string, kind string, file string, datatype string, unit string, as_of string"
)
ROLE_SCHEMA = "prop string, role string, required boolean"
VALUE_SCHEMA = (
    "prop string, value_kind string, from_version string, to_version string, value string"
)
EXPANSION_SCHEMA = "prop string, expands_to string, value string"


def property_role_rows() -> list[tuple[str, str, bool]]:
    return [(p, role, required) for p, roles, required in PROPERTY_ROLES for role in roles]


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table as a local relation, so that the optimizer knows its size."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {
        "string": pa.string(),
        "boolean": pa.bool_(),
        "int": pa.int32(),
        "bigint": pa.int64(),
    }
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[n for n, _ in fields]))


_RANGE_ARRAY = (
    "array<struct<preference:int,from_rank:string,to_rank:string,"
    "open_ended:boolean,range_value:string>>"
)


def _fill_array() -> Column:
    """Of ``required``, what a version of ``since_rank`` must have, with the value in
    force: the first of the sorted ranges that contains it.  No value in force:
    ``LAYER_MISSING``."""
    rank = F.col("since_rank")

    def in_force(r: Column) -> Column:
        return (r["from_rank"] <= rank) & (r["open_ended"] | (rank <= r["to_rank"]))

    def fill(p: Column) -> Column:
        value = F.get(F.filter(p["ranges"], in_force), F.lit(0))["range_value"]
        layer = F.when(value.isNull(), LAYER_MISSING).otherwise(LAYER_FILLED)
        return property_struct(layer, p["file"], p["prop"], value)

    wanted = F.filter("required", lambda p: p["as_of_rank"] <= rank)
    return F.transform(wanted, fill).cast(PROPERTY_STRUCT)


@dataclass(frozen=True)
class Catalog:
    """Five relations.

    ``units`` has the unit patterns where they are constants of the program: patterns
    belong into the plan then, where they are compiled once.  Of tables given by a user
    it is None, and the pattern is a column.

    What is derived from the relations is worked out once.  What turned out small, by
    rows and by bytes, becomes a local table and may be broadcast; anything else is
    written to the shared folder and joined by shuffle.
    """

    unit: DataFrame
    property: DataFrame
    property_role: DataFrame
    property_value: DataFrame
    property_expansion: DataFrame
    units: Mapping[str, str] | None = None
    _made: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)
    _small: set[str] = field(default_factory=set, repr=False, compare=False)

    @classmethod
    def of(
        cls,
        unit: DataFrame,
        property: DataFrame,
        property_role: DataFrame,
        property_value: DataFrame,
        property_expansion: DataFrame,
    ) -> Catalog:
        """A catalog over any five tables."""
        return cls(unit, property, property_role, property_value, property_expansion)

    @classmethod
    def built_in(cls, spark: SparkSession) -> Catalog:
        """The shipped catalog: a fixed 60 rows."""
        return cls(
            unit=local_table(spark, list(UNITS.items()), UNIT_SCHEMA),
            property=local_table(spark, PROPERTIES, PROPERTY_SCHEMA),
            property_role=local_table(spark, property_role_rows(), ROLE_SCHEMA),
            property_value=local_table(spark, PROPERTY_VALUES, VALUE_SCHEMA),
            property_expansion=local_table(spark, PROPERTY_EXPANSIONS, EXPANSION_SCHEMA),
            units=UNITS,
        )

    def side(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, taken from the derived table ``name``, as the side of a join."""
        return broadcast_if(df, name in self._small)

    def _frozen(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` makes of the catalog, worked out once."""
        if name not in self._made:
            df, local = settled(build(), name)
            self._made[name] = df
            if local:
                self._small.add(name)
        return self._made[name]

    def definitions(self) -> DataFrame:
        """One row per (prop, file): datatype, unit and its pattern, as_of_rank, roles."""
        return self._frozen("definitions", self._definitions)

    def ranges(self) -> DataFrame:
        """Default and recommended values with comparable bounds and preference
        (recommended before default, then the range that starts last), and the version
        that has the property at all."""
        return self._frozen("ranges", self._ranges)

    def required(self) -> DataFrame:
        """(role, prop, file, as_of_rank) of what each role must have."""
        return self._frozen("required", self._required)

    def fills(self) -> DataFrame:
        """(role, since_rank, until_rank, fills): what a role must have in versions from
        ``since_rank`` to before ``until_rank``, with the values to fill in."""
        return self._frozen("fills", self._fills)

    def implications(self) -> DataFrame:
        """Transitive closure of the expansions: (prop, role, file, implied, value)."""
        return self._frozen("implications", self._implications)

    def implied_by_trigger(self) -> DataFrame:
        """One row per (prop, role) that implies something: the implied properties."""
        return self._frozen("implied_by_trigger", self._implied_by_trigger)

    def implied_by_role(self) -> DataFrame:
        """One row per role: property to the properties it implies, as a map."""
        return self._frozen("implied_by_role", self._implied_by_role)

    def is_small(self, table: Callable[[], DataFrame], name: str) -> bool:
        """Whether a derived table turned out small; works it out if need be."""
        table()
        return name in self._small

    def _definitions(self) -> DataFrame:
        roles = self.property_role.groupBy("prop").agg(F.collect_set("role").alias("roles"))
        patterns = self.unit.select("unit", java_pattern_of(F.col("regex")).alias("pattern"))
        known = self.property.join(roles, "prop", "left").join(patterns, "unit", "left")
        return known.select(
            "prop",
            F.when(F.col("kind") == "env", F.lit(ENV)).otherwise(F.col("file")).alias("file"),
            "datatype",
            "unit",
            "pattern",
            version_rank(F.col("as_of")).alias("as_of_rank"),
            F.coalesce("roles", F.array().cast("array<string>")).alias("roles"),
        )

    def _ranges(self) -> DataFrame:
        as_of = self.definitions().select("prop", "as_of_rank")
        return self.property_value.join(as_of, "prop").select(
            "prop",
            "as_of_rank",
            "value_kind",
            F.col("value").alias("range_value"),
            version_rank(F.col("from_version")).alias("from_rank"),
            version_rank(F.col("to_version")).alias("to_rank"),
            F.col("to_version").isNull().alias("open_ended"),
            F.when(F.col("value_kind") == "recommended", 1).otherwise(0).alias("preference"),
        )

    def _required(self) -> DataFrame:
        wanted = self.property_role.filter("required").select("prop", "role")
        return wanted.join(self.definitions(), "prop").select(
            "role", "prop", "file", "as_of_rank"
        )

    def _fills(self) -> DataFrame:
        """Cuts the versions wherever something begins or ends for a role.  Between two
        cuts the values are the same, so the choice among ranges is made here, once,
        and a query just looks up the stretch its version lies in."""
        by_role = self._required_by_role()
        within = F.flatten(
            F.transform(
                "required",
                lambda p: F.flatten(
                    F.transform(
                        F.coalesce(p["ranges"], F.array().cast(_RANGE_ARRAY)),
                        lambda r: F.array(r["from_rank"], after_rank(r["to_rank"])),
                    )
                ),
            )
        )
        starts = F.transform("required", lambda p: p["as_of_rank"])
        cuts = by_role.select(
            "role", "required", F.explode(F.array_distinct(F.concat(starts, within))).alias("since_rank")
        ).filter("since_rank IS NOT NULL")
        following = F.lead("since_rank").over(Window.partitionBy("role").orderBy("since_rank"))
        return cuts.withColumn("until_rank", following).select(
            "role", "since_rank", "until_rank", _fill_array().alias("fills")
        )

    def _required_by_role(self) -> DataFrame:
        """One row per role: everything it must have, with value ranges."""
        value = F.struct("preference", "from_rank", "to_rank", "open_ended", "range_value")
        best_first = F.sort_array(F.collect_list(value), asc=False).alias("ranges")
        values = self.ranges().groupBy("prop").agg(best_first)
        entry = F.struct("file", "prop", "as_of_rank", "ranges")
        return (
            self.required()
            .join(values, "prop", "left")
            .groupBy("role")
            .agg(F.collect_list(entry).alias("required"))
        )

    def _implications(self) -> DataFrame:
        # Breadth first over the catalog alone, to a fixpoint: every round keeps the pairs
        # no shorter path has reached, so it ends for cycles too and never lists paths.
        # Where several paths of the shortest length lead to one property, the smallest
        # value counts.
        step = self.property_expansion
        least = F.min("value").alias("value")
        front, _ = settled(step.groupBy("prop", "expands_to").agg(least), "implied")
        reached = front
        while not front.isEmpty():
            onward = step.toDF(*[f"next_{c}" for c in step.columns])
            further = (
                front.join(onward, front["expands_to"] == onward["next_prop"])
                .groupBy("prop", "next_expands_to")
                .agg(F.min("next_value").alias("value"))
                .withColumnRenamed("next_expands_to", "expands_to")
            )
            front, _ = settled(further.join(reached, ["prop", "expands_to"], "left_anti"), "implied")
            reached, _ = settled(reached.unionByName(front), "implied")
        target = self.definitions().select(
            F.col("prop").alias("expands_to"), "file", F.explode("roles").alias("role")
        )
        return reached.join(target, "expands_to").select(
            "prop", "role", "file", F.col("expands_to").alias("implied"), "value"
        )

    def _implied_by_trigger(self) -> DataFrame:
        entry = property_struct(
            F.lit(LAYER_IMPLIED), F.col("file"), F.col("implied"), F.col("value")
        )
        return (
            self.implications()
            .groupBy("prop", "role")
            .agg(F.collect_list(entry).alias("implied_props"))
        )

    def _implied_by_role(self) -> DataFrame:
        entry = F.struct("prop", F.col("implied_props").cast(PROPERTY_STRUCT))
        implied = F.map_from_entries(F.collect_list(entry)).alias("implied")
        return self.implied_by_trigger().groupBy("role").agg(implied)
