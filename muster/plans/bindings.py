"""Fleet tables derived from the star-schema test tables.

Orders become clusters, line items role groups, overrides and observations, and
events the change stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.catalog import local_table
from muster.schema import OWNED_KINDS, PRIMARY_KIND
from muster.session import work_dir
from muster.sources.watch import watch


# Of a line item: the role and the name of its role group.
_ROLE = (
    "CASE l_returnflag WHEN 'A' THEN 'master' WHEN 'N' THEN 'slave' ELSE 'history-server' END"
    " AS role"
)
# Never NULL, and known not to be: overrides of whole roles are found without reading those
# of groups.
_GROUP = "concat_ws('', 'g', CAST(l_linenumber AS STRING)) AS role_group"


class Fleet:
    """The tables below one folder of Parquet files, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def of_clusters(self, ids: DataFrame) -> Fleet:
        """The same tables with the line items of the clusters in ``ids`` only, which are left
        out before anything is aggregated: Spark does not move a small semi-join there."""
        some = Fleet(self.spark, self.folder)
        chosen = ids.select(F.col("cluster_id").alias("l_orderkey"))
        lines = self.table("lineitem").join(chosen, "l_orderkey", "left_semi")
        some._tables = {**self._tables, "lineitem": lines}
        return some

    def clusters(self) -> DataFrame:
        joined = self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        return joined.selectExpr(
            "o_orderkey AS cluster_id",
            "concat('c-', CAST(o_orderkey AS STRING)) AS cluster",
            "lower(c_mktsegment) AS namespace",
            """CASE o_orderkey % 6 WHEN 0 THEN '3.0.1-rel0' WHEN 1 THEN '3.1.1-rel0'
                 WHEN 2 THEN '1.4.1-rel0' WHEN 3 THEN '0.9.0' WHEN 4 THEN '3.1.1' END
               AS version""",
            "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS stopped",
            """CASE o_custkey % 4 WHEN 1 THEN 'secret' WHEN 2 THEN 'shrt'
                 WHEN 3 THEN concat('Secret_', CAST(o_custkey AS STRING)) END AS secret""",
            "CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 20 END AS max_port_retries",
        )

    def _line_items(self, *columns: str) -> DataFrame:
        """Line items with the role-group key, named before any grouping so that
        what is grouped by it stays partitioned by it."""
        return self.table("lineitem").selectExpr(
            "l_orderkey AS cluster_id", _ROLE, _GROUP, *columns
        )

    def role_groups(self) -> DataFrame:
        return (
            self._line_items("l_quantity", "l_suppkey")
            .groupBy("cluster_id", "role", "role_group")
            .agg(F.expr("CAST(sum(l_quantity) AS BIGINT) AS q"), F.expr("min(l_suppkey) AS s"))
            .selectExpr(
                "cluster_id",
                "role",
                "role_group",
                "CASE WHEN q % 11 <> 0 THEN CAST(q % 5 AS INT) END AS replicas",
                "CASE WHEN role = 'slave' AND s % 3 <> 0 THEN s % 16 + 1 END AS cores",
                """CASE WHEN role = 'slave' THEN concat(CAST(q AS STRING),
                     CASE s % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'm' WHEN 2 THEN 'G' ELSE ' kb' END)
                   END AS memory""",
                """CASE WHEN role = 'history-server' AND s % 2 = 0 THEN
                     concat('/data/history', CASE s % 3 WHEN 0 THEN '/' ELSE '/a' END)
                   END AS store_path""",
            )
        )

    def overrides(self) -> DataFrame:
        of_role = (
            self._line_items("l_linenumber")
            .filter("l_linenumber = 1")
            .select("cluster_id", "role")
            .distinct()
            .selectExpr(
                "cluster_id",
                "role",
                "CAST(NULL AS STRING) AS role_group",
                "2 AS layer",
                "'spark-defaults.conf' AS file",
                "'spark.port.maxRetries' AS prop",
                "'r1' AS value",
            )
        )
        of_group = (
            self._line_items("l_suppkey")
            .groupBy("cluster_id", "role", "role_group")
            .agg(F.max("l_suppkey").alias("s"))
            .withColumn("slot", F.expr("try_cast(substring(role_group, 2) AS INT) % 3"))
            .selectExpr(
                "cluster_id",
                "role",
                "role_group",
                "4 AS layer",
                "'spark-defaults.conf' AS file",
                """CASE slot WHEN 0 THEN 'spark.port.maxRetries' WHEN 1 THEN 'spark.eventLog.dir'
                     ELSE 'spark.driver.cores' END AS prop""",
                """CASE slot WHEN 0 THEN CAST(s % 32 AS STRING)
                     WHEN 1 THEN concat('/logs/', CAST(s AS STRING))
                     ELSE CAST(s % 8 AS STRING) END AS value""",
            )
        )
        return of_role.unionByName(of_group)

    def observed(self) -> DataFrame:
        number = F.regexp_replace("role_group", "^g7$", "g8")
        q, s = F.sum("l_quantity").cast("bigint"), F.min("l_suppkey")
        return (
            self._line_items("l_quantity", "l_suppkey", "l_linestatus")
            .filter("l_linestatus = 'F'")
            .withColumn("role_group", number)
            .groupBy("cluster_id", "role", "role_group")
            .agg(
                (q % 5).cast("int").alias("observed_replicas"),
                (q % 5 * (s % 2)).cast("int").alias("ready_replicas"),
            )
        )

    def watch_of(self, events: DataFrame) -> DataFrame:
        """The change stream out of events, batch or streaming."""
        kind, number = F.col("event_type"), F.col("event_id")
        return events.select(
            number.alias("resource_version"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("c-"), F.col("user_id").cast("string")).alias("owner"),
            F.when(kind == "view", "Service")
            .when(kind == "click", "ConfigMap")
            .when(kind == "purchase", "StatefulSet")
            .otherwise("SparkCluster")
            .alias("kind"),
            F.when(kind == "error", "ERROR")
            .when(kind == "signup", "ADDED")
            .otherwise("MODIFIED")
            .alias("change"),
            F.when(
                kind == "error",
                F.when(number % 3 == 0, "ApplyRoleGroupService")
                .when(number % 3 == 1, "InvalidProductConfig")
                .otherwise("SparkVersionParseFailure"),
            ).alias("error_category"),
            "value",
        )

    def watch(self) -> DataFrame:
        return self.watch_of(self.table("events"))

    def watch_stream(self, batches: int = 4) -> DataFrame:
        """Changes as they would arrive, from a folder per kind: in several micro-batches in
        the order of time, and some rows of each batch, over three hours old by then,
        delivered again with the next one.  Those of clusters have their name as owner."""
        changes = self.watch()
        us = F.unix_micros(F.col("ts"))
        cuts = changes.select(us.alias("us")).approxQuantile(
            "us", [i / batches for i in range(1, batches)], 0.001
        )
        number = F.lit(0)
        for cut in cuts:
            number = number + (us > F.lit(int(cut))).cast("int")
        numbered = changes.withColumn("batch", number)
        ends = F.get(F.array(*[F.lit(int(c)) for c in cuts]), F.col("batch"))
        again = numbered.filter((F.col("resource_version") % 50 == 7) & (us < ends - 3 * 3_600_000_000))
        again = again.withColumn("batch", F.col("batch") + 1)
        own = F.col("kind") == PRIMARY_KIND
        delivered = numbered.unionByName(again).withColumns(
            {"name": F.when(own, F.col("owner")), "owner": F.when(~own, F.col("owner"))}
        )
        path = work_dir(self.spark, "watch")
        for i in range(batches):
            part = by_kind(delivered.filter(F.col("batch") == i).drop("batch"))
            part.write.mode("append").partitionBy("kind").parquet(path)
        folders = {kind: f"{path}/kind={kind}" for kind in (PRIMARY_KIND, *OWNED_KINDS)}
        return watch(self.spark, folders, "parquet", maxFilesPerTrigger="1")

    def labels(self) -> DataFrame:
        """Long form of role-group labels; ``sized`` is there only on some."""
        pairs = F.array(
            _label(F.lit("role"), F.col("role")),
            _label(F.lit("group"), F.col("role_group")),
            _label(F.lit("sized"), F.when(F.col("cores").isNotNull(), "yes")),
        )
        return (
            self.role_groups()
            .select("cluster_id", "role", "role_group", F.inline(pairs))
            .filter("label_value IS NOT NULL")
        )

    def selectors(self) -> tuple[DataFrame, DataFrame]:
        """Selectors, and their expressions with one row per value."""
        return (
            local_table(self.spark, SELECTORS, "selector_id string,is_null boolean"),
            local_table(
                self.spark,
                SELECTOR_EXPRESSIONS,
                "selector_id string,expr_no int,label_key string,operator string,label_value string",
            ),
        )

    def packages(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            key.alias("package_id"),
            F.concat(
                F.concat_ws(
                    ".",
                    (size % 4).cast("string"),
                    size.cast("string"),
                    (key % 13).cast("string"),
                ),
                F.when(key % 3 == 0, "-nightly").otherwise(""),
            ).alias("version"),
        )

    def dependencies(self) -> DataFrame:
        return (
            self.table("lineitem")
            .filter((F.col("l_linenumber") == 1) & (F.col("l_partkey") != F.col("l_suppkey") * 25))
            .select(
                F.col("l_partkey").alias("package_id"),
                (F.col("l_suppkey") * 25).alias("depends_on"),
            )
            .distinct()
        )


def by_kind(changes: DataFrame) -> DataFrame:
    """Changes of a kind together, so that they become one file, and a batch of the stream of
    that kind; what they are made of is read, and kinds are written, by several tasks."""
    return changes.repartition("kind")


def _label(key: Column, value: Column) -> Column:
    return F.struct(key.alias("label_key"), value.alias("label_value"))


SELECTORS = [
    ("s_null", True),
    ("s_empty", False),
    ("s_in", False),
    ("s_notin", False),
    ("s_exists", False),
    ("s_absent", False),
    ("s_and", False),
]
SELECTOR_EXPRESSIONS = [
    ("s_in", 1, "group", "In", "g1"),
    ("s_in", 1, "group", "In", "g2"),
    ("s_notin", 1, "sized", "NotIn", "yes"),
    ("s_exists", 1, "sized", "Exists", None),
    ("s_absent", 1, "sized", "DoesNotExist", None),
    ("s_and", 1, "role", "In", "slave"),
    ("s_and", 2, "sized", "Exists", None),
    ("s_and", 3, "group", "NotIn", "g7"),
]
