"""Desired against observed state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import names
from muster.operators.project import effective_replicas, labels_of, port_numbers
from muster.schema import (
    APP_NAME,
    GLOBAL_GROUP,
    KEY,
    LOG_CLAIM_SIZE,
    PROBE_INITIAL_DELAY_SECONDS,
    PROBE_PERIOD_SECONDS,
    SCRAPE_LABEL,
)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key.

    An aggregate rather than a ranking window: it combines before the shuffle, so a
    key with very many versions sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("top")).select(*keys, "top.*").select(df.columns)


def diff_state(
    desired: DataFrame, observed: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """``create`` / ``update`` / ``noop`` / ``orphan`` per key.

    A desired replica count that is absent never causes an update; what is observed
    and not desired is reported and kept.
    """
    want = desired.select(*keys, "desired_replicas", F.lit(True).alias("wanted"))
    have = observed.select(*keys, "observed_replicas", F.lit(True).alias("seen"))
    same = F.col("desired_replicas").isNull() | F.col("desired_replicas").eqNullSafe(
        F.col("observed_replicas")
    )
    action = (
        F.when(F.col("seen").isNull(), "create")
        .when(F.col("wanted").isNull(), "orphan")
        .when(same, "noop")
        .otherwise("update")
    )
    return want.join(have, list(keys), "full_outer").select(
        *keys, "desired_replicas", "observed_replicas", action.alias("action")
    )


def owner_of(children: DataFrame, owners: DataFrame, owner: str = "owner") -> DataFrame:
    """Children with the columns of the object that owns them; strangers drop out."""
    return children.join(owners, children[owner] == owners["cluster"]).drop(owners["cluster"])


def check_expectations(
    expected: DataFrame, observed: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """``pass`` / ``mismatch`` / ``missing`` for each expectation.

    Only the columns an expectation states (not NULL) are compared.  Both sides carry
    ``columns`` under the same names.
    """
    seen = observed.select(
        *keys, *[F.col(c).alias(f"seen_{c}") for c in columns], F.lit(True).alias("seen")
    )
    agrees = F.lit(True)
    for c in columns:
        agrees = agrees & (F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"seen_{c}")))
    result = (
        F.when(F.col("seen").isNull(), "missing").when(agrees, "pass").otherwise("mismatch")
    )
    return expected.join(seen, list(keys), "left").withColumn("result", result).drop("seen")


def readiness(pods: DataFrame) -> DataFrame:
    """Per role group: pods, ready pods, and whether all are ready.

    A row with a NULL ``ordinal`` stands for a group without pods.
    """
    ready = F.count_if(F.col("ready") & F.col("ordinal").isNotNull())
    return pods.groupBy(*KEY).agg(
        F.count("ordinal").alias("replicas"),
        ready.alias("ready_replicas"),
        (F.count("ordinal") == ready).alias("all_ready"),
    )


def error_counts(report: DataFrame, category: str = "category") -> DataFrame:
    return report.groupBy(category).agg(F.count("*").alias("n"))


def _ports(role: Column, number: str = "port") -> Column:
    """What ``ports_of`` exposes as an object writes it; constants, so that no row works
    them out."""
    ports = F.lit(None)
    for known, named in port_numbers().items():
        entries = [
            F.struct(F.lit(name).alias("name"), F.lit(port).alias(number), F.lit("TCP").alias("protocol"))
            for name, port in named
        ]
        ports = F.when(role == known, F.array(*entries)).otherwise(ports)
    return ports


def _labels(role: Column, role_group: Column, scrape: bool = False) -> Column:
    """The labels of an object, the version among them, in a fixed order."""
    every = labels_of(F.col("cluster"), F.col("version"), role, role_group)
    parts = [value.alias(name) for name, value in every.items()]
    if scrape:
        parts.append(F.lit("true").alias(SCRAPE_LABEL))
    return F.struct(*parts)


def _probe() -> Column:
    """Asks the port called ``http``; readiness and liveness are probed alike."""
    return F.struct(
        F.struct(F.lit("http").alias("port")).alias("httpGet"),
        F.lit(PROBE_INITIAL_DELAY_SECONDS).alias("initialDelaySeconds"),
        F.lit(PROBE_PERIOD_SECONDS).alias("periodSeconds"),
    )


def _selector(role_group: Column | None) -> Column:
    parts = [
        F.lit(APP_NAME).alias("name"),
        F.col("cluster").alias("instance"),
        F.col("role").alias("component"),
    ]
    if role_group is not None:
        parts.append(role_group.alias("role-group"))
    return F.struct(*parts)


_OBJECT = ["kind", "namespace", "name", "cluster_id", "owner", "component", "role_group",
           "version", "scrape", "labels", "spec"]


def _objects(df: DataFrame, kind: str, name: Column, role_group: Column, scrape: bool,
             spec: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"),
        F.col("namespace"),
        name.alias("name"),
        "cluster_id",
        F.col("cluster").alias("owner"),
        F.col("role").alias("component"),
        role_group.alias("role_group"),
        "version",
        (F.lit("true") if scrape else F.lit(None).cast("string")).alias("scrape"),
        F.to_json(_labels(F.col("role"), role_group, scrape)).alias("labels"),
        F.to_json(spec).alias("spec"),
    )


def global_services(clusters: DataFrame) -> DataFrame:
    """The one service per cluster that clients use."""
    masters = clusters.filter("version IS NOT NULL").withColumn("role", F.lit("master"))
    spec = F.struct(
        F.lit("NodePort").alias("type"),
        _ports(F.col("role")).alias("ports"),
        _selector(None).alias("selector"),
    )
    return _objects(
        masters, "Service", names.global_service(F.col("cluster")), F.lit(GLOBAL_GROUP), False, spec
    )


def role_group_objects(
    groups: DataFrame, registry: str, conf_dir: str, log_dir: str
) -> DataFrame:
    """Service, ConfigMap and StatefulSet of each role group, from one scan.

    ``groups`` are role groups with their cluster's columns, ``env`` (array of
    name/value) and the three file texts of ``config_maps``.  Pods mount the configuration
    at ``conf_dir`` and a claim of their own at ``log_dir``.
    """
    group = F.col("role_group")
    name = names.object_name(F.col("cluster"), F.col("role"), group)
    service = F.struct(
        F.lit("None").alias("clusterIP"),
        _ports(F.col("role")).alias("ports"),
        _selector(group).alias("selector"),
        F.lit(True).alias("publishNotReadyAddresses"),
    )
    config = F.struct(
        F.struct(
            F.col("spark_defaults").alias("spark-defaults.conf"),
            F.col("spark_env").alias("spark-env.sh"),
            F.col("metrics").alias("metrics.properties"),
        ).alias("data")
    )
    replica_set = F.struct(
        F.lit("Parallel").alias("podManagementPolicy"),
        effective_replicas().alias("replicas"),
        name.alias("serviceName"),
        _selector(group).alias("selector"),
        names.image(F.lit(registry), F.col("version")).alias("image"),
        names.start_command(F.col("role"), F.col("cluster"), F.col("namespace")).alias("args"),
        F.col("env").alias("env"),
        _ports(F.col("role"), "containerPort").alias("ports"),
        _probe().alias("readinessProbe"),
        _probe().alias("livenessProbe"),
        F.array(
            F.struct(F.lit("log").alias("name"), F.lit(log_dir).alias("mountPath")),
            F.struct(F.lit("config").alias("name"), F.lit(conf_dir).alias("mountPath")),
        ).alias("volumeMounts"),
        _labels(F.col("role"), group).alias("podLabels"),
        F.array(F.struct(F.lit("config").alias("name"), name.alias("configMap"))).alias("volumes"),
        F.array(
            F.struct(
                F.lit("log").alias("name"),
                F.array(F.lit("ReadWriteOnce")).alias("accessModes"),
                F.lit(LOG_CLAIM_SIZE).alias("storage"),
            )
        ).alias("volumeClaimTemplates"),
    )
    # Texts are made in a projection, which is compiled; a generator is not if anything in it
    # is interpreted.
    kinds = {"Service": ("true", service), "ConfigMap": (None, config), "StatefulSet": (None, replica_set)}
    written = groups.filter("version IS NOT NULL").select(
        "namespace",
        name.alias("name"),
        "cluster_id",
        F.col("cluster").alias("owner"),
        F.col("role").alias("component"),
        "role_group",
        "version",
        F.to_json(_labels(F.col("role"), group)).alias("plain"),
        F.to_json(_labels(F.col("role"), group, True)).alias("scraped"),
        *[F.to_json(spec).alias(f"of_{kind}") for kind, (_, spec) in kinds.items()],
    )
    each = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(scrape).cast("string").alias("scrape"),
                F.col("plain" if scrape is None else "scraped").alias("labels"),
                F.col(f"of_{kind}").alias("spec"),
            )
            for kind, (scrape, _) in kinds.items()
        ]
    )
    return written.select("*", F.inline(each)).select(*_OBJECT)


def union_kinds(*relations: DataFrame) -> DataFrame:
    """One relation out of several kinds of objects; columns a kind lacks are NULL."""
    out = relations[0]
    for more in relations[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
