"""Filters, flattening and derived columns: one row in, one (or a few) out.

None of these shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import names
from muster.functions.versions import product_version, version_rank
from muster.schema import (
    APP_NAME,
    ERROR_CATEGORIES,
    GLOBAL_GROUP,
    HTTP_PORT_OF_ROLE,
    MASTER_RPC_PORT,
    METRICS_PATH,
    REPLICAS_MAX,
    ROLES,
    SCRAPE_LABEL,
    SPEC_FIELD_OF_ROLE,
)


def in_namespace(df: DataFrame, namespace: str | None = None) -> DataFrame:
    """Rows of one namespace; all of them without one."""
    return df if namespace is None else df.filter(F.col("namespace") == namespace)


def _cluster_columns() -> dict[str, Column]:
    return {
        "cluster_id": F.col("metadata.uid"),
        "cluster": F.col("metadata.name"),
        "namespace": F.col("metadata.namespace"),
        "version": F.col("spec.version"),
        "stopped": F.col("spec.stopped"),
        "secret": F.col("spec.config.secret"),
        "max_port_retries": F.col("spec.config.maxPortRetries"),
    }


def clusters_of(specs: DataFrame) -> DataFrame:
    """The cluster-level columns of spec documents."""
    return specs.select(*[c.alias(n) for n, c in _cluster_columns().items()])


def flatten_role_groups(specs: DataFrame) -> DataFrame:
    """One row per role group of spec documents, with the columns of its cluster.

    An absent role or an empty ``roleGroups`` gives no row.  The three roles become
    one array that is exploded once, so documents are scanned once; overrides stay
    maps, and cluster columns ride along, so later steps need no join.
    """
    roles = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.col(f"spec.{field}.config").alias("role_config"),
                F.col(f"spec.{field}.configOverrides").alias("role_config_overrides"),
                F.col(f"spec.{field}.envOverrides").alias("role_env_overrides"),
                F.col(f"spec.{field}.roleGroups").alias("groups"),
            )
            for role, field in SPEC_FIELD_OF_ROLE.items()
        ]
    )
    cluster = _cluster_columns()
    per_role = specs.select(*[c.alias(n) for n, c in cluster.items()], F.inline(roles))
    per_group = per_role.select(
        *[c for c in per_role.columns if c != "groups"],
        F.explode("groups").alias("role_group", "g"),
    )
    return per_group.select(
        *cluster,
        "role",
        "role_group",
        F.col("g.replicas").alias("replicas"),
        F.col("g.config.cores").alias("cores"),
        F.col("g.config.memory").alias("memory"),
        F.col("g.config.storePath").alias("store_path"),
        F.col("role_config.cores").alias("role_cores"),
        F.col("role_config.memory").alias("role_memory"),
        F.col("role_config.storePath").alias("role_store_path"),
        F.col("g.selector").alias("selector"),
        "role_config_overrides",
        "role_env_overrides",
        F.col("g.configOverrides").alias("config_overrides"),
        F.col("g.envOverrides").alias("env_overrides"),
    )


def check_role(df: DataFrame, role: str = "role") -> DataFrame:
    """Adds ``error``: NULL for a known role, else a text that lists the known ones."""
    message = F.concat(
        F.lit("no role is called "),
        F.coalesce(F.col(role), F.lit("null")),
        F.lit(f"; there are {', '.join(ROLES)}"),
    )
    known = F.coalesce(F.col(role).isin(ROLES), F.lit(False))
    return df.withColumn("error", F.when(~known, message))


def with_product_version(df: DataFrame) -> DataFrame:
    """Adds ``product``, its rank, and ``version_error``: a missing version, or one
    that is not numeric."""
    product = product_version(F.col("version"))
    rank = version_rank(product)
    return df.withColumns(
        {
            "product": product,
            "version_rank": rank,
            "version_error": F.when(F.col("version").isNull(), F.lit(ERROR_CATEGORIES["no_version"])).when(
                rank.isNull(), F.lit(ERROR_CATEGORIES["bad_version"])
            ),
        }
    )


def effective_replicas(stopped: str = "stopped", replicas: str = "replicas") -> Column:
    """0 for a stopped cluster, else what was asked for, which may be nothing (NULL)."""
    return F.when(F.coalesce(F.col(stopped), F.lit(False)), F.lit(0)).otherwise(F.col(replicas))


def replicas_in_range(replicas: str = "replicas") -> Column:
    """Replica counts are unsigned 16-bit numbers."""
    return F.col(replicas).isNull() | F.col(replicas).between(0, REPLICAS_MAX)


def object_names(df: DataFrame) -> DataFrame:
    """Adds the names and addresses of a role group's service and its cluster's."""
    service = names.object_name(F.col("cluster"), F.col("role"), F.col("role_group"))
    everyone = names.global_service(F.col("cluster"))
    return df.withColumns(
        {
            "object_name": service,
            "service_fqdn": names.service_fqdn(service, F.col("namespace")),
            "global_service": everyone,
            "global_fqdn": names.service_fqdn(everyone, F.col("namespace")),
        }
    )


def expand_pods(df: DataFrame, respect_stopped: bool = False) -> DataFrame:
    """One row per pod to expect.  No replica count predicts no pod; ``stopped`` is
    looked at only on request.  A row without a namespace gives one row with
    ``error`` set and no pod."""
    wanted = effective_replicas() if respect_stopped else F.col("replicas")
    n = F.coalesce(wanted, F.lit(0))
    homeless = F.col("namespace").isNull()
    # sequence(0, -1) would count down, hence the guard.
    ordinals = (
        F.when(homeless, F.array(F.lit(None).cast("int")))
        .when(n > 0, F.sequence(F.lit(0), n - 1))
        .otherwise(F.array().cast("array<int>"))
    )
    service = names.object_name(F.col("cluster"), F.col("role"), F.col("role_group"))
    pods = df.select("*", service.alias("service"), F.explode(ordinals).alias("ordinal"))
    pod = F.concat(F.col("service"), F.lit("-"), F.col("ordinal").cast("string"))
    return pods.withColumns(
        {
            "pod": pod,
            "pod_fqdn": names.pod_fqdn(pod, F.col("service"), F.col("namespace")),
            "error": F.when(homeless, F.lit(ERROR_CATEGORIES["no_namespace"])),
        }
    )


def port_numbers() -> dict[str, list[tuple[str, int]]]:
    """The named ports of each role."""
    named = {role: [("http", HTTP_PORT_OF_ROLE[role])] for role in ROLES}
    named["master"].append(("rpc", MASTER_RPC_PORT))
    return named


def ports_of(role: Column) -> Column:
    """Array of (port_name, port): what the role's service and container expose."""
    ports = F.lit(None)
    for known, named in port_numbers().items():
        entries = [F.struct(F.lit(n).alias("port_name"), F.lit(p).alias("port")) for n, p in named]
        ports = F.when(role == known, F.array(*entries)).otherwise(ports)
    return ports


def endpoints(df: DataFrame) -> DataFrame:
    """One row per named TCP port of the row's role."""
    return df.select("*", F.inline(ports_of(F.col("role")))).withColumn(
        "protocol", F.lit("TCP")
    )


def start_command(df: DataFrame) -> DataFrame:
    """Adds ``command`` (words joined by a space), or ``error`` for a worker whose
    master has no address."""
    words = names.start_command(F.col("role"), F.col("cluster"), F.col("namespace"))
    return df.withColumns(
        {
            "command": F.array_join(words, " "),
            "error": F.when(words.isNull(), F.lit(ERROR_CATEGORIES["no_master"])),
        }
    )


def image_ref(df: DataFrame, registry: str) -> DataFrame:
    """Adds ``image``: the registry path and the full image version."""
    return df.withColumn("image", names.image(F.lit(registry), F.col("version")))


def labels_of(
    cluster: Column, version: Column, role: Column, role_group: Column
) -> dict[str, Column]:
    return {
        "name": F.lit(APP_NAME),
        "instance": cluster,
        "version": version,
        "component": role,
        "role-group": role_group,
    }


def label_columns(df: DataFrame) -> DataFrame:
    """Adds ``labels``, of a role group's objects and pods alike, and ``selector_labels``
    (all but the version) as maps."""

    def as_map(entries: dict[str, Column]) -> Column:
        return F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v)])

    every = labels_of(*[F.col(c) for c in ("cluster", "version", "role", "role_group")])
    subset = {k: v for k, v in every.items() if k != "version"}
    return df.withColumns({"labels": as_map(every), "selector_labels": as_map(subset)})


def global_label_columns(clusters: DataFrame) -> DataFrame:
    """The same for the service of a whole cluster: its masters in the group ``global``,
    which its selector leaves out."""
    masters = clusters.withColumns({"role": F.lit("master"), "role_group": F.lit(GLOBAL_GROUP)})
    return label_columns(masters).withColumn(
        "selector_labels", F.map_filter("selector_labels", lambda k, v: k != "role-group")
    )


def scrape_targets(objects: DataFrame) -> DataFrame:
    """Addresses a metrics collector polls.

    ``objects`` are services with ``labels`` and the columns ``expand_pods`` reads;
    only services that carry the scrape label are looked at.
    """
    scraped = objects.filter(F.col("labels")[SCRAPE_LABEL] == "true")
    pods = endpoints(expand_pods(scraped, respect_stopped=True).filter("error IS NULL"))
    target = F.concat(F.col("pod_fqdn"), F.lit(":"), F.col("port").cast("string"))
    return pods.filter("port_name = 'http'").withColumns(
        {"target": target, "path": F.lit(METRICS_PATH)}
    )
