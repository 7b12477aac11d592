"""Everything that keeps a cluster or a role group from being built, as one relation.

Each error is a row (cluster, object, category, message); nothing is dropped, and an object
may have several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.project import check_role, replicas_in_range, with_product_version
from muster.operators.state import union_kinds
from muster.schema import ERROR_CATEGORIES, REPLICAS_MAX

ERRORS = ["cluster", "object", "category", "message"]


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts])


def _entry(when: Column, category: str, message: Column) -> Column:
    """An array of one error where ``when`` holds, else of none."""
    entry = F.struct(F.lit(category).alias("category"), message.alias("message"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(entry)).otherwise(
        F.array().cast("array<struct<category:string,message:string>>")
    )


def cluster_errors(clusters: DataFrame) -> DataFrame:
    """A version that is missing or is none, and a missing namespace."""
    c = ERROR_CATEGORIES
    versioned = with_product_version(clusters)
    cluster, bad = F.col("cluster"), F.col("version_error")
    found = F.concat(
        _entry(bad == c["no_version"], c["no_version"], _text("cannot use version ", F.col("version"), " of ", cluster)),
        _entry(bad == c["bad_version"], c["bad_version"], _text("cannot use version ", F.col("version"), " of ", cluster)),
        _entry(F.col("namespace").isNull(), c["no_namespace"], _text(cluster, " has no namespace")),
    )
    return versioned.select("cluster", cluster.alias("object"), F.inline(found)).select(*ERRORS)


def group_errors(groups: DataFrame) -> DataFrame:
    """Of role groups with the columns of their cluster: a role nobody knows, a number of
    replicas out of range, a worker whose master has no address."""
    c = ERROR_CATEGORIES
    checked = check_role(groups)
    name = F.concat_ws("-", "cluster", "role", "role_group")
    found = F.concat(
        _entry(F.col("error").isNotNull(), c["bad_role"], F.col("error")),
        _entry(
            ~replicas_in_range(),
            c["bad_replicas"],
            _text("replicas ", F.col("replicas"), f" are not within 0 and {REPLICAS_MAX}"),
        ),
        _entry(
            (F.col("role") == "slave") & F.col("namespace").isNull(),
            c["no_master"],
            _text("the master of ", F.col("cluster"), " has no address"),
        ),
    )
    return checked.select("cluster", name.alias("object"), F.inline(found)).select(*ERRORS)


def config_errors(texts: DataFrame) -> DataFrame:
    """Of rows of ``config_map_columns`` with ``cluster``: files that cannot be written."""
    name = F.concat_ws("-", "cluster", "role", "role_group")
    return texts.filter("error IS NOT NULL").select(
        "cluster",
        name.alias("object"),
        F.col("error").alias("category"),
        _text("a file of ", name, " is not declared").alias("message"),
    )


def errors_of(clusters: DataFrame, role_groups: DataFrame) -> DataFrame:
    """All errors of clusters and of their role groups."""
    owners = clusters.select("cluster_id", "cluster", "namespace")
    return union_kinds(
        cluster_errors(clusters), group_errors(role_groups.join(owners, "cluster_id"))
    )
