"""Test matrices, package versions and their dependencies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.versions import bump
from muster.session import settled

_PARTS = 64


def scenario_grid(dimensions: DataFrame, tests: DataFrame) -> DataFrame:
    """(test, scenario) for each combination of the dimensions a test names.

    ``dimensions`` (dim, value) and ``tests`` (test, dims: array in naming order).
    One equi-join on the dimension's name per position, up to the longest list; a test
    that names an unknown dimension has no scenario.

    Dimensions are few names, so a shuffle on the name alone would use few tasks: a
    small table of values is broadcast, a large one is split by a hash of the value,
    and each grid row visits every part.
    """
    depth = tests.agg(F.max(F.size("dims"))).first()[0] or 0
    values, small = settled(dimensions.select("dim", "value"), "dimensions")
    if not small:
        values = values.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(_PARTS)).cast("int"))
    grid = tests.select("test", "dims", F.array().cast("array<string>").alias("parts"))
    for i in range(depth):
        here = F.get("dims", F.lit(i))
        ended = grid.filter(here.isNull())
        named = grid.withColumn("dim", here)
        if small:
            met = named.join(F.broadcast(values), "dim")
        else:
            every = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))
            met = named.withColumn("part", every).join(values, ["dim", "part"])
        more = met.select(
            "test",
            "dims",
            F.array_append("parts", F.concat("dim", F.lit("-"), "value")).alias("parts"),
        )
        grid = ended.unionByName(more)
    return grid.select("test", F.array_join("parts", "_").alias("scenario"))


def bump_version(packages: DataFrame, level: str, tag: str = "nightly") -> DataFrame:
    """Packages with ``new_version``, their version raised at ``level``, and
    ``version_error`` where that cannot be done."""
    raised = bump(F.col("version"), level, tag)
    return packages.withColumns(
        {
            "new_version": raised,
            "version_error": F.when(raised.isNull(), F.lit("invalid_version")),
        }
    )


def set_version(packages: DataFrame, version: str) -> DataFrame:
    """Packages with ``new_version`` set to one version, which must be one."""
    if not re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+([-+][0-9A-Za-z.+-]+)?", version):
        raise ValueError(f"not a version: {version!r}")
    return packages.withColumn("new_version", F.lit(version))


def propagate_versions(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Each dependency inside the set with the new version of its target.

    Both ends must be packages of the set.
    """
    targets = packages.select(
        F.col("package_id").alias("depends_on"), F.col("new_version").alias("dependency_version")
    )
    inside = dependencies.join(packages.select("package_id"), "package_id", "left_semi")
    return inside.join(targets, "depends_on").select(
        "package_id", "depends_on", "dependency_version"
    )
