"""Does a property's text fit its datatype and its unit?"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fits_datatype(value: Column, datatype: Column) -> Column:
    """Strict on purpose: a cast would also take ``yes``, ``+5`` or `` 5``."""
    return (
        F.when(datatype == "integer", value.rlike(r"^-?[0-9]+\z"))
        .when(datatype == "bool", value.isin("true", "false"))
        .otherwise(F.lit(True))
    )


def java_pattern(regex: str) -> str:
    r"""A catalog pattern for the JVM: ``\w`` and ``\b`` see all of Unicode, and a
    closing ``$`` does not accept a last line break."""
    closing = len(regex)
    while closing and regex[closing - 1] == ")":
        closing -= 1
    head, tail = regex[:closing], regex[closing:]
    if head.endswith("$") and not head.endswith(r"\$"):
        head = head[:-1] + r"\z"
    return "(?U)" + head + tail


def java_pattern_of(regex: Column) -> Column:
    """``java_pattern`` for a column of patterns."""
    return F.concat(F.lit("(?U)"), F.regexp_replace(regex, r"(?<!\\)\$(\)*)\z", r"\\z$1"))


def fits_unit(
    value: Column, unit: Column, patterns: Mapping[str, str] | None, pattern: Column | None = None
) -> Column:
    """``patterns`` are the units of a catalog whose units are constants: one literal
    pattern per unit, so that each is compiled once per task rather than once per row.
    Without them ``pattern``, the pattern of the row's own unit, is tested.  A unit the
    catalog does not know is not judged here; it has a status of its own."""
    if patterns is None:
        return F.coalesce(F.regexp_like(value, pattern), F.lit(True))
    branches = [
        (unit == name, value.rlike(java_pattern(regex))) for name, regex in patterns.items()
    ]
    fits = reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0])) if (
        branches
    ) else F.lit(None).cast("boolean")
    return F.coalesce(fits, F.lit(True))
