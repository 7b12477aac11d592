"""Dotted versions as comparable columns, and version bumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = r"^[0-9]+([.][0-9]+)*\z"
_LONGEST = 99  # digits of one part that a rank can hold


def product_version(version: Column) -> Column:
    """Text before the first ``-`` of an image version."""
    return F.substring_index(version, "-", 1)


def version_key(product: Column) -> Column:
    """Array of the numeric parts, all of them, padded to three: 3.10 sorts after 3.9.

    NULL for anything that is not dotted numbers of up to 38 digits.
    """
    parts = F.transform(F.split(product, r"\."), lambda p: p.try_cast("decimal(38,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    padded = F.concat(
        parts, F.array_repeat(zero, F.greatest(F.lit(3) - F.size(parts), F.lit(0)))
    )
    whole = product.rlike(_NUMERIC) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(whole, padded)


def version_rank(product: Column) -> Column:
    """Text that sorts as the version does: what range conditions compare.

    Every part counts, written as its number of digits and its digits; parts of zero at
    the end count nothing.  NULL for anything that is not dotted numbers, or has a part
    of more than 99 digits.
    """

    def written(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=[0-9])", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), digits, F.lit("."))

    parts = F.split(product, r"\.")
    joined = F.array_join(F.transform(parts, written), "")
    fits = ~F.exists(parts, lambda p: F.length(p) > _LONGEST)
    return F.when(
        product.rlike(_NUMERIC) & fits, F.regexp_replace(joined, r"(?<![0-9])(010[.])+\z", "")
    )


def after_rank(rank: Column) -> Column:
    """The least rank text above ``rank``: no version lies in between."""
    return F.concat(rank, F.lit("010."))


def bump(version: Column, level: str, tag: str = "nightly") -> Column:
    """``version`` raised at ``level``.

    ``major``, ``minor`` and ``patch`` add one and drop what follows the numbers, also
    for a pre-release; ``following`` is the release after this one, which for a
    pre-release has the same numbers.  ``finalize`` only drops, ``prerelease`` puts
    ``tag`` in its place, and ``next_<level>`` raises and then tags: 1.2.3 at
    ``next_minor`` is 1.3.0-nightly.  NULL for what is not three numbers.
    """
    core = F.split(F.split(version, r"[-+]", 2)[0], r"\.")
    major, minor, patch = (F.get(core, F.lit(i)).try_cast("bigint") for i in range(3))

    three = (F.size(core) == 3) & major.isNotNull() & minor.isNotNull() & patch.isNotNull()

    def dotted(a: Column, b: Column, c: Column) -> Column:
        return F.when(three, F.concat_ws(".", *[p.cast("string") for p in (a, b, c)]))

    zero = F.lit(0)
    if level == "major":
        return dotted(major + 1, zero, zero)
    if level == "minor":
        return dotted(major, minor + 1, zero)
    if level == "patch":
        return dotted(major, minor, patch + 1)
    if level == "following":
        released = ~version.rlike("[-+]")
        return dotted(major, minor, patch + released.cast("bigint"))
    if level == "finalize":
        return dotted(major, minor, patch)
    if level == "prerelease":
        return F.concat(dotted(major, minor, patch), F.lit("-" + tag))
    if level.startswith("next_"):
        return F.concat(bump(version, level.removeprefix("next_")), F.lit("-" + tag))
    raise ValueError(f"unknown level {level!r}")
