"""A tree of digests over a fleet's configuration: property, file, role group, cluster, fleet.

The digest of a node is the sum, in four numbers of 60 bits, of a hash of each child's name
and digest.  Sums combine before a shuffle, gather nothing, and do not depend on order; a
parent changes exactly when one of its children does.  Written to disk, every level is dealt
to buckets by a hash of the cluster, so comparing two fleets reads the level of clusters, and
below it only the buckets of the clusters that differ, and of these shuffles hardly any other
node than those that differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.state import union_kinds
from muster.schema import KEY
from muster.session import shuffles_dropped, work_dir

BUCKETS = 16
# What a broadcast sketch of nodes has at most: so many words of 64 bits, 4 MB.
SKETCH_WORDS = 1 << 18
_PARTS, _DIGITS = 4, 15
_HALF = 2 * _DIGITS
# The keys of a node on each level, and the level its children are on.
LEVELS = {
    "file": [*KEY, "file"],
    "group": list(KEY),
    "cluster": ["cluster_id"],
    "fleet": [],
}


def _written(*texts: Column) -> Column:
    """Texts one after the other, so that no two lists are written alike."""
    strings = [t.cast("string") for t in texts]
    return F.concat(
        *[F.coalesce(F.concat(F.char_length(t), F.lit(":"), t), F.lit("-")) for t in strings]
    )


def _text(rows: DataFrame, keys: Sequence[str], column: str, n: Column) -> DataFrame:
    """(keys, digest, n): the sums of the parts of a column of hexadecimal texts.

    A part is summed as its upper and its lower half, in whole numbers of 64 bits, which do
    not overflow below 2^33 children of a node (and would be an error, not another digest).
    """
    sums = []
    for k in range(_PARTS):
        part = F.conv(F.substring(column, 1 + _DIGITS * k, _DIGITS), 16, 10).cast("bigint")
        sums.append(F.sum(F.shiftright(part, _HALF)).alias(f"h{k}"))
        sums.append(F.sum(part.bitwiseAND(F.lit((1 << _HALF) - 1))).alias(f"l{k}"))
    texts = []
    for k in range(_PARTS):
        high, low = F.coalesce(f"h{k}", F.lit(0)), F.coalesce(f"l{k}", F.lit(0))
        carried = F.shiftleft(high.bitwiseAND(F.lit((1 << _HALF) - 1)), _HALF)
        whole = F.lit((1 << 2 * _HALF) - 1)
        total = (carried + low.bitwiseAND(whole)).bitwiseAND(whole)
        texts.append(F.lpad(F.lower(F.hex(total)), _DIGITS, "0"))
    summed = rows.groupBy(*keys).agg(*sums, n.alias("n"))
    return summed.select(*keys, F.concat(*texts).alias("digest"), "n")


def _summed(children: DataFrame, keys: Sequence[str], names: Sequence[Column]) -> DataFrame:
    """(keys, digest, n) of nodes whose children are the rows with these names and digests."""
    hashed = children.select(*keys, F.sha2(_written(*names), 256).alias("hash"))
    return _text(hashed, keys, "hash", F.count("*"))


def tree(props: DataFrame) -> dict[str, DataFrame]:
    """The levels of the tree over (K, file, prop, value), from files to the fleet, each of
    them (keys, digest, n children)."""
    levels, children, names = {}, props, [F.col("prop"), F.col("value")]
    for level, keys in LEVELS.items():
        levels[level] = _summed(children, keys, names)
        above = list(LEVELS.values())[min(len(levels), len(LEVELS) - 1)]
        children = levels[level]
        names = [F.col(c) for c in keys if c not in above] + [F.col("digest")]
    return levels


def _write(df: DataFrame, path: str, *by: str) -> None:
    """Digests are hexadecimal and do not repeat, which only a codec that codes single
    characters makes smaller."""
    with shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)


def write_tree(props: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the properties and the levels above them, each made from the written one below.
    Trees to be compared have the same number of buckets, best a power of two; a large fleet
    has more of them.

    Every task writes its own files of the buckets, so rows are not shuffled to be written,
    and those of a file that come together stay so and are summed before the shuffle.
    """
    spark = props.sparkSession
    bucket = F.pmod(F.xxhash64("cluster_id"), F.lit(buckets)).cast("int")

    def write(df: DataFrame, level: str) -> DataFrame:
        _write(df.withColumn("bucket", bucket), f"{path}/{level}", "bucket")
        return spark.read.schema(df.schema).parquet(f"{path}/{level}")

    children = write(props.select(*KEY, "file", "prop", "value"), "prop")
    names = [F.col("prop"), F.col("value")]
    for level, keys in LEVELS.items():
        node = _summed(children, keys, names)
        if level == "fleet":
            _write(node, f"{path}/{level}")
            return
        children = write(node, level)
        above = list(LEVELS.values())[list(LEVELS).index(level) + 1]
        names = [F.col(c) for c in keys if c not in above] + [F.col("digest")]


def _level(spark: SparkSession, path: str, level: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{level}")


def properties_of(spark: SparkSession, path: str) -> DataFrame:
    """(K, file, prop, value): the properties of a written tree."""
    return _level(spark, path, "prop").drop("bucket")


def _differing(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """(keys, old, new) of what is not the same on both sides."""
    a = left.select(*keys, F.col(what).alias("old"))
    b = right.select(*keys, F.col(what).alias("new"))
    return a.join(b, keys, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def _place(keys: Sequence[str]) -> dict[str, Column]:
    """Where a node is in a sketch.  The word depends on its cluster, as its bucket does."""
    bit = F.pmod(F.xxhash64(*keys, F.lit("bit")), F.lit(64)).cast("int")
    return {"word": F.pmod(F.xxhash64("cluster_id"), F.lit(SKETCH_WORDS)).cast("int"), "bit": bit}


def _sketch(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(bucket, word, bits): a bit set for each of the nodes, of bounded size."""
    placed = nodes.select("bucket", *[c.alias(n) for n, c in _place(keys).items()])
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), "bit")).alias("bits")
    return placed.groupBy("bucket", "word").agg(bits).filter("bits <> 0")


def _below(table: DataFrame, sketch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a level below the nodes in a sketch, and a few others, which are the same
    on both sides; read from the nodes' buckets only and left out before any shuffle."""
    placed = table.dropna(subset=list(keys)).withColumns(_place(keys))
    met = placed.join(F.broadcast(sketch), ["bucket", "word"])
    held = F.call_function("shiftright", "bits", "bit").bitwiseAND(F.lit(1)) == 1
    return met.filter(held).select(table.columns)


def diff_trees(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(K, file, prop, old, new) of every property that differs between two written trees,
    with NULL where there is none.

    Descends from the fleet to clusters, role groups and files, and reads on each level only
    the buckets of nodes that differ on the one above.  The nodes of a level are written
    before the next one is read, which takes them as a sketch.
    """
    sides = (old, new)
    fleets = [_level(spark, path, "fleet").select("digest") for path in sides]
    schema = "cluster_id bigint, role string, role_group string, file string, prop string, old string, new string"
    if fleets[0].first() == fleets[1].first():
        return spark.createDataFrame([], schema)
    nodes, keys = None, []
    for level in ("cluster", "group", "file", "prop"):
        tables = [_level(spark, path, level) for path in sides]
        if nodes is not None:
            sketch = _sketch(nodes, keys)
            tables = [_below(t, sketch, keys) for t in tables]
        if level == "prop":
            # A property may come several times, and is then not the same as itself: what is
            # not below a node that differs is left out here, where few rows are left.
            found = _differing(*tables, ["bucket", *keys, "prop"], "value")
            found = found.join(nodes.hint("shuffle_hash"), ["bucket", *keys], "left_semi")
            return found.select(*keys, "prop", "old", "new")
        keys = LEVELS[level]
        path = work_dir(spark, f"differing-{level}")
        differing = _differing(*tables, ["bucket", *keys], "digest").select("bucket", *keys)
        _write(differing, path)
        nodes = spark.read.schema(differing.schema).parquet(path)
    raise AssertionError("the last level returns")


def discovery_digests(props: DataFrame) -> DataFrame:
    """(cluster_id, digest, n): what a cluster's clients can compare to see that its
    configuration has changed."""
    return tree(props)["cluster"]


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """The digest of a node whose children are spread over several tables of (digest, n) of
    the same node: sums of sums."""
    rows = union_kinds(*parts)
    keys = [c for c in rows.columns if c not in ("digest", "n")]
    return _text(rows, keys, "digest", F.sum("n"))
