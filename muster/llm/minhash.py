"""Near duplicates by circulant MinHash, confirmed on whole shingle sets.

A document is the set of its distinct shingles, each a 64-bit hash.  Two permutations of
the 64-bit numbers make all coordinates of its signature: the first, ``sigma``, scatters
the set once, and coordinate ``k`` is the least value the second one, ``pi``, gives to the
scattered set shifted circularly by ``k``.  Bands of ``ROWS`` coordinates are bucket keys;
two sets of similarity 0.8 share no band with a probability of about 5e-6 (40 bands of
six), of 0.85 with 5e-9.

Equal sets are one node, so copies never meet each other.  What shares a bucket is compared
exactly, without all pairs: in each bucket every member is compared with one leader, the
member that shares most, and what that links is one component; leaders have met all and
leave, and once more the rest is compared with a new leader.  In buckets that still span
several components, members outside the largest one are compared with all others, in tiles
of bounded size.  No pair that could link two components is left out, so nothing is lost
in large buckets; only the links within one component are not looked for.

Defined results: NULL and empty texts and texts of white space have an empty set and are
linked with nothing; fewer words than a shingle are one; a NULL id does not count as the
smallest (where a component has no other, its id is NULL); equal rows each give a row;
empty tables give no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import named, settle
from muster.llm.simhash import components

SHINGLE = 2
# Linked where 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS = 40
ROWS = 6
# Rounds of comparing with one leader before tiles.
STARS = 2
# Shingles of one side of a tile, or of the members one copy of a leader is compared with;
# a set counts as LEAST shingles at least, so that a side has 1,024 sets or so at most.
TILE = 1 << 18
LEAST = 256
# Shingles hashed at a time, and known words kept by a worker process.
CHUNK = 1 << 16
KNOWN = 1 << 20
# Rows of an input batch worked on at a time, and columns of a product of two tiles.
SLICE = 256
COLUMNS = 2_048
# Odd multipliers of the mixing steps (fixed values of well-known finalisers).
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
MIX_C = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """The hash of every word looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def sigma(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * MIX_A
    x = (x ^ (x >> np.uint64(33))) * MIX_B
    return x ^ (x >> np.uint64(33))


def pi(x: np.ndarray, out: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Another one, in place; ``x`` are scattered numbers already."""
    np.right_shift(x, np.uint64(32), out=part)
    np.bitwise_xor(x, part, out=out)
    np.multiply(out, MIX_C, out=out)
    np.right_shift(out, np.uint64(29), out=part)
    np.bitwise_xor(out, part, out=out)
    np.multiply(out, MIX_A, out=out)
    return out


def shingle_set(text: bytes | None, hashes: dict[bytes, int], length: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted numbers, scattered by ``sigma``."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(length, len(words))
    total = len(words) - size + 1
    mixed = np.full(total, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX_B + own[k : k + total]
    return np.unique(sigma(mixed))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row per coordinate, one column per set; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])
    out = np.full((coordinates, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    room, part, shifted = (np.empty(CHUNK, np.uint64) for _ in range(3))
    for begin in range(0, len(flat), CHUNK):
        x = flat[begin : begin + CHUNK]
        n = len(x)
        first = int(np.searchsorted(starts, begin, "right")) - 1
        last = int(np.searchsorted(starts, begin + n, "left"))
        cuts = np.maximum(starts[first:last], begin) - begin
        for k in range(coordinates):
            np.subtract(x, np.uint64(k), out=shifted[:n])
            least = np.minimum.reduceat(pi(shifted[:n], room[:n], part[:n]), cuts)
            np.minimum(out[k, first:last], least, out=out[k, first:last])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One row per set, one column per band: a number that equal bands share."""
    bands = signature.reshape(-1, rows, signature.shape[1])
    keys = np.arange(len(bands), dtype=np.uint64)[:, None] * MIX_C
    keys = np.broadcast_to(keys, (len(bands), signature.shape[1])).copy()
    for k in range(rows):
        keys = sigma(keys ^ bands[:, k])
    return np.ascontiguousarray(keys.T)


def linked(shared: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray):
    """Whether sets of ``a`` and ``b`` shingles that share so many are near duplicates."""
    return 100 * shared >= PERCENT * (a + b - shared)


def _prints(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set and band keys; NULL of empty sets."""
    rows = docs.select(
        named("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sets = [shingle_set(t, hashes, length) for t in batch.column(2).to_pylist()]
                some = [s for s in sets if len(s)]
                keys = np.empty((0, BANDS), np.int64)
                if some:
                    keys = band_keys(signatures(some, BANDS * ROWS), ROWS).view(np.int64)
                empty = np.array([not len(s) for s in sets])
                offsets = np.cumsum([0, *(0 if e else BANDS for e in empty)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "digest", "bands"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, text_key long, n_shingles long, digest binary, bands array<long>"
    )


def _members(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(node, hashes): the sets of the nodes ``wanted``, each read again from the document
    that stands for it."""
    rows = docs.select(
        named("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text")
    )
    same = (rows["key"] == wanted["text_key"]) & rows["id"].eqNullSafe(wanted["doc_id"])
    texts = rows.join(wanted, same).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = _Hashes(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                # Rows that repeat id and text are read once in a task.
                new = {
                    node: text
                    for node, text in zip(*(c.to_pylist() for c in whole.slice(at, SLICE).columns))
                    if node not in done
                }
                done.update(new)
                sets = [shingle_set(t, hashes, length).tobytes() for t in new.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(new), pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"]
                )

    return texts.mapInArrow(run, "node long, hashes binary")


def _star_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of the pairs (node, leader), with the size ``n`` of the node's set, those that are
    near duplicates, as (u, v).

    A leader is copied once per so many shingles it is compared with, and its members are
    dealt to its copies; a task holds one leader's set at a time.
    """
    work = pairs.groupBy("leader").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("copies"))
    dealt = (
        pairs.join(work, "leader")
        .withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
        .select("leader", "copy", "node", F.lit(True).alias("compared"))
    )
    leaders = work.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    both = dealt.unionByName(
        leaders.select("leader", "copy", F.col("leader").alias("node"), F.lit(False).alias("compared"))
    )
    keys = ["leader", "copy"]
    ordered = (
        both.join(members, "node")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "compared")
        .select("leader", "node", "compared", "hashes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for leader, node, compared, raw in zip(*(c.to_pylist() for c in batch.columns)):
                its = np.frombuffer(raw, np.uint64)
                if not compared:
                    own = its
                    continue
                small, large = sorted((own, its), key=len)
                if not linked(len(small), len(small), len(large)):
                    continue
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if linked(int((large[place] == small).sum()), len(own), len(its)):
                    found.append((leader, node))
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["u", "v"]
            )

    return ordered.mapInArrow(run, "u long, v long")


def _dense(ids: np.ndarray, owners: np.ndarray, rows: int, low: int, high: int) -> np.ndarray:
    out = np.zeros((rows, high - low), np.float32)
    inside = (ids >= low) & (ids < high)
    out[owners[inside], ids[inside] - low] = 1
    return out


def near_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of the left (rows) and the right (columns) are near duplicates: products
    of incidence matrices over the shingles both sides have."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), list(map(len, s)))) for s in (left, right)]
    both = np.intersect1d(*(np.unique(flat) for flat, _ in sides), assume_unique=True)
    shared = np.zeros((len(left), len(right)), np.int64)
    if len(both):
        placed = []
        for flat, owners in sides:
            at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
            known = both[at] == flat
            placed.append((at[known], owners[known]))
        for low in range(0, len(both), COLUMNS):
            high = min(low + COLUMNS, len(both))
            a = _dense(*placed[0], len(left), low, high)
            b = _dense(*placed[1], len(right), low, high)
            # Whole numbers this small are exact in single precision.
            shared += (a @ b.T).astype(np.int64)
    sizes = [np.array(list(map(len, s)), np.int64) for s in (left, right)]
    return linked(shared, sizes[0][:, None], sizes[1][None, :])


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the labels ``left`` and ``right`` as all of ``near`` would."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    labels, which = np.unique(right, return_inverse=True)
    for i, row in enumerate(near):
        for other in labels[np.unique(which[row])].tolist():
            a, b = root(int(left[i])), root(other)
            if a != b:
                parent[a] = b
                edges.append((int(left[i]), other))
    return edges


def _tile_links(buckets: DataFrame, members: DataFrame) -> DataFrame:
    """Links (u, v) between components, from buckets (key, node, n, label): members outside
    the largest component against all others."""
    counts = buckets.groupBy("key", "label").agg(F.count("*").alias("m"))
    main = counts.groupBy("key").agg(F.max(F.struct("m", "label")).label.alias("main"))
    rows = buckets.join(main, "key").withColumn("outside", F.col("label") != F.col("main"))
    shape = rows.groupBy("key").agg(
        F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / TILE).cast("int").alias("tall"),
        F.ceil(F.sum("n") / TILE).cast("int").alias("wide"),
    )
    rows = rows.join(shape, "key")
    dealt = F.xxhash64("node")
    # Side 0 are the rows of a tile, the members outside; side 1 its columns, all members.
    down = rows.where("outside").select(
        "key", "node", "label", F.lit(0).alias("side"),
        F.pmod(dealt, F.col("tall")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"),
    )
    across = rows.select(
        "key", "node", "label", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("i"),
        F.pmod(dealt, F.col("wide")).cast("int").alias("j"),
    )
    placed = down.unionByName(across.select(*down.columns)).join(members, "node")

    def compare(rows: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            own = rows.filter(pc.equal(rows["side"], side))
            sets = [np.frombuffer(x, np.uint64) for x in own["hashes"].to_pylist()]
            sides.append((sets, own["label"].to_numpy()))
        (a, a_labels), (b, b_labels) = sides
        found = []
        if a and b:
            near = near_pairs(a, b) & (a_labels[:, None] != b_labels[None, :])
            found = _forest(near, a_labels, b_labels)
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": ends[:, 0].copy(), "v": ends[:, 1].copy()})

    return placed.groupBy("key", "i", "j").applyInArrow(compare, "u long, v long")


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` (node, label, ...) with the label its component has now."""
    if roots is None:
        return rows
    moved = roots.select(F.col("node").alias("label"), "root")
    return rows.join(moved, "label", "left").select(
        *[F.coalesce("root", "label").alias(c) if c == "label" else F.col(c) for c in rows.columns]
    )


def _spanning(buckets: DataFrame) -> DataFrame:
    """Of the buckets those whose members have several labels; of equal buckets one."""
    agg = buckets.groupBy("key").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("a"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b"),
    )
    open_ = agg.where("low <> high").groupBy("m", "a", "b").agg(F.min("key").alias("key"))
    return buckets.join(open_.select("key", "m"), "key", "left_semi")


def _classes(docs: DataFrame, sets: DataFrame, length: int) -> DataFrame:
    """(node, label): every set and one that stands for its component."""
    labels = sets.select("node", F.col("node").alias("label"))
    entries = sets.select(
        "node", F.greatest("n_shingles", F.lit(LEAST)).alias("n"), F.explode("bands").alias("key")
    )
    sizes = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = settle(entries.join(sizes, "key"), "buckets")
    # How much a set shares: leaders are those that share most.
    weight = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    buckets = shared.join(weight, "node").select(
        "key", "node", "n", "weight", F.col("node").alias("label")
    )
    buckets = settle(_spanning(buckets), "buckets")
    if buckets.isEmpty():
        return labels
    wanted = sets.join(buckets.select("node").distinct(), "node", "left_semi")
    members = settle(_members(docs, wanted.select("node", "rep.doc_id", "rep.text_key"), length), "members")
    for _ in range(STARS):
        top = F.max(F.struct("weight", "node", "label"))
        leaders = buckets.groupBy("key").agg(top.alias("top")).select(
            "key", F.col("top.node").alias("leader"), F.col("top.label").alias("its")
        )
        met = settle(buckets.join(leaders, "key"), "met")
        pairs = met.where("label <> its").select("node", "leader", "n").distinct()
        ends = labels.select("node", "label")
        links = settle(_star_links(settle(pairs, "pairs"), members), "links")
        between = (
            links.join(ends.toDF("u", "a"), "u").join(ends.toDF("v", "b"), "v").select("a", "b")
        )
        roots = components(between.toDF("u", "v"))
        if roots is not None:
            labels = settle(_labelled(labels, roots), "labels")
        rest = _labelled(met.where("node <> leader").select(*buckets.columns), roots)
        buckets = settle(_spanning(rest), "buckets")
        if buckets.isEmpty():
            return labels
    roots = components(_tile_links(buckets.select("key", "node", "n", "label"), members))
    return _labelled(labels, roots)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (it has the smallest id)."""
    docs = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    prints = settle(_prints(docs, length), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key"))
    sets = (
        prints.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            least.alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    sets = settle(sets, "sets")
    owned = settle(
        _classes(docs, sets, length).join(sets.select("node", "digest", "rep"), "node"), "classes"
    )
    owners = owned.groupBy("label").agg(F.min("rep.doc_id").alias("component_id"))
    found = owned.join(owners, "label").select("digest", "component_id")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    some = prints.where("digest IS NOT NULL").join(found, "digest")
    none = prints.where("digest IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return some.select(*columns).unionByName(none.select(*columns)).select(*columns, kept)
