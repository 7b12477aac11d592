"""Near duplicates by SimHash, compared tile by tile.

A fingerprint is worked out for every whole text: words of the lower-cased (A-Z) text,
three-word shingles with repeats, XXH64 of each (seed 42), and a bit is set where it is
set in over half of the hashes.  Documents of equal fingerprint are one node, so copies
never meet each other.  Nodes are sorted into cells by the population counts of the four
16-bit quarters, and cells are cut into tiles of bounded size.  Two fingerprints within
the radius differ by no more than it in the sum of those four counts, so tile pairs
beyond it are skipped; the others are compared exactly with exclusive-or and bit counts
in numpy, block by block.  A tile pair hands on a spanning forest of its links, not the
links: that keeps every component and grows with the nodes, not with their pairs.
Components are then joined by contraction: every node moves to its smallest neighbour
until no link is left.

Defined results: NULL and empty texts, and texts of white space, have fingerprint zero and
link like any other; fewer than three words are one shingle; equal rows each give a row;
a NULL id takes no part in finding the smallest id but gets the component of its
fingerprint; empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import named, settle

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 16_384
BLOCK = 1_024
SLICE = 65_536
CELL_SIDE = 17
# Random constants, one after the other: the order of nodes in a round of contraction.
FLIPS = [int(x) for x in np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 16)]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    total = len(words) - SHINGLE + 1
    for begin in range(0, total, SLICE):
        part = words[begin : begin + SLICE + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:]))
        hashes = np.fromiter(
            (digest(s, SEED) for s in shingles), np.uint64, min(SLICE, total - begin)
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = (2 * counts > total).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), in the order of the rows."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row per fingerprint."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _cell(fp: Column) -> Column:
    """The cell of a fingerprint: the counts of its first two quarters, as one number."""
    first = F.bit_count(fp.bitwiseAND(F.lit(0xFFFF)))
    second = F.bit_count(F.shiftrightunsigned(fp, 16).bitwiseAND(F.lit(0xFFFF)))
    return (first * CELL_SIDE + second).cast("int")


def _apart(a: int, b: int) -> int:
    """The least number of bits that fingerprints of two cells differ in."""
    return abs(a // CELL_SIDE - b // CELL_SIDE) + abs(a % CELL_SIDE - b % CELL_SIDE)


def _in_blocks(fps: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Blocks of like counts, and each block's least and greatest counts."""
    counts = _counts(fps)
    order = np.lexsort(counts.T)
    fps, counts = fps[order], counts[order]
    new = np.any(np.diff(counts[:, 2:], axis=0) != 0, axis=1)
    cuts = np.union1d(np.flatnonzero(new) + 1, np.arange(BLOCK, len(fps), BLOCK))
    blocks = np.split(fps, cuts)
    parts = np.split(counts, cuts)
    return blocks, np.array([c.min(axis=0) for c in parts]), np.array([c.max(axis=0) for c in parts])


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles, or (``right`` None) within one.

    Exact: blocks are skipped only where their population counts differ beyond the radius.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, low_a, high_a = _in_blocks(left)
    b, low_b, high_b = (a, low_a, high_a) if right is None else _in_blocks(right)
    edges = []
    for i, block in enumerate(a):
        gap = np.maximum(0, np.maximum(low_a[i] - high_b, low_b - high_a[i])).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if right is None and j < i:
                continue
            near = np.bitwise_count(block[:, None] ^ b[j][None, :]) <= radius
            for x, y in zip(*np.nonzero(near)):
                p, q = int(block[x]), int(b[j][y])
                if p != q and (rp := root(p)) != (rq := root(q)):
                    parent[rp] = rq
                    edges.append((p, q))
    return edges


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that keep every component, from distinct fingerprints ``fp``.

    The driver learns the size of each cell, of which there are 289 at most.
    """
    celled = nodes.select("fp", _cell(F.col("fp")).alias("cell"))
    sizes = {r.cell: r["count"] for r in celled.groupBy("cell").count().collect()}
    tiles = {c: -(-n // tile) for c, n in sizes.items()}
    if not tiles:
        return nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    # Tables of the cells as constants of the plan, folded once.
    per_cell = F.from_json(F.lit(json.dumps(tiles)), "map<string, int>")
    near = F.from_json(
        F.lit(
            json.dumps(
                {
                    c: [{"cell": o, "tiles": n} for o, n in tiles.items() if _apart(c, o) <= radius]
                    for c in tiles
                }
            )
        ),
        "map<string, array<struct<cell: int, tiles: int>>>",
    )
    cell = F.col("cell").cast("string")
    tiled = celled.withColumn(
        "tile", F.pmod(F.xxhash64("fp"), per_cell[cell]).cast("int")
    )

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        packed = np.sort(rows.column("fp").to_numpy()).tobytes()
        return pa.table({"cell": [key[0]], "tile": [key[1]], "fps": pa.array([packed], pa.binary())})

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        sides = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("fps")]
        found = spanning_links(sides[0], sides[1] if len(sides) > 1 else None, radius)
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"u": ends[:, 0].copy(), "v": ends[:, 1].copy()})

    packed = tiled.groupBy("cell", "tile").applyInArrow(pack, "cell int, tile int, fps binary")
    others = packed.withColumn("o", F.explode(near[cell])).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("o.tiles") - 1))
    )
    mine, its = F.struct("cell", "tile"), F.struct(F.col("o.cell"), F.col("other").alias("tile"))
    pairs = others.select(F.least(mine, its).alias("a"), F.greatest(mine, its).alias("b"), "fps")
    flat = pairs.select(
        F.col("a.cell").alias("a_cell"),
        F.col("a.tile").alias("a_tile"),
        F.col("b.cell").alias("b_cell"),
        F.col("b.tile").alias("b_tile"),
        "fps",
    )
    return flat.groupBy("a_cell", "a_tile", "b_cell", "b_tile").applyInArrow(
        compare, "u long, v long"
    )


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every node that has a link; None without links.

    Each round moves every node to the least of its neighbours and itself, in an order
    that changes with the round (bits flipped by a constant), and keeps the links that
    still join two nodes; it ends when none is left.
    """
    edges = settle(edges.where("u <> v").distinct(), "links")
    moved: DataFrame | None = None
    for round_ in range(10_000):
        if edges.isEmpty():
            return moved
        flip = F.lit(FLIPS[round_ % len(FLIPS)])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(flip)).alias("v"))
        step = settle(
            least.select(
                F.col("u").alias("node"),
                F.least("v", F.col("u").bitwiseXOR(flip)).bitwiseXOR(flip).alias("to"),
            ),
            "moves",
        )
        edges = settle(
            edges.join(step.toDF("u", "u_to"), "u")
            .join(step.toDF("v", "v_to"), "v")
            .where("u_to <> v_to")
            .select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v"))
            .distinct(),
            "links",
        )
        if moved is None:
            moved = step.toDF("node", "root")
        else:
            moved = settle(
                moved.join(step.toDF("root", "to"), "root", "left").select(
                    "node", F.coalesce("to", "root").alias("root")
                ),
                "roots",
            )
    raise RuntimeError("components did not settle")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): every fingerprint of ``prints`` and one that stands for its component."""
    nodes = settle(prints.select("fp").distinct(), "nodes")
    roots = components(links(nodes, radius))
    if roots is None:
        return nodes.select("fp", F.col("fp").alias("root"))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = settle(fingerprints(docs, id_col, text_col), "prints")
    rooted = classes(prints, radius)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    owned = settle(rooted.join(least, "fp"), "classes")
    owners = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(owned.join(owners, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One document of each group, the one of the smallest id (NULL last), whole.

    Of rows that repeat that id one stays.  The documents are written once to the shared
    folder, so that their rows can be told apart; they are one column of it, so their own
    columns may have any name.
    """
    whole = F.struct(*[named(c) for c in docs.columns])
    rows = settle(
        docs.select(whole.alias("whole"), F.monotonically_increasing_id().alias("row")), "documents"
    )
    own, text = F.col("whole").getField(id_col), F.col("whole").getField(text_col)
    prints = settle(fingerprints(rows.select("row", text.alias("text")), "row", "text"), "prints")
    ids = rows.select("row", own.isNull().alias("missing"), own.alias("id")).join(
        prints.withColumnRenamed("doc_id", "row"), "row"
    )
    first = F.min(F.struct("missing", "id", "row"))
    firsts = ids.groupBy("fp").agg(first.alias("first")).join(classes(prints, radius), "fp")
    kept = firsts.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select("whole.*")
