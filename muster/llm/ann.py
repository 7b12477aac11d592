"""Approximate nearest neighbours by multi-index hashing.

A rotation learnt on a bounded sample (principal axes, then rotations that bring the
sample close to its own signs) turns a vector into a binary code.  Codes are split into
substrings and each substring is indexed.  Two codes within radius R agree, in at least one
of m substrings, up to R div m bits (pigeonhole), so probing every value that close to a
query's substrings retrieves every code within R; those are reranked by the exact
distance of the vectors.  R is the radius that holds ``RECALL`` of the near pairs of the
sample; as neighbours only get nearer with more rows, that is on the safe side.  Where a
block holds fewer than k codes within R, the radius grows until there are k.

Rows are dealt into blocks of bounded size by a hash, each with its own index, and
queries likewise; every pair of blocks gives the k best of each query, and these are
merged.  No row, bucket or candidate is left out, and copies share a bucket of one block
without meeting each other.

Defined results: vectors that are NULL, empty, zero, hold NULL or non-finite components, or
are of another length than most of the sample take no part, nor do NULL ids; equal
distances go to the smaller id; equal rows are candidates each; of several rows of one
query id the least vector asks, and a query does not find rows of its own id; with fewer than k candidates all are returned; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import named, settle

K = 10
BITS = 64
SUBSTRINGS = 4
SAMPLE = 20_000
PROBES_OF_SAMPLE = 500
ROTATIONS = 40
RECALL = 0.975
INDEX_BLOCK = 16_384
QUERY_BLOCK = 16_384


@dataclass(frozen=True)
class Codes:
    """Centre and rotation of the codes, the pieces they are split in, and the radius."""

    centre: np.ndarray
    rotation: np.ndarray
    pieces: tuple[tuple[int, int], ...]
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as unsigned 64-bit numbers."""
        bits = ((vectors - self.centre) @ self.rotation > 0).astype(np.uint8)
        padded = np.zeros((len(bits), 64), np.uint8)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()


def learn_codes(
    sample: np.ndarray, k: int = K, bits: int = BITS, substrings: int = SUBSTRINGS, recall: float = RECALL
) -> Codes:
    """Fit rotation and radius to a sample of vectors, one a row."""
    bits = min(bits, sample.shape[1], 64)
    centre = sample.mean(axis=0)
    shifted = sample - centre
    _, axes = np.linalg.eigh(shifted.T @ shifted)
    axes = axes[:, ::-1][:, :bits]
    flat = shifted @ axes
    rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(ROTATIONS):
        u, _, v = np.linalg.svd(np.where(flat @ rotation > 0, 1.0, -1.0).T @ flat)
        rotation = (u @ v).T
    edges = np.linspace(0, bits, min(substrings, bits) + 1).astype(int)
    pieces = tuple((int(a), int(b - a)) for a, b in zip(edges, edges[1:]))
    draft = Codes(centre, axes @ rotation, pieces, bits)
    codes = draft.of(sample)
    apart = []
    for i in range(0, len(sample), max(1, len(sample) // PROBES_OF_SAMPLE)):
        distance = ((sample - sample[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        near = np.argpartition(distance, min(k, len(sample) - 1) - 1)[:k] if len(sample) > 1 else []
        apart.extend(np.bitwise_count(codes[near] ^ codes[i]).tolist())
    radius = int(np.quantile(apart, recall, method="higher")) if apart else bits
    return Codes(centre, axes @ rotation, pieces, radius)


class Index:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray, pieces: tuple[tuple[int, int], ...]):
        self.codes, self.pieces = codes, pieces
        self.rows, self.starts = [], []
        for at, width in pieces:
            values = self._value(codes, at, width)
            self.rows.append(np.argsort(values, kind="stable"))
            counts = np.bincount(values, minlength=1 << width)
            self.starts.append(np.concatenate([[0], np.cumsum(counts)]))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _value(codes: np.ndarray, at: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def _flips(self, width: int, bits: int) -> np.ndarray:
        """All values of ``width`` bits with exactly ``bits`` set."""
        if (width, bits) not in self.masks:
            self.masks[width, bits] = np.array(
                [sum(1 << b for b in c) for c in combinations(range(width), bits)], np.int64
            )
        return self.masks[width, bits]

    def within(self, code: np.uint64, radius: int, least: int) -> np.ndarray:
        """Every row within ``radius``; if those are under ``least``, within the smallest
        radius that holds so many (or everything)."""
        found = np.zeros(len(self.codes), bool)
        reach = -1
        most = max(w for _, w in self.pieces)
        while True:
            # Probe one bit further in every substring until the radius is covered.
            while reach < min(most, radius // len(self.pieces)):
                reach += 1
                for (at, width), rows, starts in zip(self.pieces, self.rows, self.starts):
                    if reach <= width:
                        own = int(self._value(np.array([code]), at, width)[0])
                        values = self._flips(width, reach) ^ own
                        begin, size = starts[values], starts[values + 1] - starts[values]
                        begin, size = begin[size > 0], size[size > 0]
                        if len(size):
                            ends = np.cumsum(size)
                            step = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
                            found[rows[step]] = True
            at = np.flatnonzero(found)
            at = at[np.bitwise_count(self.codes[at] ^ code) <= radius]
            if len(at) >= min(least, len(self.codes)):
                return at
            radius += 1


def _fit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    vector = named(vector_col)
    usable = (
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    return vectors.where(usable & named(id_col).isNotNull()).select(
        named(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector")
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    codes: Codes | None = None,
    index_block: int = INDEX_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest found.

    ``is_query`` picks the queries by ``vec_id``.  Without ``codes`` they are learnt from
    ``SAMPLE`` rows at most, those of the smallest hash of the id.
    """
    rows = _fit_rows(vectors, id_col, vector_col)
    if codes is None:
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        sample = [v for v in drawn.column("vector").to_pylist()]
        if not sample:
            return _empty(vectors)
        length = Counter(map(len, sample)).most_common(1)[0][0]
        codes = learn_codes(np.array([v for v in sample if len(v) == length]), k)
    length = len(codes.centre)
    rows = rows.where(F.size("vector") == length)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    index_blocks = max(1, -(-counts.n // index_block))
    query_blocks = max(1, -(-counts.q // query_block))

    def dealt(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = rows.withColumn("i", dealt(index_blocks, 1)).withColumn("q", every(query_blocks))
    asking = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = (
        asking.withColumn("q", dealt(query_blocks, 2)).withColumn("i", every(index_blocks))
    )

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        return table.column("vec_id").to_numpy(), flat.reshape(-1, length)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            ids, base = matrix(left)
            built = Index(codes.of(base), codes.pieces)
            query_ids, asked = matrix(right)
            for query_id, vector, code in zip(query_ids, asked, codes.of(asked)):
                own = int((ids == query_id).sum())
                at = built.within(code, codes.radius, k + own)
                at = at[ids[at] != query_id]
                score = np.sqrt(((base[at] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], score))[:k]
                out.append((np.full(len(best), query_id), ids[at][best], score[best]))
        columns = [np.concatenate(c) if out else np.zeros(0) for c in zip(*out)] or [np.zeros(0)] * 3
        return pa.table(
            {
                "query_id": pa.array(columns[0].astype(np.int64)),
                "vec_id": pa.array(columns[1].astype(np.int64)),
                "score": pa.array(columns[2].astype(np.float64)),
            }
        )

    found = settle(
        index.groupBy("i", "q")
        .cogroup(queries.groupBy("i", "q"))
        .applyInArrow(search, "query_id long, vec_id long, score double"),
        "nearest",
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
