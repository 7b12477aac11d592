"""Collocations: phrases of two or three words that occur together more than apart.

Every task counts the phrases of its documents in a HAT-trie over word ids.  A phrase of
three words is one key, word by word; the trie's nodes are ranges of keys that begin and
end at a word, and its leaves are hash containers.  A container that grows too large bursts
into two at the border of a first word, else of a second, so containers of frequent words
lie deeper.  When the trie holds too many phrases, its largest subtrees leave it whole, as
sorted runs: one for each prefix partition, the hash of the first two words, with the run's
own words and its keys as ranks among them, so that keys are small, differ little and
compress well, and no dictionary is shared.  The runs of a partition are then merged: their
words are united, ranks keep their order, and counts of equal phrases are summed.  A phrase
of two words has the sum of its continuations, at the end of a piece the empty one.

Frequent words and pairs do not gather: a run holds each phrase once however often it
occurs, and a prefix of two words has as many rows as words follow it.

Pieces are what stands between ``.,;:!?`` and line ends, words what stands between spaces
and tabs.  Defined results: NULL and empty texts have no words; a NULL language is ``und``;
repeated rows count as often; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import named, settle

LEAST = 10
COVER_PERCENT = 50
TOP = 2_000
UNKNOWN = "und"
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
# A key is three word ids of so many bits; 0 is no word.
BITS = 21
MASK = np.uint64((1 << BITS) - 1)
ONE, TWO = np.uint64(BITS), np.uint64(2 * BITS)
# Words of a block, words before they are put into the trie, phrases of a container, phrases
# of a task's tries.
BLOCK = 1 << 18
CHUNK = 1 << 16
BURST = 1 << 13
BUDGET = 1 << 20
# Ranks are dealt anew to this many parts of a language before its best are found.
SALTS = 64
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(ENDS)
)
_RUN = "lang string, part int, words binary, keys binary, counts binary"


class Words(dict):
    """Ids of words in the order they come, from 1 on; 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0})
        self.names = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.names)
        self.names.append(word)
        return found


def blocks(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text, a line end after every piece, in blocks; with each how many
    words at its end, before its last line end, belong to the next and only show what
    follows."""
    tokens = [t for t in text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ") if t]
    for begin in range(0, len(tokens), BLOCK):
        own = tokens[begin : begin + BLOCK + 2]
        ahead = max(0, len(own) - BLOCK)
        own.append(b"\n")
        yield own, ahead


class Trie:
    """Counts of keys in hash containers, each for a range of keys between word borders."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.entries = burst, 0
        self.bounds = np.zeros(1, np.uint64)
        self.containers: list[Counter] = [Counter()]

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        place = (np.searchsorted(self.bounds, keys, side="right") - 1).astype(np.int32)
        order = np.argsort(place, kind="stable")
        place, values = place[order], keys[order].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(values)]
        crowded = []
        for begin, end in zip(cuts, cuts[1:]):
            at = int(place[begin])
            container = self.containers[at]
            before = len(container)
            container.update(values[begin:end])
            self.entries += len(container) - before
            if len(container) > self.burst:
                crowded.append(at)
        for at in reversed(crowded):
            self._burst(at)

    def _burst(self, at: int) -> None:
        container = self.containers[at]
        if len(container) <= self.burst:
            return
        keys = np.sort(np.fromiter(container, np.uint64, len(container)))
        middle = keys[len(keys) // 2]
        for shift in (TWO, ONE):
            # The border before the middle key's word, else the one after it.
            border = (middle >> shift) << shift
            if border <= keys[0]:
                border = ((middle >> shift) + np.uint64(1)) << shift
            if keys[0] < border <= keys[-1]:
                break
        else:
            return
        upper = Counter({k: n for k, n in container.items() if k >= border})
        lower = Counter({k: n for k, n in container.items() if k < border})
        self.containers[at : at + 1] = [lower, upper]
        self.bounds = np.insert(self.bounds, at + 1, border)
        self._burst(at + 1)
        self._burst(at)

    def take(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of the largest subtrees of first words, until no more than
        ``left`` phrases stay; what is taken leaves an empty container."""
        heads = np.flatnonzero((self.bounds & ((np.uint64(1) << TWO) - np.uint64(1))) == 0)
        sizes = np.add.reduceat(np.array([len(c) for c in self.containers]), heads)
        taken = np.zeros(len(heads), bool)
        for k in np.argsort(-sizes, kind="stable"):
            if self.entries <= left:
                break
            taken[k] = True
            self.entries -= int(sizes[k])
        keys, counts, bounds, containers = [], [], [], []
        for k, (begin, end) in enumerate(zip(heads, [*heads[1:], len(self.bounds)])):
            if taken[k]:
                for container in self.containers[begin:end]:
                    keys.append(np.fromiter(container.keys(), np.uint64, len(container)))
                    counts.append(np.fromiter(container.values(), np.int64, len(container)))
                bounds.append(self.bounds[begin : begin + 1])
                containers.append(Counter())
            else:
                bounds.append(self.bounds[begin:end])
                containers.extend(self.containers[begin:end])
        self.bounds, self.containers = np.concatenate(bounds), containers
        none = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        return np.concatenate(keys or none[0]), np.concatenate(counts or none[1])


def _pack(values: np.ndarray) -> bytes:
    """Numbers as bytes, the high ones of all first, compressed."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel()


def _split(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> TWO).astype(np.int64), ((keys >> ONE) & MASK).astype(np.int64), (keys & MASK).astype(np.int64)]


def _join(ids: list[np.ndarray]) -> np.ndarray:
    a, b, c = (x.astype(np.uint64) for x in ids)
    return (a << TWO) | (b << ONE) | c


class _Tally:
    """The words and the trie of one language in one task."""

    def __init__(self, lang: str) -> None:
        self.lang = lang
        self.words, self.trie = Words(), Trie()
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        # Places among the waiting words that are counted with the next block.
        self.ahead: list[int] = []
        self.single = np.zeros(0, np.int64)

    def add(self, block: list[bytes], ahead: int) -> None:
        ids = np.fromiter(map(self.words.__getitem__, block), np.int64, len(block))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.ahead += range(self.n_waiting - 1 - ahead, self.n_waiting - 1)
        if self.n_waiting >= CHUNK:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        first = np.concatenate(self.waiting)
        # What follows a word; nothing follows the end of a piece.
        second = np.append(first[1:], 0)
        third = np.append(second[1:], 0)
        first[self.ahead] = 0
        third[second == 0] = 0
        self.waiting, self.n_waiting, self.ahead = [], 0, []
        counts = np.bincount(first, minlength=len(self.words.names))
        counts[: len(self.single)] += self.single
        self.single = counts
        pairs = (first > 0) & (second > 0)
        self.trie.add(_join([first[pairs], second[pairs], third[pairs]]))

    def full(self) -> bool:
        # The next block may bring as many new words as it is long; ids must stay in BITS.
        return len(self.words.names) + self.n_waiting >= (1 << BITS) // 2

    def runs(self, left: int, parts: int) -> Iterator[tuple]:
        """Takes phrases out of the trie until ``left`` stay; with none left, words too."""
        self.settle()
        keys, counts = self.trie.take(left)
        if not left:
            own = np.flatnonzero(self.single[1:]) + 1
            zero = np.zeros(len(own), np.int64)
            keys = np.concatenate([keys, _join([own, zero, zero])])
            counts = np.concatenate([counts, self.single[own]])
        yield from _runs(self.lang, self.words.names, keys, counts, parts)


def _runs(lang: str, names: list[bytes], keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    if not len(keys):
        return
    ids = _split(keys)
    used = np.unique(np.concatenate(ids))
    used = used[used > 0].tolist()
    used.sort(key=names.__getitem__)
    rank, prefix = np.zeros(len(names), np.int64), np.zeros(len(names), np.uint64)
    rank[used] = np.arange(1, len(used) + 1)
    prefix[used] = [xxhash.xxh64_intdigest(names[i]) for i in used]
    mixed = prefix[ids[0]] * np.uint64(0x9E3779B97F4A7C15) + prefix[ids[1]]
    part = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int32)
    ids = [rank[x] for x in ids]
    order = np.lexsort((ids[2], ids[1], ids[0], part))
    part, counts, ids = part[order], counts[order], [x[order] for x in ids]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for begin, end in zip(cuts, cuts[1:]):
        own = [x[begin:end] for x in ids]
        there = np.unique(np.concatenate(own))
        there = there[there > 0]
        ranked = _join([np.searchsorted(there, x, side="right") for x in own])
        words = b" ".join([names[used[i - 1]] for i in there.tolist()])
        yield (
            lang,
            int(part[begin]),
            zstandard.ZstdCompressor(level=1).compress(words),
            _pack(np.diff(ranked, prepend=np.uint64(0))),
            _pack(counts[begin:end]),
        )


def _count(docs: DataFrame, parts: int) -> DataFrame:
    """Sorted runs of all phrases: lang, part, words, keys, counts."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)],
            ["lang", "part", "words", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for block, ahead in blocks(text):
                    tally = tallies.get(lang)
                    if tally is None:
                        tally = tallies[lang] = _Tally(lang)
                    tally.add(block, ahead)
                    if tally.full():
                        yield batch_of(list(tally.runs(0, parts)))
                        del tallies[lang]
                    elif sum(t.trie.entries for t in tallies.values()) > BUDGET:
                        largest = max(tallies.values(), key=lambda t: t.trie.entries)
                        yield batch_of(list(largest.runs(largest.trie.entries // 2, parts)))
        for tally in tallies.values():
            yield batch_of(list(tally.runs(0, parts)))

    return docs.mapInArrow(run, _RUN)


def _merge(key: tuple, runs: pa.Table, least: int) -> pa.Table:
    """The phrases of one partition that occur often enough, and in a row without words
    how many words there are."""
    unzip = zstandard.ZstdDecompressor().decompress
    names = [unzip(x.as_py()).split(b" ") for x in runs["words"]]
    united = sorted(set().union(*names))
    index = {w: i for i, w in enumerate(united, 1)}
    keys = [[], [], []]
    for own, raw in zip(names, runs["keys"]):
        rank = np.array([0, *map(index.__getitem__, own)], np.int64)
        for k, ids in enumerate(_split(np.cumsum(_unpack(raw.as_py()), dtype=np.uint64))):
            keys[k].append(rank[ids])
    first, second, third = (np.concatenate(k) for k in keys)
    counts = np.concatenate([_unpack(x.as_py()).astype(np.int64) for x in runs["counts"]])
    order = np.lexsort((third, second, first))
    first, second, third, counts = (x[order] for x in (first, second, third, counts))

    def summed(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.zeros(len(counts), bool)
        new[0] = True
        for x in by:
            new[1:] |= x[1:] != x[:-1]
        begins = np.flatnonzero(new)
        return begins, np.add.reduceat(counts, begins)

    ids, sums = [], []
    # Pairs with all that follows them, and words, whose second word is none.
    begins, n = summed(first, second)
    keep = n >= least
    ids.append(np.stack([first[begins], second[begins], np.zeros_like(begins)], axis=1)[keep])
    sums.append(n[keep])
    begins, n = summed(first, second, third)
    keep = (n >= least) & (third[begins] > 0)
    ids.append(np.stack([first[begins], second[begins], third[begins]], axis=1)[keep])
    sums.append(n[keep])
    ids.append(np.zeros((1, 3), np.int64))
    sums.append(counts[second == 0].sum(keepdims=True))
    table = np.concatenate(ids)
    columns = [
        pa.array([united[i - 1] if i else None for i in table[:, k].tolist()], pa.binary()).cast(pa.string())
        for k in range(3)
    ]
    lang = pa.array([key[0].as_py()] * len(table), pa.string())
    return pa.table([lang, *columns, pa.array(np.concatenate(sums))], ["lang", "w1", "w2", "w3", "f"])


def phrase_counts(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST
) -> DataFrame:
    """lang, w1, w2, w3, f: words and phrases of two and three words that occur ``least``
    times or more, absent words NULL; rows without any word have the number of all words
    in parts, to be summed."""
    rows = docs.select(
        F.coalesce(named(lang_col), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(named(text_col), F.lit("")).cast("binary").alias("text"),
    )
    # As many prefix partitions as the input has splits: they grow with it.
    parts = max(8, docs.rdd.getNumPartitions())
    counted = _count(rows, parts)
    return counted.groupBy("lang", "part").applyInArrow(
        lambda key, runs: _merge(key, runs, least),
        "lang string, w1 string, w2 string, w3 string, f long",
    )


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in 38 digits: counts to 10**15."""
    a, left, right = (x.cast("decimal(15, 0)") for x in (a, left, right))
    over = (a * a).cast("decimal(31, 0)") * F.lit(1_000_000).cast("decimal(7, 0)")
    return F.call_function("div", over, left * right)


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    cover_percent: int = COVER_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = settle(phrase_counts(docs, lang_col, text_col, least), "phrases")
    n = counts.where("w1 IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    one = counts.where("w1 IS NOT NULL AND w2 IS NULL").select("lang", "w1", "f")
    two = counts.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", "f")
    three = counts.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    covers = (
        three.select("lang", "w1", "w2", "a")
        .unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("lang", "w1", "w2")
        .agg(F.max("a").alias("longer"))
    )
    pairs = (
        two.withColumnRenamed("f", "a")
        .join(covers, ["lang", "w1", "w2"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
        .join(one.toDF("lang", "w1", "l"), ["lang", "w1"])
        .join(one.toDF("lang", "w2", "r"), ["lang", "w2"])
        .select(
            "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r",
            _score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
        )
    )
    cuts = (
        three.join(one.toDF("lang", "w1", "l1"), ["lang", "w1"])
        .join(one.toDF("lang", "w3", "r2"), ["lang", "w3"])
        .join(two.toDF("lang", "w1", "w2", "l2"), ["lang", "w1", "w2"])
        .join(two.toDF("lang", "w2", "w3", "r1"), ["lang", "w2", "w3"])
        .select(
            "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l1", "r1", "l2", "r2",
            _score(F.col("a"), F.col("l1"), F.col("r1")).alias("s1"),
            _score(F.col("a"), F.col("l2"), F.col("r2")).alias("s2"),
        )
    )
    earlier = F.col("s1") <= F.col("s2")
    triples = cuts.select(
        "lang", "phrase", "a",
        F.when(earlier, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(earlier, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Each part of a language hands on its best, so no task orders all of one language.
    dealt = pairs.unionByName(triples).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    ranked = dealt.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))
    ).where(F.col("rank") <= top)
    final = ranked.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    ).where(F.col("rank") <= top)
    return final.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
