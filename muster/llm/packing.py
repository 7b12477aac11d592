"""Best-fit packing of token pieces into sequences, large items matched first.

Documents are tokenised inside tasks and cut into pieces of at most ``capacity`` tokens.
What decides a packing is only how many pieces there are of each length, so the driver
plans on that histogram, which has ``capacity`` entries at most, whatever the number of
documents.  Lengths above a third of the capacity are matched greedily, the longest with
the longest that still fits, two to a bin at most; shorter ones, in falling order, go to
the bins whose gap fits best, and to new bins when none is wide enough.  The plan says for
the n-th piece of a length which sequence and offset it takes.  Pieces are numbered by
length across the table without a sort: each input partition counts its own, and the
counts of partitions, summed up, give the offsets.

Tokens of a text are the concatenated tokens of its white-space-separated words, which
holds for tokenizers that drop white space and never join across it; distinct words are
tokenised once per worker process, as far as a cache of bounded size holds them.

Defined results: NULL and empty texts are one piece, the end token; equal rows are packed
each; a NULL id is kept; only documents longer than the capacity are cut; empty tables
give no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import named, settle

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 400_000
BAR = "|"
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"
TOKENIZER = "word_bpe_49k.json"


class WordTokens(dict):
    """Token ids of words (both UTF-8 or little-endian unsigned 32-bit bytes).

    Two generations: when the younger one holds ``most`` words it becomes the elder, and
    the words of the elder that do not come again are forgotten.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.elder: dict[bytes, bytes] = {}
        bar = self._ids(BAR)
        self.bar = bar[0] if len(bar) == 1 else None
        # Upper-case ASCII may be lowered beforehand if the tokenizer does so anyway.
        self.lowers = self._ids("Ab aB") .tobytes() == self._ids("ab ab").tobytes()
        # Marks at the end of a word are tokenised apart if the tokenizer parts them.
        self.parts = (
            self._ids("ab.").tobytes() == self._ids("ab .").tobytes()
            and self._ids("a###").tobytes() == self._ids("a ###").tobytes()
        )

        probes = ("a", "the", "theingered", "zqxjkvw", "tionality")
        self.direct = all(
            [t.id for t in self.tokenizer.model.tokenize(w)] == self._ids(w).tolist() for w in probes
        )

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: set[bytes]) -> None:
        """Get to know the words that are not known yet."""
        if len(self) > self.most:
            self.elder = dict(self)
            self.clear()
        recall = self.elder.get
        new = []
        for w in words:
            if w not in self:
                known = recall(w)
                if known is None:
                    new.append(w)
                else:
                    self[w] = known
        ends = []
        wanted = set()
        for w in new:
            core = w.rstrip(MARKS) if self.parts else w
            if core and len(core) < len(w) and core[-1:].isalpha() and b"<|" not in w:
                ends.append((w, core, w[len(core) :]))
                wanted.add(core)
                wanted.add(w[len(core) :])
            else:
                wanted.add(w)
        unknown = []
        for w in wanted:
            if w not in self:
                known = recall(w)
                if known is None:
                    unknown.append(w)
                else:
                    self[w] = known
        self._tokenise(unknown)
        for w, core, marks in ends:
            self[w] = self[core] + self[marks]

    def _tokenise(self, words: list[bytes]) -> None:
        """Words of small ASCII letters, which no normaliser changes and no rule parts, go
        to the model itself.  The others all in one go: between bars, which stay tokens of
        their own; a word with a bar in it goes alone."""
        plain = []
        model = self.tokenizer.model.tokenize
        for w in words:
            if self.direct and w.isalpha() and w.islower():
                self[w] = b"".join([t.id.to_bytes(4, "little") for t in model(w.decode())])
            elif self.bar is None or BAR.encode() in w:
                self[w] = self._ids(w.decode("utf-8", "replace")).tobytes()
            else:
                plain.append(w)
        if plain:
            ids = self._ids(f" {BAR} ".join([w.decode("utf-8", "replace") for w in plain]))
            ends = np.flatnonzero(ids == self.bar).tolist()
            flat = ids.tobytes()
            for w, begin, end in zip(
                plain, [0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True
            ):
                self[w] = flat[4 * begin : 4 * end]

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        # Marks that join letters, and special tokens, depend on case: left as they are.
        if self.lowers and not (b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw):
            raw = raw.lower()
        words = raw.split()
        try:
            return b"".join(map(self.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return b"".join(map(self.__getitem__, words))


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """The words a worker process knows: its next task goes on with them."""
    return WordTokens(path)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth: the pieces of every document.

    ``nth`` numbers the pieces of one length within the input partition ``part``.
    ``with_ids`` adds the ids themselves (little-endian unsigned 32-bit).
    """
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            owner, out, ids = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = words.encode(text or "") + end
                for piece, at in enumerate(range(0, len(tokens) // 4, capacity)):
                    own = tokens[4 * at : 4 * (at + capacity)]
                    length = len(own) // 4
                    owner.append(row)
                    out.append((piece, at, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids.append(own)
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                *[
                    pa.array([o[k] for o in out], t)
                    for k, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])
                ],
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids"] if with_ids else names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    )
    return rows.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many bins, their lengths in order) for so many pieces of each length.

    Works on counts: equal bins are one entry, however many they are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    large = [n for n in sorted(left, reverse=True) if 3 * n > capacity]
    bins: list[tuple[int, list[int]]] = []
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m + n <= capacity and left[m] > (m == n)), None)
            if mate is None:
                bins.append((left[n], [n]))
                left[n] = 0
            else:
                many = left[n] // 2 if mate == n else min(left[n], left[mate])
                bins.append((many, [n, mate]))
                left[n] -= many
                left[mate] -= many
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    for many, held in bins:
        open_.setdefault(capacity - sum(held), []).append((many, held))
    for n in (n for n in sorted(left, reverse=True) if 3 * n <= capacity):
        gaps = sorted(g for g in open_ if g >= n)
        for gap in gaps:
            per_bin = gap // n
            while left[n] and open_.get(gap):
                many, held = open_[gap].pop()
                full = min(many, left[n] // per_bin)
                if full:
                    _put(open_, capacity, full, held + [n] * per_bin)
                    left[n] -= full * per_bin
                    many -= full
                if many and left[n]:  # fewer than one bin takes
                    _put(open_, capacity, 1, held + [n] * left[n])
                    left[n] = 0
                    many -= 1
                if many:
                    open_[gap].append((many, held))
            if not open_.get(gap):
                open_.pop(gap, None)
            if not left[n]:
                break
        if left[n]:
            per_bin = capacity // n
            full, rest = divmod(left[n], per_bin)
            if full:
                _put(open_, capacity, full, [n] * per_bin)
            if rest:
                _put(open_, capacity, 1, [n] * rest)
            left[n] = 0
    return [b for _, group in sorted(open_.items()) for b in group]


def _put(open_: dict, capacity: int, many: int, held: list[int]) -> None:
    open_.setdefault(capacity - sum(held), []).append((many, held))


def places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of its pieces."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for many, held in bins:
        offset = 0
        for n in held:
            rank = taken.get(n, 0)
            runs.setdefault(n, []).append((rank, sequence, offset))
            taken[n] = rank + many
            offset += n
        sequence += many
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``tokenizer`` is the path of a tokenizer file every executor can read.
    """
    path = tokenizer or str(public_tokenizers.path(TOKENIZER))
    pieces = settle(
        token_pieces(docs, path, capacity, id_col, text_col, end_id, with_ids), "pieces"
    )
    counts = settle(pieces.groupBy("length", "part").count(), "piece-counts")
    histogram = {
        r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()
    }
    where = places(plan_bins(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier")
    )
    # As many rows as lengths in partitions: not to be broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, firsts, offsets_ = where[int(n)]
                run = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at] = firsts[run] + rank[at] - ranks[run]
                offset[at] = offsets_[run]
            kept = batch.select(kept_names)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)],
                [*kept_names, "sequence_id", "offset"],
            )

    kept_names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*kept_names).schema)
    return ranked.select(*kept_names, "rank").mapInArrow(
        place, f"{fields}, sequence_id long, offset long"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of a packing made ``with_ids``: sequence_id, length, ids, documents.

    A sequence holds ``capacity`` tokens at most, so a group is bounded.
    """
    in_order = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), in_order.alias("pieces")
    ).select(
        "sequence_id",
        "length",
        F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("pieces", lambda p: p["doc_id"]).alias("documents"),
    )
