"""Runs: stretches of words that repeat with a period, found online in every whole text.

A suffix automaton takes the words of a text one by one.  Its suffix links form a tree in
which the strings that end at the word just read are the path from the newest state to the
root, and a link-cut forest over that tree keeps, for each state, where its strings ended
last: states of equal last end are preferred paths, so one ``access`` recolours the path of
the new word and meets every former colour once, with the longest string that had it.  If
a string of length ``L`` ended ``d`` words ago and ``d <= L``, a square of period ``d`` ends
here; it is the smallest period there, since a string that also repeats sooner would have
the later end.  ``L`` also says where the run begins; its end is found by comparing on.

Before that, words no run can hold are cut away: a run of length ``max(6, 4 * period)`` or
more holds each of its three-word strings three times or more, so a text falls into the
stretches whose every three-word string occurs three times in that stretch.  What a run
reaches is never cut, so the runs of the stretches are those of the text.

Defined results: NULL and empty texts and texts of white space have no run and collapse to
the empty text; a run may overlap others; repeated rows each give a row; ids of any type,
NULL too, are handed on; other columns are not read.  Memory grows with the longest such
stretch of one text, not with the table; a text is one row and never leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import let, named, words_of

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# Three-word strings of a run: each occurs so often, and so many stand in a row.
GRAM = 3
GRAM_COUNT = 3
# Rows of one batch handed back.
ROWS = 1_024
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, period, length): the string of ``length >= period`` words ending at word
    ``end`` ended ``period`` words before for the last time, and no longer one did."""
    # The automaton; state 0 is nothing, state 1 the empty string.
    moves: list[dict[int, int]] = [{}, {}]
    link, size = [0, 0], [0, 0]
    # The link-cut forest; `ended` holds for a whole preferred path, at its splay root.
    left, right, up, ended = [0, 0], [0, 0], [0, 0], [-1, -1]

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        else:
            ended[x] = ended[p]
        if left[p] == x:
            child = right[x]
            left[p], right[x] = child, p
        else:
            child = left[x]
            right[p], left[x] = child, p
        if child:
            up[child] = p
        up[p], up[x] = x, g

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def state(length: int) -> int:
        size.append(length)
        link.append(0)
        left.append(0)
        right.append(0)
        up.append(0)
        ended.append(-1)
        return len(size) - 1

    newest = 1
    for i, word in enumerate(words):
        current = state(i + 1)
        moves.append({})
        p = newest
        while p and word not in moves[p]:
            moves[p][word] = current
            p = link[p]
        if not p:
            link[current] = 1
        else:
            q = moves[p][word]
            if size[q] == size[p] + 1:
                link[current] = q
            else:
                # The shorter strings of q become a state of their own, above q on its path.
                copy = state(size[p] + 1)
                moves.append(moves[q].copy())
                link[copy], link[q], link[current] = link[q], copy, copy
                while p and moves[p].get(word) == q:
                    moves[p][word] = copy
                    p = link[p]
                splay(q)
                above = left[q]
                left[copy], left[q], up[copy] = above, copy, q
                if above:
                    up[above] = copy
        up[current] = link[current]
        # Access: the path from the newest state to the root gets the colour i.
        below, x = 0, current
        while x:
            splay(x)
            colour = ended[x]
            if colour >= 0 and i - colour <= size[x]:
                yield i, i - colour, size[x]
            if right[x]:
                ended[right[x]] = colour
            right[x] = below
            below, x = x, up[x]
        ended[below] = i
        splay(current)
        newest = current


def _stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """The parts (begin, end) of a text that runs can lie in."""
    todo = [(0, len(ids))]
    while todo:
        begin, end = todo.pop()
        if end - begin < LEAST_LENGTH:
            continue
        part = ids[begin:end].astype(np.uint64)
        grams = (part[:-2] * np.uint64(0x9E3779B97F4A7C15) + part[1:-1]) * np.uint64(
            0xC2B2AE3D27D4EB4F
        ) + part[2:]
        _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
        often = np.zeros(len(grams) + 2, np.int8)
        often[1:-1] = counts[which] >= GRAM_COUNT
        steps = np.diff(often)
        begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        if len(begins) == 1 and begins[0] == 0 and ends[0] == len(grams):
            yield begin, end
            continue
        for b, e in zip(begins.tolist(), ends.tolist()):
            todo.append((begin + b, begin + e + GRAM - 1))


def _agree(ids: np.ndarray, at: int, period: int) -> int:
    """The first word from ``at`` on that differs from the one a period before."""
    step = 64
    while at < len(ids):
        ahead = ids[at : at + step]
        differ = ahead != ids[at - period : at - period + len(ahead)]
        if differ.any():
            return at + int(differ.argmax())
        at += len(ahead)
        step *= 2
    return at


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of words, in that order."""
    if len(words) < LEAST_LENGTH:
        return []
    first: dict = {}
    ids = np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))
    if len(first) * 2 > len(words) and np.bincount(ids).max() < LEAST_EXPONENT:
        return []
    found = []
    for begin, end in _stretches(ids):
        part = ids[begin:end]
        known: dict[int, int] = {}
        for i, period, length in squares(part.tolist()):
            if i <= known.get(period, -1):
                continue
            start, stop = i - period - length + 1, _agree(part, i + 1, period)
            known[period] = stop - 1
            if stop - start >= max(LEAST_LENGTH, LEAST_EXPONENT * period):
                found.append((begin + start, stop - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those a run repeats: all it contains after its first period."""
    if not runs:
        return words
    repeated = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        repeated[start + period] += 1
        repeated[start + length] -= 1
    kept = np.cumsum(repeated[:-1]) == 0
    return [w for w, keep in zip(words, kept.tolist()) if keep]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, its runs by start and period, and ``collapsed``, the text of
    the words no run repeats, joined by one space."""
    rows = docs.select(
        named(id_col).alias("doc_id"), named(text_col).cast("binary").alias("text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                each, texts = [], []
                for text in batch.column(1).to_pylist():
                    words = (text or b"").split()
                    own = find_runs(words)
                    each.append(own)
                    texts.append(b" ".join(collapse(words, own)))
                offsets = np.cumsum([0, *map(len, each)])
                flat = np.array(list(chain.from_iterable(each)), np.int64).reshape(-1, 3)
                values = pa.StructArray.from_arrays(
                    [pa.array(flat[:, k].copy()) for k in range(3)], fields=list(_RUN)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "runs", "collapsed"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, runs {RUNS}, collapsed string")


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, in which one document of ten repeats its last words.

    With h the crc32 of the decimal id and g its tenth: where h ends in 0, word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).  A NULL
    id has no h, and a text without words stays as it is.
    """
    h = F.crc32(named(id_col).cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        begin = F.pmod(g, n).cast("int")

        def planted(place: Column) -> Column:
            a, p = place["a"], place["p"]
            return F.transform(
                words,
                lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + F.pmod(i - a, p))),
            )

        period = (1 + F.floor((n - begin) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(let(F.struct(begin.alias("a"), period.alias("p")), planted), " ")

    text = named(text_col)
    has_words = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return docs.select(
        named(id_col).alias("doc_id"),
        F.when((h % 10 == 0) & has_words, let(words_of(text), repeated))
        .otherwise(text)
        .alias("text"),
    )


def summary(found: DataFrame) -> DataFrame:
    """Per document: the number of runs, the longest one, and digests of all runs and of
    the collapsed text."""
    longest = F.array_min(
        F.transform(
            "runs",
            lambda r: F.struct(
                (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")
            ),
        )
    )
    length = -F.col("longest.less")
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
