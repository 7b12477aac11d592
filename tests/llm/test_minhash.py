"""Circulant MinHash and the components of exact links against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import minhash


def simple_set(text, length=2):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    length = min(length, len(words))
    return {" ".join(words[i : i + length]) for i in range(len(words) - length + 1)}


def simple_rows(rows):
    sets = [simple_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[root(j)] = root(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [k for j, (k, _) in enumerate(rows) if root(j) == root(i) and k is not None]
        least = min(ids, default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def near_copies(rng, n, start, words=60, edits=2, chain=False):
    """Copies with a few words changed; in a chain each is a copy of the one before."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        yield start + i, " ".join(copy)
        if chain:
            base = copy


ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "Hello"),
    (5, "hello"),
    (6, "hello hello"),
    (7, "HELLO hello hello"),
    (None, "hello"),
    (8, "É é"),
    (9, "é é"),
    (10, "one two"),
    (10, "one two"),
    (None, None),
    (None, "no other has these words"),
    (11, " ".join(f"w{i % 977}" for i in range(30_000))),
    (12, " ".join(f"w{i % 977}" for i in range(20_000)) + " tail"),
]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("digest", "bands", "node", "key", "label", "text_key", "x.y", "rep"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr)
    assert got == simple_rows(rows)


def test_small_texts(spark):
    check(spark, ROWS)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(empty.unionByName(empty)).columns == [
        "doc_id", "n_shingles", "component_id", "kept",
    ]


def test_groups_and_chains(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(80)))) for i in range(300)]
    rows += near_copies(rng, 150, 1_000, edits=5)
    rows += near_copies(rng, 60, 2_000, chain=True)
    rows += near_copies(rng, 40, 3_000, words=12)
    rows += [(4_000 + i, rows[i % 7][1]) for i in range(40)]
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("stars, tile", [(0, 4_096), (1, 1_024)])
def test_tiles_lose_nothing(spark, monkeypatch, stars, tile):
    """Without leaders, and with tiles of a few sets, the answer is the same."""
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = random.Random(4)
    rows = [*near_copies(rng, 120, 0, edits=8), *near_copies(rng, 30, 500, chain=True), *ROWS]
    check(spark, rows)


def test_signatures_estimate_similarity():
    """Coordinates agree as often as the sets are similar, shifted or not."""
    rng = np.random.default_rng(5)
    for share in (0.3, 0.8):
        both = 400
        pool = minhash.sigma(rng.integers(0, 2**63, 3 * both, dtype=np.int64).view(np.uint64))
        union = int(both / share)
        cut = (union - both) // 2
        a = np.sort(np.concatenate([pool[:both], pool[both : both + cut]]))
        b = np.sort(np.concatenate([pool[:both], pool[both + cut : both + 2 * cut]]))
        signature = minhash.signatures([a, b, a], 2_000)
        assert abs((signature[:, 0] == signature[:, 1]).mean() - share) < 0.04
        assert (signature[:, 0] == signature[:, 2]).all()


def test_signatures_over_chunks(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 700, 3, 2_000, 1, 64, 64)]
    whole = minhash.signatures(sets, 8)
    monkeypatch.setattr(minhash, "CHUNK", 64)
    assert (minhash.signatures(sets, 8) == whole).all()
    for k in range(8):
        for i, s in enumerate(sets):
            one = minhash.pi(s - np.uint64(k), np.empty_like(s), np.empty_like(s))
            assert whole[k, i] == one.min()


def test_near_pairs():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(80)]
    got = minhash.near_pairs(sets[:40], sets[40:])
    for i, a in enumerate(sets[:40]):
        for j, b in enumerate(sets[40:]):
            shared = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * shared >= 80 * (len(a) + len(b) - shared))
