"""Runs against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from muster.llm import periodic

FOLDER = "/root/testdata/sf0.001"


def simple_runs(words):
    """Every maximal stretch of a period, kept where no smaller period fits all of it."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q):
                own = words[start : start + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    found.append((start, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def simple_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simple_row(doc_id, text):
    words = simple_words(text)
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = simple_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id,
        len(runs),
        *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4),
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(2_000):
        letters = rng.choice([1, 2, 2, 3, 4, 9])
        words = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, 8))]
            words += (part * 9)[: rng.randrange(1, 60)] + [rng.randrange(letters)] * 2
        assert periodic.find_runs(words) == simple_runs(words), words


def test_squares_have_the_smallest_period_and_are_whole():
    """Every run of exponent 2 or more is met where its first square ends."""
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.randrange(3) for _ in range(rng.randrange(40))]
        met = {(i, d): length for i, d, length in periodic.squares(words)}
        for q in range(1, len(words) // 2 + 1):
            for end in range(2 * q - 1, len(words)):
                same = 0
                while end - q - same >= 0 and words[end - same] == words[end - q - same]:
                    same += 1
                own = words[end - 2 * q + 1 : end + 1]
                least = same >= q and not any(own[p:] == own[:-p] for p in range(1, q))
                assert met.get((end, q)) == (same if least else None)


ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "a a a a a a"),
    (4, "a a a a a a"),
    (5, "x a b a b a b a b y\x1cz a  a\na a a a a"),
    (6, "é 漢 é 漢 é 漢 é 漢 é"),
    (None, "q r " * 5),
    (7, " ".join(f"w{i % 700}" for i in range(20_000))),
    (8, "a a a a a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Ids that have their tails repeated are among these.
    rows = ROWS + [(i, " ".join("abcdefgh"[j * i % 8] for j in range(i % 50))) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("runs", "collapsed", "start", "length", "period", "x.y", "longest"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_query_against_brute_force(docs):
    # The longest text is too slow for brute force.
    small = docs.where("doc_id IS NULL OR doc_id <> 7")
    got = periodic.summary(periodic.runs(periodic.repeat_tails(small))).collect()
    want = [simple_row(r.doc_id, r.text) for r in small.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 200))


def test_long_and_empty(docs):
    (row,) = periodic.runs(docs.where("doc_id = 7")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 20_000, 700)]
    assert row.collapsed == " ".join(f"w{i}" for i in range(700))
    assert periodic.summary(periodic.runs(periodic.repeat_tails(docs.limit(0)))).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 4000")
    got = periodic.summary(periodic.runs(periodic.repeat_tails(docs))).collect()
    want = [simple_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_runs > 0 for r in got) > 5
