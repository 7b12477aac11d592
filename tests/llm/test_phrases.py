"""The trie of phrases and its runs against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from muster.llm import phrases


def simple(rows, least, cover, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            longer = [
                m for other, m in f.items()
                if len(other) == 3 and len(phrase) == 2 and m >= least
                and phrase in (other[:2], other[1:])
            ]
            if any(100 * m >= cover * a for m in longer):
                continue
            score, _, left, right = min(
                (10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]])
                for k in range(1, len(phrase))
            )
            found.append((-score, -a, " ".join(phrase).encode(), left, right))
        found.sort()
        for rank, (score, a, phrase, left, right) in enumerate(found[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(rng, n, words, length):
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(length))]
        yield "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "\x0b", ".", "!? "]) for w in own)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["a", "B", "the", "The", "é", "漢字", "\x1c", "x-y", "\x00z", *(f"w{i}" for i in range(25))]
    out = [(rng.choice(["en", "en", "de", None, ""]), t) for t in texts(rng, 300, words, 200)]
    out += [("en", None), (None, ""), ("fr", " \t "), ("it", "one two three"), ("fr", "a b " * 3_000)]
    return out + out[:5]


def test_against_plain_counts(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    for name in ("w1", "f", "rank", "phrase", "part", "x.y", "n"):
        df = df.withColumn(name, df["text"])
    for least, cover, top in ((10, 50, 2_000), (2, 90, 40)):
        got = phrases.collocations(df, least=least, cover_percent=cover, top=top).collect()
        assert sorted(map(tuple, got)) == simple(rows, least, cover, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_small_containers_blocks_and_budget(spark, rows, monkeypatch):
    """The same where containers burst, subtrees leave early and texts are cut."""
    seen = phrases._count
    some = rows[:60] + rows[-10:]
    texts = spark.createDataFrame(some, "lang string, text string").repartition(3)

    def small(docs, parts):
        # The settings hold in the task, whatever module it reads them from.
        def run(batches):
            phrases.BUDGET, phrases.BLOCK, phrases.CHUNK, phrases.BURST = 500, 64, 128, 16
            phrases.Trie.__init__.__defaults__ = (16,)
            found = []
            monkey = lambda f, schema: found.append(f)
            seen(type("Docs", (), {"mapInArrow": staticmethod(monkey)})(), parts)
            yield from found[0](batches)

        return docs.mapInArrow(run, phrases._RUN)

    monkeypatch.setattr(phrases, "_count", small)
    got = phrases.collocations(texts, least=2).collect()
    assert sorted(map(tuple, got)) == simple(some, 2, 50, 2_000)


def test_trie_counts_and_spills_whole_subtrees():
    rng = np.random.default_rng(9)
    keys = phrases._join([rng.integers(1, 5, 4_000) ** 2, rng.integers(1, 30, 4_000), rng.integers(0, 30, 4_000)])
    trie, want = phrases.Trie(burst=32), Counter(keys.tolist())
    for part in np.array_split(keys, 7):
        trie.add(part)
    assert trie.entries == len(want) and len(trie.containers) > 50
    low, high = trie.bounds, [*trie.bounds[1:].tolist(), 1 << 63]
    for container, a, b in zip(trie.containers, low.tolist(), high):
        assert all(a <= k < b for k in container)
    taken, counts = trie.take(trie.entries // 2)
    first = {k >> 42 for k in taken.tolist()}
    left = {k: n for c in trie.containers for k, n in c.items()}
    assert not first & {k >> 42 for k in left} and trie.entries == len(left) <= len(want) // 2
    assert {**left, **dict(zip(taken.tolist(), counts.tolist()))} == want


def test_packed_numbers():
    values = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (phrases._unpack(phrases._pack(values)) == values).all()
    assert len(phrases._unpack(phrases._pack(values[:0]))) == 0
