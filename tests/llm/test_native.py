"""Quality rules, shards, mix, licences and chat against brute force on small tables."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from muster.llm import chat, licenses, mix, quality, shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (0, "one two three", "a"),
    (1, None, "a"),
    (2, "", "b"),
    (3, " \t\n", None),
    (4, LONG, "c"),
    (5, "x y\nx y\n\n  \nx y", "c"),
    (5, "x y\nx y\n\n  \nx y", "c"),
    (6, "a b c d e f g h a b c d e f g h", "b"),
    (7, "é # $ %% | <tag> 漢字 😀 \x0bword", "ä"),
    (None, "no id at all", None),
    (8, "a " * 500, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Also columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for name in ("size", "words", "shard", "slot", "row", "place", "kept", "score", "x.y"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts(docs):
    got = rows_of(quality.base_counts(docs).drop("text"))
    assert got == sorted(((i, *base(t)) for i, t, _ in ROWS), key=repr)


def test_base_counts_on_real_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in quality.base_counts(table).drop("text").collect()}
    assert got == {r.doc_id: base(r.text) for r in table.collect()}


def test_verdicts(spark):
    good = " ".join(f"word{i % 40} runs on, quietly" for i in range(30))
    bad = " ".join(f"word{i}###" for i in range(60))
    table = spark.createDataFrame(
        [(i, good + f" {i}") for i in range(30)] + [(90, bad), (91, bad), (92, None), (93, "short")],
        "doc_id long, text string",
    )
    trusted = spark.createDataFrame([(i,) for i in range(0, 30, 2)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in quality.judge(table, trusted, prior=50).collect()}
    assert all(got[i].kept and not got[i].base_failed for i in range(30) if not base(good)[5])
    assert got[90].ratio < -1 and not got[90].kept and not got[90].base_failed
    assert got[92].base_failed and got[93].base_failed
    nobody = quality.judge(table, trusted.limit(0)).collect()
    assert all(r.ratio == 0 for r in nobody) and got.keys() == {r.doc_id for r in nobody}
    kept = quality.keep_good(table, trusted, prior=50)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge(table.limit(0), trusted).count() == 0


def test_every_trusted_document_counts(spark):
    """None of many ids is left out; repeated and NULL ones count once and not at all."""
    assert quality.trusted_ids(spark.range(50_010).toDF("doc_id")).count() == 50_010
    table = spark.createDataFrame(
        [(i, f"w{i} all") for i in range(60)] + [(None, "nobody")], "doc_id long, text string"
    )
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)] * 2 + [(None,)], "doc_id long")
    whole = quality.bucket_weights(table, trusted)
    assert whole == quality.bucket_weights(table, trusted.where("doc_id IS NOT NULL").distinct())
    assert whole != quality.bucket_weights(table, trusted.where("doc_id < 50"))


def test_ratio_is_the_hashed_ratio(spark):
    import math

    import xxhash

    texts = {1: "ab cd, ab", 2: "cd ef ef", 3: "zz ## zz"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = quality.bucket_weights(table, table.where("doc_id < 3"), buckets=64, prior=5.0)

    def grams(text):
        tokens = re.findall(r"[^\W]+|[^\w\s]+", text)
        hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
        pairs = []
        for a, b in zip(hashes, hashes[1:]):  # a chain: the first hash seeds the second
            seed = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)
            pairs.append(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed))
        signed = [h - (h >= 2**63) * 2**64 for h in hashes + pairs]
        return [h % 64 for h in signed]

    raw = collections.Counter(g for t in texts.values() for g in grams(t))
    good = collections.Counter(g for i in (1, 2) for g in grams(texts[i]))
    n, m = sum(raw.values()), sum(good.values())
    for b, c in raw.items():
        want = math.log((good[b] + 5 * c / n) / (m + 5) / (c / n))
        assert weights[b] == round(want * 1e6)


def test_shards(docs):
    got = shard.assign_shards(docs, 3).collect()
    want = collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS
    )
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = sorted(want.elements(), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, out, slots = sum(r[1] for r in order), 0, [], collections.Counter()
    for r in order:
        k = 3 * (2 * before + r[1]) // (2 * total)
        out.append((*r, k, slots[k]))
        slots[k] += 1
        before += r[1]
    assert sorted(map(tuple, got), key=repr) == sorted(out, key=repr)
    assert shard.assign_shards(docs.limit(0), 3).count() == 0


def test_shard_files(spark, docs, tmp_path):
    spark.read  # the table on disk is what the assignment says
    table = spark.createDataFrame(
        [(i, "t" * (i % 7 * 10)) for i in range(100)], "doc_id long, text string"
    )
    shard.write_shards(table, str(tmp_path / "out"), 4)
    want = {(r.doc_id, r.shard) for r in shard.assign_shards(table, 4).collect()}
    got = {(r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and len({s for _, s in got}) == 4


def test_shard_files_of_shared_and_missing_ids(spark, tmp_path):
    ids = [5] * 100 + [None] * 100 + list(range(100))
    table = spark.createDataFrame(
        [(i, "t" * (k % 7 * 10), k) for k, i in enumerate(ids)],
        "doc_id long, text string, _row long",
    )
    shard.write_shards(table, str(tmp_path / "out"), 8)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r._row for r in got) == list(range(300))
    want = collections.Counter((r.doc_id, r.size, r.shard) for r in shard.assign_shards(table, 8).collect())
    assert collections.Counter((r.doc_id, len(r.text) + 1, r.shard) for r in got) == want
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += len(r.text) + 1
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 61


def targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """By resharing what is cut off until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > limit * sizes[s]]
        if not over:
            out.update({s: weight[s] * level for s in free})
            break
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def check_mix(rows, got, block):
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = targets(size)
    by_key = collections.defaultdict(list)
    for r in got:
        by_key[r.doc_id].append(r)
    taken = collections.Counter()
    for i, t, s in rows:
        r = next(x for x in by_key[i] if x.size == len(WORD.findall(t or "")))
        by_key[i].remove(r)
        assert r.source_size == size[s] and r.target == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert not any(by_key.values())
    for s in size:
        assert abs(taken[s] - want[s]) <= block
    return taken


def test_mix_small(docs):
    got = mix.mix_taken(docs, block_words=4).collect()
    check_mix(ROWS, got, 4)
    assert rows_of(mix.mix_taken(docs.repartition(5), block_words=4)) == sorted(map(tuple, got), key=repr)
    assert mix.mix_taken(docs.limit(0)).count() == 0


def test_mix_hot_source_and_draws(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i % 50)), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(rows, mix.mix_taken(table, block_words=16).collect(), 16)
    _, _, slots = mix.mix_plan(table, block_words=16, shard_slots=50)
    drawn = slots.collect()
    assert len({(r.shard, r["slot"]) for r in drawn}) == len(drawn)
    assert {r["slot"] for r in drawn if r["shard"] == 0} == set(range(50))
    per_pass = collections.Counter((r.place, r["pass"], r.block) for r in drawn)
    assert set(per_pass.values()) == {1}  # a permutation takes no block twice in one pass


def test_mix_documents(spark):
    rows = [(i, f" d{i} starts\nhere " + " ".join(f"w{i}-{k}" for k in range(i * 3 % 40)), f"s{i % 4}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    out = mix.mix_documents(table, block_words=8)
    assert out.columns == table.columns
    got = collections.Counter()
    texts = {i: t for i, t, _ in rows}
    for r in out.collect():
        words = WORD.findall(r.text)
        got[r.doc_id] += len(words)
        assert set(words) <= set(WORD.findall(texts[r.doc_id])) and r.n_chars == len(r.text)
        if len(words) == len(WORD.findall(texts[r.doc_id])):
            assert r.text == texts[r.doc_id]
    taken = {r.doc_id: r.taken for r in mix.mix_taken(table, block_words=8).collect() if r.taken}
    assert got == taken


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        x = spark.range(n).select(mix.permute(F.col("id"), F.lit(n).cast("long"), F.lit("s")).alias("p"))
        assert sorted(r.p for r in x.collect()) == list(range(n))


def test_licenses(spark):
    mit = [s for n, s in licenses.SENTENCES if n in ("MITGrant", "MITNotice", "MITWarranty")]
    rows = [
        (1, "Foo bar.\nReleased under the MIT License.\nThe end"),
        (2, "All rights reserved"),
        (3, None),
        (4, ""),
        (5, "We once discussed the MIT license at length."),
        (6, ". ".join(s.capitalize() for s in mit) + "."),
        (7, "Licensed under CC BY-NC 4.0. " * 2 + "x" * 100_000),
        (8, "see the GNU General Public License for more details."),
        (None, "Licensed under the Apache License, Version 2.0. All rights reserved."),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    got = {r.doc_id: (list(r.licenses), list(r.rest)) for r in licenses.scan_licenses(table).collect()}
    assert got == {
        1: (["MIT"], []),
        2: (["LicenseRef-all-rights-reserved"], []),
        3: ([], []),
        4: ([], []),
        5: ([], []),
        6: (["MIT"], []),
        7: (["CC-BY-NC-4.0"], []),
        8: ([], ["GPLSee"]),
        None: (["Apache-2.0", "LicenseRef-all-rights-reserved"], []),
    }
    assert licenses.scan_licenses(table.limit(0)).count() == 0


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.
""",
    "LicenseRef-all-rights-reserved,BSD-4-Clause": """Copyright (c) 2020, Jane Roe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
     This product includes software developed by the project.
4. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "GPL-2.0-or-later": """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License along
 * with this program; if not, write to the Free Software Foundation, Inc.,
 * 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
 */
""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
""",
    # A blank line and the end of a sentence are never run across; dots in a row are quick.
    "": "Released under\n\nthe MIT License. Released under. The MIT License" + "." * 200_000,
}


def test_original_notices_wrapped_and_on_one_line(spark):
    rows = [(name, text) for name, text in NOTICES.items()]
    rows += [(name, text.replace("\n", "\r\n")) for name, text in NOTICES.items()]
    flat = ("GPL-3.0-or-later", "LGPL-2.1-or-later", "MPL-2.0")
    rows += [(name, " ".join(NOTICES[name].split())) for name in flat]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    for r in licenses.scan_licenses(table).collect():
        assert sorted(r.licenses) == sorted(r.doc_id.split(",") if r.doc_id else [])
        assert r.rest == []


def test_license_tables():
    names = {n for n, _ in licenses.SENTENCES}
    assert {i for _, needs in licenses.RULES for i in needs} <= names
    assert all(re.search(licenses.HINT, s) for _, s in licenses.SENTENCES)
    assert all(re.sub(licenses.NOISE, " ", s) == s for _, s in licenses.SENTENCES)


def test_rotation(spark):
    turns = [
        (1, 0, "system", "be brief"),
        (1, 1, "Ann", "hi"),
        (1, 2, "Bob Lee", "hello\nthere"),
        (1, 3, "Ann", None),
        (1, 3, None, "who"),
        (2, 0, "system", "alone"),
        (None, 0, "x", "é😀"),
        (3, None, "", "t" * 50_000),
        (3, None, "", "t" * 50_000),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    table = table.withColumn("perspective", F.lit("clash")).withColumn("chars", F.lit(1))
    segments = chat.rotate(table)
    whole = {(r.conv_id, r.perspective): r for r in chat.dialogues(segments).collect()}
    assert set(whole) == {(1, "Ann"), (1, "Bob_Lee"), (1, "unknown"), (None, "x"), (3, "unknown")}
    got = whole[1, "Bob_Lee"]
    assert got.text == (
        "<|im_start|>system\nbe brief<|im_end|>\n"
        "<|im_start|>user name=Ann\nhi<|im_end|>\n"
        "<|im_start|>assistant\nhello\nthere<|im_end|>\n"
        "<|im_start|>user name=Ann\n<|im_end|>\n"
        "<|im_start|>user name=unknown\nwho<|im_end|>\n"
    )
    assert [got.text[m.start : m.end] for m in got.mask] == ["hello\nthere<|im_end|>"]
    assert [whole[1, "Ann"].text[m.start : m.end] for m in whole[1, "Ann"].mask] == ["hi<|im_end|>", "<|im_end|>"]
    for r in segments.collect():
        text = whole[r.conv_id, r.perspective].text
        assert text[r.segment_start : r.segment_end] == r.segment
    assert len(whole[3, "unknown"].mask) == 2
    clash = [(1, i, role, f"t{i}") for i, role in enumerate(
        ["a b", "a_b", "a\tb", None, "unknown", "", "a b", "system", "plain"])]
    clash.append((2, 0, "a_b", "other"))
    rows = chat.rotate(spark.createDataFrame(clash, "conv_id long, turn long, role string, text string")).collect()
    own = {(r.conv_id, r.perspective): {r2.turn for r2 in rows if r2.learn and (r2.conv_id, r2.perspective) == (r.conv_id, r.perspective)} for r in rows}
    assert own == {
        (1, "a_b"): {2}, (1, "a_b 2"): {0, 6}, (1, "a_b 3"): {1}, (1, "unknown"): {3},
        (1, "unknown 2"): {5}, (1, "unknown 3"): {4}, (1, "plain"): {8}, (2, "a_b"): {0},
    }
    assert chat.rotate(table.limit(0)).count() == 0
