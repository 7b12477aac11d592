"""The pipeline stage by stage against brute force, and the contract of the entry file."""

import collections
import re
import zlib

import numpy as np
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from muster.llm import simhash
from muster.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    numbers = [int(n[2:].split("_")[0]) for n in names]
    assert sorted(numbers) == list(range(1, len(names) + 1)) and len(names) >= 10
    assert "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_sql(spark, name):
    con = oracle.connect(FOLDER)
    assert oracle.differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


def test_queries_run_on_the_smallest_tables(spark):
    columns = {
        "op1_multi_index_hashing": {"query_id", "rank", "vec_id", "score"},
        "op3_mincut_text": {"page_id", "url", "text", "n_chars"},
        "op4_simhash_tiles": {"doc_id", "fingerprint", "component_id"},
        "op5_quality_ngram_ratio": {
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept",
        },
        "op7_positive_unlabelled": {"doc_id", "held_out", "score", "predicted"},
        "op8_byte_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op9_block_mix": {"doc_id", "size", "source_size", "target", "taken"},
        "op10_bestfit_packing": {
            "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
        },
        "op13_runs": {
            "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
            "collapsed_sha256",
        },
    }
    for name, wanted in columns.items():
        assert wanted <= set(QUERIES[name](spark, FOLDER).columns), name


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    by_id = {r.doc_id: r.asDict() for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    (_, rules), (_, classifier), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES

    kept = corpus_pipeline.settle(rules(spark, docs, FOLDER), "test")
    assert kept.columns == docs.columns
    got = rows(kept)
    assert all(by_id[r["doc_id"]] == r for r in got)
    assert all(len(WORD.findall(r["text"])) >= 20 for r in got)
    long_enough = {i for i, r in by_id.items() if len(WORD.findall(r["text"])) >= 20}
    good = {i for i in long_enough if labels.get(i) == 1}
    assert len({r["doc_id"] for r in got} & good) >= 0.95 * len(good)

    judged = corpus_pipeline.settle(classifier(spark, kept, FOLDER), "test")
    assert judged.columns == docs.columns
    left = {r["doc_id"] for r in rows(judged)}
    assert left <= {r["doc_id"] for r in got} and len(left & good) >= 0.95 * len(good)

    once = corpus_pipeline.settle(near(spark, judged, FOLDER), "test")
    prints = {i: simhash.fingerprint(by_id[i]["text"]) for i in sorted(left)}
    groups = {i: i for i in prints}

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                groups[y] = x
    assert sorted(r["doc_id"] for r in rows(once)) == sorted({root(i) for i in prints})

    mixed = corpus_pipeline.settle(mix(spark, once, FOLDER), "test")
    assert mixed.columns == docs.columns
    taken, sizes = collections.Counter(), collections.Counter()
    for r in rows(mixed):
        words = WORD.findall(r["text"])
        taken[r["source"]] += len(words)
        assert r["n_chars"] == len(r["text"]) and set(words) <= set(WORD.findall(by_id[r["doc_id"]]["text"]))
    for r in rows(once):
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 64 * len(sizes)
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = collections.Counter()
    for r in rows(mixed):
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[r["doc_id"], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    packed = rows(pack(spark, mixed, FOLDER))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert collections.Counter(tuple(r[n] for n in names) for r in packed) == want


def test_whole_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


CLASHES = [
    "_row", "_words", "_quality_score", "pass", "taken", "runs", "row", "id", "whole", "words",
    "fp", "score", "block", "place", "size", "n_words", "x.y", "grams", "kept", "value",
]


def odd_documents(spark):
    """Nulls in any column, empty, blank and repeated texts, equal rows, any other columns."""
    good = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [(None, None, None, None, None), (7_001, None, "en", "web", 0), (7_002, "", "en", None, 0)]
    rows += [(7_003, " \t\n ", None, "web", 4), *rows[:5], (None, *rows[0][1:]), (rows[1][0], *rows[2][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        df = df.withColumn(name, F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")))
    return df


def test_stages_keep_rows_and_columns_whole(spark):
    docs = odd_documents(spark)
    given = collections.Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns and got.schema == docs.schema, name
        kept = got.collect()
        assert kept, name
        if name == "source_mix":
            own = {(r.doc_id, r["_row"], r["x.y"], r["pass"]) for r in docs.collect()}
            assert {(r.doc_id, r["_row"], r["x.y"], r["pass"]) for r in kept} <= own
        else:
            assert not collections.Counter(map(tuple, kept)) - given, name
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.count() == 0 and empty.columns == docs.columns, name
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, docs, FOLDER)
    assert sum(given.values()) == pieces.where("piece = 0").count()
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
