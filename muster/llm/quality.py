"""Quality rules: fixed base counts, and a hashed n-gram likelihood ratio.

Runs of letters and digits and runs of marks are tokens, case kept.  Tokens and pairs of
neighbours are hashed into ``buckets``.  The raw corpus, every document, gives one
multinomial over the buckets, the trusted documents another, drawn towards the first by
``prior`` imagined tokens, so that no evidence means a ratio of 0.  A document's verdict
is the sum over its n-grams of log(trusted / raw), by the number of n-grams, against a
fixed threshold.  Logs are rounded to millionths and summed as integers, so the verdict
does not depend on the order of additions.

Both multinomials are of whole tables: every trusted document counts.  Trusted ids, however
many, meet the documents in a shuffle.

Defined results: NULL and empty texts have no words and fail the base rules; a document
without n-grams has ratio 0; no trusted documents, or none that matches, means ratio 0
everywhere; each of several equal rows is judged by itself; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import BLANKS, let, named, words_of

BUCKETS = 1 << 14
PRIOR = 20_000
THRESHOLD = -0.3
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
MILLION = 1_000_000
SYMBOLS = r"[#*$%&|<>]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x20\x09-\x0D]+"


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of 8 words that the text has twice or more."""

    def doubled(hashes: Column, apart: int) -> Column:
        """From hashes of ``apart`` words each to hashes of twice as many."""

        def pairs(h: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(h) - apart - 1)
            return F.transform(at, lambda i: F.xxhash64(h[i], h[i + apart]))

        return let(hashes, pairs)

    def hashes(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        for apart in (1, 2, 4):
            h = doubled(h, apart)
        return h

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(p: Column) -> Column:
            again = F.filter(
                p,
                lambda e, k: ((k > 0) & (p[F.greatest(k - 1, F.lit(0))]["x"] == e["x"]))
                | (
                    (k < F.size(p) - 1)
                    & (p[F.least(k + 1, F.size(p) - 1)]["x"] == e["x"])
                ),
            )
            return F.array_sort(F.transform(again, lambda e: e["i"]))

        def length(s: Column) -> Column:
            gaps = F.transform(
                s, lambda at, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), at - s[F.greatest(k - 1, F.lit(0))]))
            )
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return let(let(pairs, starts), length)

    def count(w: Column) -> Column:
        some = let(
            hashes(w),
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0),
        )
        return F.when(F.size(w) > WINDOW, some).otherwise(0)

    return let(words, count)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, text."""
    text = F.coalesce(named(text_col), F.lit(""))
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.size(x) - F.size(F.array_distinct(x)),
    )
    words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeats")),
    )
    counted = docs.select(
        named(id_col).alias("doc_id"),
        F.char_length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, "")))
        .cast("long")
        .alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        words.alias("words"),
        text.alias("text"),
    )
    n, repeats = F.col("words.n").cast("long"), F.col("words.repeats").cast("long")
    return counted.select(
        "doc_id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeats.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n)).alias("base_failed"),
        "text",
    )


def _grams(text: Column, buckets: int) -> Column:
    """The buckets of a text's tokens and of its pairs of neighbours."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def both(h: Column) -> Column:
        pairs = F.transform(
            h,
            lambda x, i: F.when(
                i > 0, F.pmod(F.xxhash64(h[F.greatest(i - 1, F.lit(0))], x), F.lit(buckets))
            ),
        )
        single = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)))
        return F.concat(single, F.filter(pairs, lambda x: x.isNotNull()))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), both)


def trusted_ids(trusted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of the trusted rows, each once."""
    return trusted.select(named(id_col).alias("doc_id")).where("doc_id IS NOT NULL").distinct()


def bucket_weights(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    prior: float = PRIOR,
) -> list[int]:
    """For each bucket log(trusted / raw) in millionths; one number per bucket, no more.

    Each task hashes its share of the ids, so texts are shuffled once and not sorted.
    """
    ids = trusted_ids(trusted, id_col).select(
        F.col("doc_id").alias("_id"), F.lit(1).cast("long").alias("_trusted")
    )
    flagged = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text")).join(
        ids.hint("shuffle_hash"), "_id", "left"
    )
    counts = (
        flagged.select(
            F.coalesce("_trusted", F.lit(0)).alias("trusted"),
            F.explode(_grams(F.col("_text"), buckets)).alias("bucket"),
        )
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted"))
        .collect()
    )
    raw = sum(r.raw for r in counts)
    good = sum(r.trusted for r in counts)
    weights = [0] * buckets
    for r in counts if good else []:
        share = r.raw / raw
        weights[r.bucket] = round(
            math.log((r.trusted + prior * share) / (good + prior) / share) * MILLION
        )
    return weights


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    prior: float = PRIOR,
) -> DataFrame:
    """Base counts, ratio (mean log-likelihood ratio of an n-gram), kept.

    ``trusted`` names the trusted documents by ``id_col``.
    """
    weights = bucket_weights(docs, trusted, id_col, text_col, buckets, prior)
    return _judged(docs, weights, id_col, text_col, threshold)


def _judged(
    docs: DataFrame, weights: list[int], id_col: str, text_col: str, threshold: float
) -> DataFrame:
    # One constant of a fixed length; a literal in the plan, folded once.
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    counted = base_counts(docs, id_col, text_col)
    scored = counted.withColumn(
        "grams",
        let(
            _grams(F.col("text"), len(weights)),
            lambda g: F.struct(
                F.size(g).cast("long").alias("n"),
                F.aggregate(
                    g, F.lit(0).cast("long"), lambda a, b: a + table[b.cast("int")]
                ).alias("sum"),
            ),
        ),
    )
    return scored.select(
        *[c for c in counted.columns if c != "text"],
        F.when(F.col("grams.n") > 0, F.col("grams.sum") / F.col("grams.n") / MILLION)
        .otherwise(0.0)
        .alias("ratio"),
        (
            ~F.col("base_failed")
            & (F.col("grams.sum") >= F.lit(round(threshold * MILLION)) * F.col("grams.n"))
        ).alias("kept"),
    )


def keep_good(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    **options,
) -> DataFrame:
    """The documents the rules keep, with all their columns; no join, no shuffle of texts."""
    weights = bucket_weights(docs, trusted, id_col, text_col, **options)
    whole = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("whole"), named(text_col).alias("text")
    )
    judged = _judged(whole, weights, "whole", "text", threshold)
    return judged.where("kept").select("doc_id.*")
