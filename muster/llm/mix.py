"""Mixing sources to target weights in fixed-length blocks.

The words of each source, documents in order of their id, are one long line cut into
blocks of ``block_words`` words (the last may be shorter).  Slots of the mix are dealt to
output shards: every source has as many slots as its target asks for, and one
pseudorandom permutation of all slots deals them out, so the source counts of a shard are
a multinomial draw given the totals (the draw keeps every total instead of meeting it on
average).  The j-th slot of a source takes block ``permute(j mod blocks)`` of that source,
by a permutation of its own, and slots meet blocks in a join on the block's index.

Both permutations are the swap-or-not shuffle, which needs nothing but hashes and works
on any number of items.  Everything is DataFrame functions, and reruns agree.

Defined results: NULL text has no words and size 0; documents without words are taken 0
times; a NULL source is a source, the last; a source without words has no slots; equal rows
each count; empty tables give no rows; a source whose target rounds to no slot is left out, which only sources shorter
than a block can be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import BLANKS, WORD, named, running_totals, settle, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
ROUNDS = 24
CHUNK = 4096


def permute(x: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1, another for each ``seed`` (n at least 1)."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - at, n)
        heads = F.pmod(F.xxhash64(seed, r, F.greatest(at, other)), F.lit(2)) == 1
        return F.when(heads, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
) -> DataFrame:
    """Target words of each source, from rows (source, source_size): adds place, target.

    Weights repeat over the sources in code point order, NULL last.  Sources share
    ``share`` of all words by weight; none gets more than ``limit`` times its own size,
    and what is cut off is shared by weight among the rest.  With sources in order of
    limit per weight, those that are cut are the first ones, so running sums find the
    level at which it stops.  One row per source meets in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])
    placed = (
        sizes.withColumn("place", F.row_number().over(order).cast("long") - 1)
        .withColumn("weight", weight[F.pmod(F.col("place"), F.lit(len(weights))).cast("int")])
        .withColumn("most", F.lit(float(limit)) * F.col("source_size"))
    )
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "place")
    sofar = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("most").over(sofar), F.lit(0.0)
    )
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(sofar), F.lit(0.0)
    )
    leveled = placed.withColumn("level", left / weight_left).withColumn(
        "open", F.col("most") >= F.col("level") * F.col("weight")
    )
    level = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(
        everything
    )["level"]
    return leveled.select(
        "source",
        "source_size",
        "place",
        F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents on their source's line, pieces of documents in blocks, and the slots.

    documents: row, doc_id, source, size, source_size, target, start (words before it)
    pieces:    row, place, block, from_word, words - the part of a document in a block
    slots:     shard, slot, place, pass, block - what each slot of the mix takes
    """
    row = named(row_col) if row_col else F.monotonically_increasing_id()
    lines = running_totals(
        docs.select(
            row.alias("row"),
            named(id_col).alias("doc_id"),
            named(source_col).cast("string").alias("source"),
            F.size(words_of(named(text_col))).cast("long").alias("size"),
        ),
        ["source"],
        ["doc_id", "size"],
        ["size"],
        "mix",
    )
    lines = settle(lines, "mix")
    sizes = lines.groupBy("source").agg(F.max("size_total").alias("source_size"))
    sources = settle(source_targets(sizes, weights, share, limit), "mix")
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    counts = sources.withColumn("blocks", blocks).withColumn(
        "slots",
        F.coalesce(
            F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("long"),
            F.lit(0),
        ),
    )
    documents = lines.join(
        sources, lines["source"].eqNullSafe(sources["source"])
    ).select(
        "row", "doc_id", lines["source"], "size", "source_size", "place", "target",
        F.col("size_before").alias("start"),
    )

    first = F.expr(f"start div {block_words}")
    last = F.expr(f"(start + size - 1) div {block_words}")
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = (
        documents.where("size > 0")
        .select("row", "doc_id", "place", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        .select(
            "row", "place", "block",
            (begin - F.col("start")).alias("from_word"),
            (end - begin).alias("words"),
        )
    )

    # One row per source, spread into chunks of slots before the slots themselves.  So few
    # rows would be put into one partition, had it no number of its own.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        counts.where("slots > 0")
        .select(
            "place", "blocks", "slots",
            F.coalesce(F.sum("slots").over(earlier), F.lit(0)).alias("before"),
            F.sum("slots").over(Window.partitionBy()).alias("all_slots"),
        )
        .withColumn("chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")))
        .repartition(partitions, "place", "chunk")
    )
    nth = F.explode(
        F.expr(f"sequence(chunk * {CHUNK}, least(slots, (chunk + 1) * {CHUNK}) - 1)")
    )
    slots = (
        chunks.withColumn("nth", nth)
        .withColumn(
            "dealt",
            permute(F.col("before") + F.col("nth"), F.col("all_slots"), F.lit(f"slots {seed}")),
        )
        .select(
            F.expr(f"dealt div {shard_slots}").alias("shard"),
            F.pmod(F.col("dealt"), F.lit(shard_slots)).alias("slot"),
            "place",
            F.expr("nth div blocks").alias("pass"),
            permute(
                F.expr("nth % blocks"), F.col("blocks"),
                F.concat(F.lit(f"blocks {seed} "), F.col("place").cast("string")),
            ).alias("block"),
        )
    )
    return documents, pieces, slots


def mix_taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes)."""
    documents, pieces, slots = mix_plan(docs, **options)
    documents = documents.select("row", "doc_id", "size", "source_size", "target", "place", "start")
    # Spark takes what a generator makes for small and would broadcast it: it grows with the mix.
    uses = slots.groupBy("place", "block").agg(F.count("*").alias("uses")).hint("merge")
    taken = (
        pieces.join(uses, ["place", "block"])
        .groupBy("row")
        .agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    )
    return documents.join(taken.hint("merge"), "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mix_documents(
    docs: DataFrame,
    text_col: str = "text",
    chars_col: str | None = "n_chars",
    id_col: str = "doc_id",
    source_col: str = "source",
    **options,
) -> DataFrame:
    """The mix as documents: one row for each pass over a document that takes some of it.

    The text is what the pass takes: the whole text as it stands, or the taken runs of
    words with the white space that follows each word, runs joined by a line feed.
    ``chars_col``, if the documents have it, is counted anew; all other columns are kept.
    The documents are written once to the shared folder, so that their rows can be told
    apart; they are one column of it, so their own columns may have any name.
    """
    whole = F.struct(*[named(c) for c in docs.columns])
    rows = settle(
        docs.select(whole.alias("whole"), F.monotonically_increasing_id().alias("row")), "mix-docs"
    )
    own = {"id": id_col, "text": text_col, "source": source_col}
    rows = rows.select("*", *[F.col("whole").getField(c).alias(n) for n, c in own.items()])
    documents, pieces, slots = mix_plan(rows, "id", "text", "source", row_col="row", **options)
    runs = (
        pieces.join(slots.select("place", "pass", "block").hint("merge"), ["place", "block"])
        .groupBy("row", "pass")
        .agg(
            F.sum("words").alias("taken"),
            F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("runs"),
        )
    )
    tail = F.regexp_extract_all("text", F.lit(f"{WORD}(?:{BLANKS})?"), F.lit(0))
    # A run that follows on the one before it is joined without a mark.
    taken_text = F.expr(
        "aggregate(runs, named_struct('text', '', 'upto', -1L), (a, r) -> named_struct("
        "'text', concat(a.text, if(a.upto = -1L or a.upto = r.from_word, '', '\n'),"
        " array_join(slice(words, cast(r.from_word + 1 as int), cast(r.words as int)), '')),"
        "'upto', r.from_word + r.words), a -> a.text)"
    )
    cut = rows.join(runs.hint("merge"), "row").withColumn("words", tail)
    cut = cut.withColumn(
        "text", F.when(F.size("words") == F.col("taken"), F.col("text")).otherwise(taken_text)
    )

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("text").alias(name)
        if name == chars_col:
            return F.char_length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col("whole").getField(name).alias(name)

    return cut.select(*[column(c) for c in docs.columns])
