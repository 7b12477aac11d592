"""Multi-party perspective rotation.

Every participant of a conversation gets the whole dialogue rendered with that speaker as
the assistant: the speaker's turns are assistant turns to learn from, everybody else's are
turns of a named user, system turns stay system turns.  A rendering is the concatenation
of its segments in order, so segments carry their place and the characters before them,
and a conversation of any length is spread over partitions (see ``running_totals``).

Defined results: NULL text is empty; a NULL or empty role is a speaker named ``unknown``;
white space in a name becomes ``_``; where names of one conversation become alike so, all but
the first of them (NULL first) have their number after a space; turns of equal number are ordered by role and text, NULL
turns come first, repeated rows are repeated segments; a NULL conversation id is a
conversation of its own; a conversation of system turns alone has no participants and no
rendering; texts are never cut or changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import BLANKS, named, running_totals

# The marks of a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM_ROLES = ("system",)
UNKNOWN = "unknown"


def _head(kind: Column) -> Column:
    return F.concat(F.lit(BEGIN), kind, F.lit("\n"))


def _told_apart(said: DataFrame) -> DataFrame:
    """Speakers of one conversation whose names have become alike, with a number; few do, so
    it is a small table that the turns are joined with."""
    alike = Window.partitionBy("conv_id", "speaker").orderBy(F.col("role").asc_nulls_first())
    number = F.row_number().over(alike)
    names = said.where("NOT system").select("conv_id", "speaker", "role").distinct()
    others = names.withColumn("number", number).where("number > 1").select(
        F.col("conv_id").alias("conv"),
        F.col("role").alias("raw"),
        F.concat_ws(" ", "speaker", "number").alias("other"),
    )
    same = said["conv_id"].eqNullSafe(others["conv"]) & said["role"].eqNullSafe(others["raw"])
    return said.join(others, same & ~said["system"], "left").select(
        "conv_id", "turn", "system", F.coalesce("other", "speaker").alias("speaker"), "text"
    )


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_roles: tuple[str, ...] = SYSTEM_ROLES,
) -> DataFrame:
    """Segments of every perspective.

    conv_id, perspective, position (from 0), speaker, turn, segment, segment_start and
    segment_end (characters of the rendering), learn (true where the mask is 1), and
    learn_start, learn_end: the characters the loss is taken on, the speaker's own text
    and the mark that ends it; NULL in other segments.
    """
    role = F.coalesce(named(role_col), F.lit(UNKNOWN))
    said = turns.select(
        named(conv_col).alias("conv_id"),
        named(turn_col).alias("turn"),
        role.isin(*system_roles).alias("system"),
        F.when(role.isin(*system_roles), role)
        .otherwise(F.regexp_replace(F.when(role == "", UNKNOWN).otherwise(role), BLANKS, "_"))
        .alias("speaker"),
        F.coalesce(named(text_col), F.lit("")).alias("text"),
        named(role_col).alias("role"),
    )
    said = _told_apart(said)
    who = (
        said.where("NOT system")
        .select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    seen = said.join(who, said["conv_id"].eqNullSafe(who["conv"]))
    own = ~F.col("system") & (F.col("speaker") == F.col("perspective"))
    head = (
        F.when(F.col("system"), _head(F.lit("system")))
        .when(own, _head(F.lit("assistant")))
        .otherwise(_head(F.concat(F.lit("user name="), F.col("speaker"))))
    )
    segments = seen.select(
        "conv_id", "perspective", "turn", "speaker", own.alias("learn"),
        F.char_length(head).alias("head_chars"),
        F.concat(head, "text", F.lit(END)).alias("segment"),
    ).select(
        "*",
        F.char_length("segment").cast("long").alias("chars"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = running_totals(
        segments, ["conv_id", "perspective"], ["turn", "speaker", "segment"], ["chars", "one"], "chat"
    )
    start, end = F.col("chars_before"), F.col("chars_before") + F.col("chars")
    return placed.select(
        "conv_id",
        "perspective",
        F.col("one_before").alias("position"),
        "speaker",
        "turn",
        "segment",
        start.alias("segment_start"),
        end.alias("segment_end"),
        "learn",
        F.when(F.col("learn"), start + F.col("head_chars")).alias("learn_start"),
        F.when(F.col("learn"), end - 1).alias("learn_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole renderings, for conversations that fit a row: text and the spans to learn."""
    in_order = F.array_sort(
        F.collect_list(F.struct("position", "segment", "learn_start", "learn_end"))
    )
    return (
        segments.groupBy("conv_id", "perspective")
        .agg(in_order.alias("parts"))
        .select(
            "conv_id",
            "perspective",
            F.array_join("parts.segment", "").alias("text"),
            F.transform(
                F.filter("parts", lambda p: p["learn_start"].isNotNull()),
                lambda p: F.struct(p["learn_start"].alias("start"), p["learn_end"].alias("end")),
            ).alias("mask"),
        )
    )
