"""Rules about time: retries, expected ticks, expectations with a timeout.

Times are compared as microseconds.  An owner may have very many events, so no step
here orders all events of one owner in one place: what looks for the next event does
so within time buckets, what counts ticks counts them before it compares.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from muster.schema import (
    EXPECTATION_TIMEOUT_SECONDS,
    PROBE_INITIAL_DELAY_SECONDS,
    PROBE_PERIOD_SECONDS,
    RETRY_DELAY_SECONDS,
)

from muster.streaming.latest import ONCE

_MICROS = 1_000_000
# Periods of one stretch, and ticks of one piece of a silence.
_CHUNK = 4096


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def first_following(
    left: DataFrame, right: DataFrame, key: str, within_seconds: int, strictly: bool
) -> DataFrame:
    """``left`` with ``next_us``: the time of the first ``right`` row of the same key
    that follows within so many seconds; NULL if none does.  Both have ``us``.

    Time is cut into buckets as long as the interval.  What follows a left row lies in
    its bucket or the next, so right rows are put into their own bucket and the one
    before.  One running minimum per (key, bucket), from late to early, then finds the
    first that follows, and a key with very many rows is spread over its buckets.
    """
    span = within_seconds * _MICROS
    bucket = F.floor(F.col("us") / span).cast("bigint")
    probes = left.withColumns(
        {"bucket": bucket, "candidate": F.lit(None).cast("bigint"), "is_left": F.lit(True)}
    )
    targets = (
        right.select(key, "us", F.col("us").alias("candidate"))
        .withColumns({"home": bucket, "is_left": F.lit(False)})
        .withColumn("bucket", F.explode(F.array(F.col("home") - 1, F.col("home"))))
        .drop("home")
    )
    # From late to early: everything before this row in the order follows it in time.
    backwards = Window.partitionBy(key, "bucket").orderBy(F.col("us").desc())
    frame = backwards.rangeBetween(Window.unboundedPreceding, -1 if strictly else 0)
    found = F.min("candidate").over(frame)
    return (
        probes.unionByName(targets, allowMissingColumns=True)
        .withColumn("found", found)
        .filter("is_left")
        .withColumn("next_us", F.when(F.col("found") - F.col("us") <= span, F.col("found")))
        .drop("bucket", "candidate", "is_left", "found")
    )


def retry_due(
    watch: DataFrame, delay_seconds: int = RETRY_DELAY_SECONDS
) -> DataFrame:
    """Failures that are due again ``delay_seconds`` later: no success of the same
    object came first."""
    rows = watch.withColumn("us", micros(F.col("ts")))
    failed = rows.filter("change = 'ERROR'")
    succeeded = rows.filter("change <> 'ERROR'")
    return _due(
        first_following(failed, succeeded, "owner", delay_seconds, strictly=True), delay_seconds
    )


def _due(followed: DataFrame, delay_seconds: int) -> DataFrame:
    return followed.filter("next_us IS NULL").select(
        "resource_version",
        "owner",
        F.col("us").alias("failed_us"),
        (F.col("us") + delay_seconds * _MICROS).alias("due_us"),
    )


def eventually(
    steps: DataFrame, met: DataFrame, timeout_seconds: int = EXPECTATION_TIMEOUT_SECONDS
) -> DataFrame:
    """``pass`` with the time waited, or ``timeout``, for each step.

    ``met`` are the observations that fulfil the expectation of their owner.
    """
    left = steps.withColumn("us", micros(F.col("ts")))
    right = met.withColumn("us", micros(F.col("ts")))
    return _waited(first_following(left, right, "owner", timeout_seconds, strictly=False))


def _waited(followed: DataFrame) -> DataFrame:
    return followed.select(
        "resource_version",
        "owner",
        F.when(F.col("next_us").isNull(), "timeout").otherwise("pass").alias("result"),
        (F.col("next_us") - F.col("us")).alias("waited_us"),
    )


def heartbeat_slots(
    heartbeats: DataFrame, period_seconds: int = PROBE_PERIOD_SECONDS
) -> DataFrame:
    """(owner, slot, first_us, last_us): the numbered periods in which an owner was heard
    of, one row per owner and period, however many heartbeats there were."""
    us = micros(F.col("ts"))
    slot = F.floor(us / (period_seconds * _MICROS)).cast("bigint")
    return heartbeats.groupBy("owner", slot.alias("slot")).agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )


def _first_tick(first_us: Column, delay_seconds: int, period: int) -> Column:
    """The first period that begins after the first heartbeat and the initial delay."""
    return F.ceil((first_us + delay_seconds * _MICROS) / period).cast("bigint")


def _ticks(gaps: DataFrame) -> DataFrame:
    """(owner, tick) for every tick from ``start`` to ``end``; a long silence is cut
    into chunks first, so no row holds all of it."""
    chunks = gaps.filter("start <= end").select(
        "owner",
        "start",
        "end",
        F.explode(F.expr(f"sequence(start div {_CHUNK}, end div {_CHUNK})")).alias("chunk"),
    )
    first = F.greatest("start", F.col("chunk") * _CHUNK)
    last = F.least("end", F.col("chunk") * _CHUNK + (_CHUNK - 1))
    return chunks.select("owner", F.explode(F.sequence(first, last)).alias("tick"))


def missed_ticks(
    slots: DataFrame,
    delay_seconds: int = PROBE_INITIAL_DELAY_SECONDS,
    period_seconds: int = PROBE_PERIOD_SECONDS,
    horizon_us: int | None = None,
) -> DataFrame:
    """(owner, tick_s): expected ticks without a heartbeat, up to the last period that
    ended at ``horizon_us``, by default the newest heartbeat of all owners.

    So an owner that falls silent is missed until then.  Silences within a stretch of
    periods are found there; the stretches of an owner, far fewer than its periods, are
    then compared with each other, and no window spans all periods of an owner.
    """
    period = period_seconds * _MICROS
    stretch = F.floor(F.col("slot") / _CHUNK).cast("bigint")
    numbered = slots.withColumn("stretch", stretch)
    bounds = numbered.groupBy("owner", "stretch").agg(
        F.min("slot").alias("low"), F.max("slot").alias("high"), F.min("first_us").alias("first_us")
    )
    newest = (
        slots.agg(F.max("last_us").alias("us")).scalar()
        if horizon_us is None
        else F.lit(horizon_us)
    )
    horizon = F.floor(newest / period).cast("bigint")
    by_owner, in_order = Window.partitionBy("owner"), Window.partitionBy("owner").orderBy("stretch")
    known = bounds.select(
        "owner",
        "stretch",
        "low",
        "high",
        _first_tick(F.min("first_us").over(by_owner), delay_seconds, period).alias("begin"),
        F.lag("high").over(in_order).alias("before"),
        F.lead("low").over(in_order).isNull().alias("last"),
    )
    between = known.filter("before IS NOT NULL").select(
        "owner",
        F.greatest("begin", F.col("before") + 1).alias("start"),
        (F.col("low") - 1).alias("end"),
    )
    silent = known.filter("last").select(
        "owner",
        F.greatest("begin", F.col("high") + 1).alias("start"),
        (horizon - 1).alias("end"),
    )
    within = (
        numbered.select(
            "owner",
            "stretch",
            "slot",
            F.lag("slot")
            .over(Window.partitionBy("owner", "stretch").orderBy("slot"))
            .alias("previous"),
        )
        .filter("previous < slot - 1")
        .join(known.select("owner", "stretch", "begin"), ["owner", "stretch"])
        .select(
            "owner",
            F.greatest("begin", F.col("previous") + 1).alias("start"),
            (F.col("slot") - 1).alias("end"),
        )
    )
    gaps = between.unionByName(silent).unionByName(within)
    ticks = _ticks(gaps.withColumn("end", F.least("end", horizon - 1)))
    return ticks.select("owner", (F.col("tick") * period_seconds).alias("tick_s"))


def liveness(
    heartbeats: DataFrame,
    delay_seconds: int = PROBE_INITIAL_DELAY_SECONDS,
    period_seconds: int = PROBE_PERIOD_SECONDS,
) -> DataFrame:
    return missed_ticks(heartbeat_slots(heartbeats, period_seconds), delay_seconds, period_seconds)


# ------------------------------------------------------------------ streams
#
# What a stream waits for is Spark's own state, kept with its checkpoint: a batch changes
# what it touches, and a stream that is started again goes on where it was.


def append_stream(
    df: DataFrame, target: str, checkpoint: str, trigger: Mapping[str, object] = ONCE
) -> StreamingQuery:
    """Writes what a stream emits below ``target``, each row once."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _marked(df: DataFrame, lateness_seconds: int | None) -> DataFrame:
    """``df`` with a watermark; one that has one already is given none (None)."""
    return df if lateness_seconds is None else df.withWatermark("ts", f"{lateness_seconds} seconds")


def following_frame(
    watch: DataFrame,
    left: Column,
    right: Column,
    within_seconds: int,
    strictly: bool,
    lateness_seconds: int | None = 3600,
) -> DataFrame:
    """Of a stream in which ``left`` and ``right`` mark the rows: every left row with the
    time ``right_ts`` of each right row of the same owner that follows within so many
    seconds, or NULL once the watermark says that none does.

    An outer join of the stream with itself on the owner and an interval of time, with a
    watermark on both sides.  As in ``first_following``, time is cut into buckets as long as
    the interval and right rows are put into two of them, so that an owner with very many
    rows is spread over its buckets and a pair still meets once.  A left row that is
    delivered again counts once.
    """
    marked = _marked(watch, lateness_seconds)
    bucket = F.floor(F.unix_micros("ts") / (within_seconds * _MICROS)).cast("bigint")
    lefts = (
        marked.filter(left)
        .select("resource_version", "owner", "ts")
        .dropDuplicatesWithinWatermark(["resource_version"])
        .withColumn("bucket", bucket)
    )
    rights = (
        marked.filter(right)
        .select(F.col("owner").alias("right_owner"), "ts")
        .withColumn("home", bucket)
        .select(
            "right_owner",
            F.col("ts").alias("right_ts"),
            F.explode(F.array(F.col("home") - 1, F.col("home"))).alias("right_bucket"),
        )
    )
    after = F.col("right_ts") > F.col("ts") if strictly else F.col("right_ts") >= F.col("ts")
    soon = F.col("right_ts") <= F.col("ts") + F.expr(f"INTERVAL {within_seconds} SECONDS")
    same = (F.col("owner") == F.col("right_owner")) & (F.col("bucket") == F.col("right_bucket"))
    joined = lefts.join(rights, same & after & soon, "left_outer")
    return joined.select("resource_version", "owner", "ts", "right_ts")


DUE = "resource_version bigint, owner string, failed_us bigint, due_us bigint"


def retry_due_frame(
    watch: DataFrame, delay_seconds: int = RETRY_DELAY_SECONDS, lateness_seconds: int = 3600
) -> DataFrame:
    """``retry_due`` for a stream: a failure is emitted once the watermark says that no
    success can come first any more."""
    failed, succeeded = F.col("change") == "ERROR", F.col("change") != "ERROR"
    followed = following_frame(watch, failed, succeeded, delay_seconds, True, lateness_seconds)
    return _due(
        followed.withColumns({"us": micros(F.col("ts")), "next_us": micros(F.col("right_ts"))}),
        delay_seconds,
    )


def retry_due_stream(
    watch: DataFrame,
    target: str,
    checkpoint: str,
    delay_seconds: int = RETRY_DELAY_SECONDS,
    lateness_seconds: int = 3600,
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    due = retry_due_frame(watch, delay_seconds, lateness_seconds)
    return append_stream(due, target, checkpoint, trigger)


WAITED = "resource_version bigint, owner string, result string, waited_us bigint"


def eventually_frame(
    watch: DataFrame,
    step: Column,
    met: Column,
    timeout_seconds: int = EXPECTATION_TIMEOUT_SECONDS,
    lateness_seconds: int = 3600,
) -> DataFrame:
    """``eventually`` for a stream in which ``step`` and ``met`` mark the rows: the first of
    the rows that follow counts, and is known once the watermark is a second later than the timeout."""
    followed = following_frame(watch, step, met, timeout_seconds, False, lateness_seconds)
    first = followed.groupBy("resource_version", "owner", "ts").agg(
        F.min(micros(F.col("right_ts"))).alias("next_us")
    )
    return _waited(first.withColumn("us", micros(F.col("ts"))))


def eventually_stream(
    watch: DataFrame,
    step: Column,
    met: Column,
    target: str,
    checkpoint: str,
    timeout_seconds: int = EXPECTATION_TIMEOUT_SECONDS,
    lateness_seconds: int = 3600,
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    waited = eventually_frame(watch, step, met, timeout_seconds, lateness_seconds)
    return append_stream(waited, target, checkpoint, trigger)


TICKS = "owner string, tick_s bigint"


def _heard(heartbeats: DataFrame, period: int) -> DataFrame:
    """(owner, slot, us, ts): of each period of an owner the first and the last heartbeat,
    found within each Arrow batch before anything is shuffled, so that an owner heard of
    very often is a few rows of each task."""
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = pa.table(batch).group_by(["owner", "slot"])
            found = by.aggregate([("us", "min"), ("us", "max")]).select(
                ["owner", "slot", "us_min", "us_max"]
            )
            yield from found.rename_columns(["owner", "slot", "us", "last_us"]).to_batches()

    rows = heartbeats.select("owner", micros(F.col("ts")).alias("us")).withColumn(
        "slot", F.floor(F.col("us") / period).cast("bigint")
    )
    found = rows.mapInArrow(least, "owner string, slot bigint, us bigint, last_us bigint")
    return found.select("owner", "slot", "us", F.timestamp_micros("last_us").alias("ts"))


def liveness_frame(
    heartbeats: DataFrame,
    delay_seconds: int = PROBE_INITIAL_DELAY_SECONDS,
    period_seconds: int = PROBE_PERIOD_SECONDS,
    lateness_seconds: int = 3600,
    forget_periods: int | None = None,
) -> DataFrame:
    """``liveness`` for a stream: (owner, tick_s) for each period the watermark passes in
    which nothing was heard of an owner, also when nothing ever is again.

    The state of an owner is one entry: the next period to be judged, and those after it
    in which it was heard of already.  A timer stands at the end of that period; when the
    watermark reaches it, the periods passed are judged and the timer is set anew.  With
    ``forget_periods`` an owner silent for so many periods in a row is reported that often,
    and dropped until it is heard of again.
    """
    period = period_seconds * _MICROS
    delay = delay_seconds * _MICROS

    def judge(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        # The next period to be judged, the silent ones before it, those heard of.
        upcoming, silent, heard = state.get if state.exists else (None, 0, [])
        known, first = set(heard), None
        for frame in frames if not state.hasTimedOut else ():
            known.update(frame["slot"].tolist())
            here = int(frame["us"].min())
            first = here if first is None else min(first, here)
        if upcoming is None:
            upcoming = -(-(first + delay) // period)
        passed = state.getCurrentWatermarkMs() * 1_000 // period
        missed, gone = [], False
        while upcoming < passed and not gone:
            # To the next period that was heard of, or to the last one passed.
            until = min((s for s in known if s >= upcoming), default=passed)
            until = min(until, passed)
            if forget_periods is not None and silent + until - upcoming >= forget_periods:
                until, gone = upcoming + forget_periods - silent, True
            missed.append((upcoming, until))
            silent += until - upcoming
            if until < passed and not gone:
                silent = 0
                until += 1
            upcoming = until
            if gone and (again := [s for s in known if s >= upcoming]):
                upcoming, silent, gone = min(again), 0, False
        if gone:
            state.remove()
        else:
            state.update((upcoming, silent, sorted(s for s in known if s >= upcoming)))
            # Fires when the watermark has reached the end of the period.
            end = (upcoming + 1) * period // 1_000 - 1
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs()))
        for begin, end in missed:
            for low in range(begin, end, _CHUNK):
                ticks = range(low, min(low + _CHUNK, end))
                yield pd.DataFrame({"owner": key[0], "tick_s": [t * period_seconds for t in ticks]})

    heard = _marked(_heard(heartbeats, period), lateness_seconds)
    return heard.groupBy("owner").applyInPandasWithState(
        judge,
        TICKS,
        "upcoming bigint, silent bigint, heard array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def liveness_stream(
    heartbeats: DataFrame,
    target: str,
    checkpoint: str,
    delay_seconds: int = PROBE_INITIAL_DELAY_SECONDS,
    period_seconds: int = PROBE_PERIOD_SECONDS,
    lateness_seconds: int = 3600,
    trigger: Mapping[str, object] = ONCE,
    forget_periods: int | None = None,
) -> StreamingQuery:
    missed = liveness_frame(heartbeats, delay_seconds, period_seconds, lateness_seconds, forget_periods)
    return append_stream(missed, target, checkpoint, trigger)
