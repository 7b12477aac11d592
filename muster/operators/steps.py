"""Ordered steps of expectations that must hold together.

A test has steps, a step expects a status of each of several objects.  A step is met at the
first instant at which all its objects have the status expected of them at once; the next
step starts there.  A step that is not met within its timeout ends the test.

An object has a status from one change to the next.  Within the time of a step, from its
start to its timeout, a sweep over the changes counts how many expectations hold: each
change adds one where an expectation begins to hold and takes one away where it ceases to.
Only changes within that time, and the last one before it, take part, so what is ordered
together is bounded by the timeout and not by how long an object has lived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.state import union_kinds
from muster.schema import EXPECTATION_TIMEOUT_SECONDS
from muster.session import work_dir

_MICROS = 1_000_000


def met_at(
    open_steps: DataFrame, expectations: DataFrame, changes: DataFrame, timeout_seconds: int
) -> DataFrame:
    """(test, met_us): the first instant in [start_us, start_us + timeout] at which all
    expectations of a test hold; tests for which there is none are left out.

    ``open_steps`` (test, start_us), ``expectations`` (test, object, expected), ``changes``
    (object, us, version, status); of changes at one instant the greatest version counts.
    """
    wanted = expectations.join(open_steps, "test")
    end = F.col("start_us") + timeout_seconds * _MICROS
    seen = wanted.join(changes, "object").filter(F.col("us") <= end)
    last = F.max_by("status", F.struct("us", "version"))
    before = seen.filter("us <= start_us").groupBy("test", "object").agg(last.alias("status"))
    first = wanted.join(before, ["test", "object"], "left").select(
        "test", "object", "expected", F.col("start_us").alias("us"), "status"
    )
    during = (
        seen.filter("us > start_us")
        .groupBy("test", "object", "expected", "us")
        .agg(F.max_by("status", "version").alias("status"))
    )
    holds = F.coalesce(F.col("status") == F.col("expected"), F.lit(False)).cast("int")
    of_object = Window.partitionBy("test", "object", "expected").orderBy("us")
    turns = (
        union_kinds(first, during)
        .withColumn("holds", holds)
        .withColumn("turn", F.col("holds") - F.lag("holds", 1, 0).over(of_object))
    )
    # What turns at one instant turns together.
    instants = turns.groupBy("test", "us").agg(F.sum("turn").alias("turn"))
    of_test = Window.partitionBy("test").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    count = expectations.groupBy("test").agg(F.count("*").alias("n"))
    return (
        instants.withColumn("together", F.sum("turn").over(of_test))
        .join(count, "test")
        .filter("together = n")
        .groupBy("test")
        .agg(F.min("us").alias("met_us"))
    )


def run_steps(
    tests: DataFrame,
    expectations: DataFrame,
    changes: DataFrame,
    timeout_seconds: int = EXPECTATION_TIMEOUT_SECONDS,
) -> DataFrame:
    """(test, step, result, start_us, end_us) for every step of every test.

    ``tests`` (test, start_us), ``expectations`` (test, step, object, expected) with steps
    from 1 on without gaps.  ``pass`` at the instant a step is met; ``timeout`` at the end
    of its time; ``not_run`` (without times) after a timeout.  Steps are folded one after
    the other for all tests at once; what a step leaves is written to the shared folder.
    """
    spark = tests.sparkSession
    expectations = expectations.distinct()
    steps = expectations.select("test", "step").distinct()
    number = steps.agg(F.max("step")).first()[0] or 0
    started, results = tests.select("test", "start_us"), []
    for step in range(1, number + 1):
        here = expectations.filter(F.col("step") == step).select("test", "object", "expected")
        open_steps = started.join(here.select("test").distinct(), "test", "left_semi")
        met = met_at(open_steps, here, changes, timeout_seconds)
        end = F.col("start_us") + timeout_seconds * _MICROS
        path = work_dir(spark, "step")
        open_steps.join(met, "test", "left").select(
            "test",
            F.lit(step).alias("step"),
            F.when(F.col("met_us").isNull(), "timeout").otherwise("pass").alias("result"),
            "start_us",
            F.coalesce("met_us", end).alias("end_us"),
        ).write.parquet(path)
        results.append(spark.read.parquet(path))
        started = results[-1].filter("result = 'pass'").select("test", F.col("end_us").alias("start_us"))
    columns = ["test", "step", "result", "start_us", "end_us"]
    of_tests = steps.join(tests.select("test"), "test", "left_semi")
    if not results:
        return of_tests.select(
            "test", F.col("step").cast("int").alias("step"), F.lit("").alias("result"),
            F.lit(0).cast("bigint").alias("start_us"), F.lit(0).cast("bigint").alias("end_us"),
        )
    found = of_tests.join(union_kinds(*results), ["test", "step"], "left")
    return found.withColumn("result", F.coalesce("result", F.lit("not_run"))).select(columns)
