"""Streams, snapshots and time rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from muster.session import work_dir
from muster.sources import sinks, snapshot
from muster.sources.watch import watch
from muster.streaming import latest, timing

WATCH = (
    "resource_version bigint, ts timestamp, owner string, kind string, change string, "
    "error_category string, value double"
)


def events(spark, n=600, seed=3):
    """Changes of a few owners; one of them has a third of all."""
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000
    for i in range(n):
        t += rng.choice([0, 0, 1, 2, 7])
        owner = "c-hot" if i % 3 == 0 else f"c-{rng.randint(1, 20)}"
        kind = rng.choice(["SparkCluster", "Service", "ConfigMap", "StatefulSet"])
        change = rng.choice(["ERROR", "ADDED", "MODIFIED"])
        rows.append((i, t, owner, kind, change, "X" if change == "ERROR" else None, 1.0))
    df = spark.createDataFrame(rows, WATCH.replace("ts timestamp", "ts bigint"))
    return rows, df.withColumn("ts", F.timestamp_seconds("ts"))


def test_retry_against_brute_force(spark):
    rows, df = events(spark)
    want = {
        r[0]
        for r in rows
        if r[4] == "ERROR"
        and not any(s[2] == r[2] and s[4] != "ERROR" and r[1] < s[1] <= r[1] + 5 for s in rows)
    }
    got = timing.retry_due(df).collect()
    assert {r.resource_version for r in got} == want and len(got) == len(want)
    assert all(r.due_us - r.failed_us == 5_000_000 for r in got)


def test_eventually_against_brute_force(spark):
    rows, df = events(spark, seed=4)
    want = {}
    for r in rows:
        if r[4] == "ADDED":
            later = [s[1] - r[1] for s in rows
                     if s[2] == r[2] and s[3] == "StatefulSet" and 0 <= s[1] - r[1] <= 30]
            want[r[0]] = min(later) * 1_000_000 if later else None
    got = timing.eventually(df.filter("change = 'ADDED'"), df.filter("kind = 'StatefulSet'"), 30)
    assert {r.resource_version: r.waited_us for r in got.collect()} == want


@pytest.mark.parametrize("chunk", [4096, 3])
def test_liveness_against_brute_force(spark, monkeypatch, chunk):
    rows, df = events(spark, seed=5)
    rows.append((601, rows[0][1], "c-silent", "Service", "ADDED", None, 1.0))  # once, then never
    df = df.unionByName(df.filter("resource_version = 0").withColumn("owner", F.lit("c-silent")))
    period, delay, want = 10, 10, set()
    newest = max(r[1] for r in rows)
    for owner in {r[2] for r in rows}:
        times = [r[1] for r in rows if r[2] == owner]
        slots = {t // period for t in times}
        first = -(-(min(times) + delay) // period)
        want |= {(owner, s * period) for s in range(first, newest // period) if s not in slots}
    monkeypatch.setattr(timing, "_CHUNK", chunk)
    got = timing.liveness(df, delay, period).collect()
    assert {(r.owner, r.tick_s) for r in got} == want and len(got) == len(want)


def test_time_rules_of_streams_in_many_batches(spark, tmp_path):
    """The rows in order of time, in files of one batch each, some delivered twice; half of
    them come after the stream has ended and is started again."""
    rows, df = events(spark, seed=6)
    ordered = df.orderBy("ts").collect()
    late, half = 20, len(ordered) // 2

    def arrive(begin, end):
        for i in range(begin, end, 150):
            part = ordered[i : i + 150] + ordered[max(0, i - 5) : i]
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(
                str(tmp_path / "in")
            )

    def stream():
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        return source.parquet(str(tmp_path / "in"))

    step, met = F.col("change") == "ADDED", F.col("kind") == "StatefulSet"
    rules = {
        "due": (lambda *a: timing.retry_due_stream(stream(), *a, 5, late), timing.DUE),
        "waited": (lambda *a: timing.eventually_stream(stream(), step, met, *a, 30, late), timing.WAITED),
        "ticks": (lambda *a: timing.liveness_stream(stream(), *a, 10, 10, late), timing.TICKS),
    }

    def ran(name):
        start, schema = rules[name]
        target = str(tmp_path / name)
        start(target, f"{target}-cp").awaitTermination()
        return sorted(map(tuple, spark.read.schema(schema).parquet(target).collect()))

    def want(part):
        here = spark.createDataFrame(part, df.schema)
        passed = (max(int(r.ts.timestamp()) for r in part) - late) * 1_000_000
        at = {r[0]: r[1] for r in rows}
        due = [tuple(r) for r in timing.retry_due(here, 5).collect() if r.due_us <= passed]
        waited = timing.eventually(here.filter(step), here.filter(met), 30).collect()
        waited = [tuple(r) for r in waited if (at[r[0]] + 31) * 1_000_000 < passed]
        ticks = timing.missed_ticks(timing.heartbeat_slots(here, 10), 10, 10, passed)
        return {"due": due, "waited": waited, "ticks": list(map(tuple, ticks.collect()))}

    arrive(0, half)
    for name, rows_wanted in want(ordered[:half]).items():
        assert ran(name) == sorted(rows_wanted), name
    arrive(half, len(ordered))
    for name, rows_wanted in want(ordered).items():
        assert ran(name) == sorted(rows_wanted), name


def test_streams_wait_in_state_of_spark(spark, tmp_path):
    """A stream-stream join on the owner and time, and one state per owner."""
    _, df = events(spark, 10)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "due")
    query = timing.retry_due_stream(stream, target, f"{target}-cp", 5, 20)
    query.awaitTermination()
    assert any("symmetricHashJoin" in o.operatorName for o in query.lastProgress.stateOperators)
    target = str(tmp_path / "ticks")
    query = timing.liveness_stream(stream, target, f"{target}-cp", 10, 10, 20)
    query.awaitTermination()
    owners = df.select("owner").distinct().count()
    assert [o.numRowsTotal for o in query.lastProgress.stateOperators] == [owners]


def test_a_silent_owner_is_reported_and_forgotten(spark, tmp_path):
    """Only others are heard of; with a limit the owner is dropped after so many ticks."""
    schema, source = "owner string, ts timestamp", str(tmp_path / "in")

    def beats(*rows):
        df = spark.createDataFrame(rows, "owner string, ts bigint")
        df.select("owner", F.timestamp_seconds("ts").alias("ts")).coalesce(1).write.mode(
            "append"
        ).parquet(source)

    def ran(target, forget):
        stream = spark.readStream.schema(schema).parquet(source)
        query = timing.liveness_stream(stream, target, f"{target}-cp", 10, 10, 0, forget_periods=forget)
        query.awaitTermination()
        states = sum(o.numRowsTotal for o in query.lastProgress.stateOperators)
        rows = spark.read.schema(timing.TICKS).parquet(target).collect()
        return sorted(r.tick_s for r in rows if r.owner == "quiet"), states

    all_, some = str(tmp_path / "all"), str(tmp_path / "some")
    beats(("quiet", 1_000), ("loud", 1_000))
    assert ran(all_, None) == ([], 2) and ran(some, 3) == ([], 2)
    beats(*[("loud", t) for t in range(1_005, 1_031, 5)])
    assert ran(all_, None) == ([1_010, 1_020], 2) and ran(some, 3) == ([1_010, 1_020], 2)
    beats(*[("loud", t) for t in range(1_035, 1_101, 5)])
    assert ran(all_, None) == (list(range(1_010, 1_100, 10)), 2)
    assert ran(some, 3) == ([1_010, 1_020, 1_030], 1)
    beats(("quiet", 1_105), ("loud", 1_139))
    assert ran(some, 3) == ([1_010, 1_020, 1_030, 1_120], 2)


def files(path, rows, parts):
    path.mkdir(parents=True, exist_ok=True)
    for i in range(parts):
        (path / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i::parts]))


def test_watch_of_four_folders_and_latest(spark, tmp_path):
    kinds = ["SparkCluster", "Service", "ConfigMap", "StatefulSet"]
    want = {}
    for k, kind in enumerate(kinds):
        rows = []
        for i in range(30):
            owner, version = f"c-{i % 5}", i * 4 + k
            name = {"name": owner} if kind == "SparkCluster" else {"owner": owner}
            rows.append({"resource_version": version, "ts": "2024-01-01T00:00:00Z", **name,
                         "change": "MODIFIED", "extra": 1})
            want[owner] = max(want.get(owner, -1), version)
        files(tmp_path / kind, rows, parts=3)
    stream = watch(
        spark, {k: str(tmp_path / k) for k in kinds}, "json", maxFilesPerTrigger="1"
    )
    target = str(tmp_path / "snapshot")
    query = latest.upsert_stream(
        latest.latest_stream(stream), target, str(tmp_path / "cp"), ["owner"], ["resource_version"]
    )
    query.awaitTermination()
    got = snapshot.read_snapshot(spark, target, ["owner"], ["resource_version"])
    assert {r.owner: r.resource_version for r in got.collect()} == want


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int, x string")


KEYS, ORDER = ["k"], ["v"]


def now(spark, path):
    return sorted(map(tuple, snapshot.read_snapshot(spark, path, KEYS, ORDER).collect()))


def test_snapshot_replay_and_compaction(spark, tmp_path):
    target = str(tmp_path / "s")
    assert snapshot.read_snapshot(spark, target, KEYS, ORDER, "k string").count() == 0
    snapshot.apply_snapshot(rows_of(spark, ("a", 1, "old"), ("b", 1, "b1")), target, KEYS, ORDER, 0)
    second = rows_of(spark, ("a", 3, "new"), ("a", 2, "mid"))
    snapshot.apply_snapshot(second, target, KEYS, ORDER, 1)
    before = now(spark, target)
    assert before == [("a", 3, "new"), ("b", 1, "b1")]
    snapshot.apply_snapshot(second, target, KEYS, ORDER, 1)
    snapshot.apply_snapshot(rows_of(spark, ("a", 2, "late")), target, KEYS, ORDER, 2)
    snapshot.apply_snapshot(rows_of(spark), target, KEYS, ORDER, 3)
    assert now(spark, target) == before
    compacted = str(tmp_path / "c")
    snapshot.compact_snapshot(spark, target, compacted, KEYS, ORDER)
    assert now(spark, compacted) == before


def test_snapshot_levels_stay_few(spark, tmp_path, monkeypatch):
    """Runs are merged level by level; of a key only the current row is kept there."""
    monkeypatch.setattr(snapshot, "FANOUT", 2)
    monkeypatch.setattr(snapshot, "BUCKETS", 2)
    target, want, rng = str(tmp_path / "s"), {}, random.Random(5)
    for i in range(13):
        batch = [(rng.choice("abcdefgh"), rng.randrange(9), f"{i}-{j}") for j in range(4)]
        snapshot.apply_snapshot(rows_of(spark, *batch), target, KEYS, ORDER, i)
        newest = {}
        for k, v, x in batch:
            newest[k] = max(newest.get(k, (-1, "")), (v, x), key=lambda e: e[0])
        for k, (v, x) in newest.items():
            if k not in want or v >= want[k][0]:
                want[k] = (v, x)
        live = snapshot.read_manifest(spark, target).runs
        assert len(live) == bin(i + 1).count("1")
    got = {k: v for k, v, _ in now(spark, target)}
    assert got == {k: v for k, (v, _) in want.items()}


def test_a_thousand_batches_open_few_runs():
    """The manifest alone, without data."""
    manifest, most = snapshot.Manifest(), 0
    for i in range(1_000):
        manifest = manifest.add(0, i)
        while full := manifest.full_level():
            manifest = manifest.add(full[0] + 1, None, full[1])
        assert len(set(manifest.runs)) == len(manifest.runs)
        most = max(most, len(manifest.runs))
    assert most <= (snapshot.FANOUT - 1) * 4 and manifest.last_batch == 999


@pytest.mark.parametrize("when", ["run", "manifest", "merge"])
def test_a_crash_between_data_and_pointer_changes_nothing(spark, tmp_path, monkeypatch, when):
    monkeypatch.setattr(snapshot, "FANOUT", 3)
    target = str(tmp_path / "s")
    for i in range(2):
        snapshot.apply_snapshot(rows_of(spark, ("a", i, "x"), (f"k{i}", i, "y")), target, KEYS, ORDER, i)
    before, batch = now(spark, target), rows_of(spark, ("a", 9, "z"), ("n", 1, "n"))
    after = sorted([r for r in before if r[0] != "a"] + [("a", 9, "z"), ("n", 1, "n")])
    with monkeypatch.context() as broken:
        writes = {"manifest": 0}

        def fail(*args):
            raise RuntimeError("crash")

        def fail_second(*args, write=snapshot._write_manifest):
            writes["manifest"] += 1
            return fail() if writes["manifest"] == 2 else write(*args)

        if when == "run":
            broken.setattr(snapshot, "_write_run", fail)
        else:
            broken.setattr(snapshot, "_write_manifest", fail if when == "manifest" else fail_second)
        with pytest.raises(RuntimeError, match="crash"):
            snapshot.apply_snapshot(batch, target, KEYS, ORDER, 2)
    assert now(spark, target) == (after if when == "merge" else before)
    snapshot.apply_snapshot(batch, target, KEYS, ORDER, 2)
    assert now(spark, target) == after
    # A manifest half written counts for nothing.
    version = snapshot.read_manifest(spark, target).version
    with open(f"{target}/manifest-{(version + 1) % 2}/part-broken.json", "w") as f:
        f.write('{"version": 99, "last_ba')
    assert now(spark, target) == after


def test_snapshot_keeps_its_own_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="run_bucket"):
        df = rows_of(spark, ("a", 1, "x")).withColumn("run_bucket", F.lit(1))
        snapshot.apply_snapshot(df, str(tmp_path / "s"), KEYS, ORDER, 0)


def test_report_is_not_repeated(spark, tmp_path):
    _, df = events(spark, 60)
    failed = sinks.report_of_watch(df)
    target = str(tmp_path / "r")
    for _ in range(2):
        sinks.report(failed, target, batch_id=7)
    assert spark.read.parquet(target).count() == failed.count()


def test_stop_raises_what_the_stream_met(spark, tmp_path):
    def fail(batch, batch_id):
        raise ValueError("broken sink")

    _, df = events(spark, 10)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = latest.start(stream, fail, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="broken sink"):
        query.awaitTermination()
    with pytest.raises(Exception, match="broken sink"):
        latest.stop_stream(query)


def test_work_dir_is_the_shared_one(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    a, b = work_dir(spark, "x"), work_dir(spark, "x")
    assert a != b
    if shared:
        assert a.startswith(shared.rstrip("/"))
