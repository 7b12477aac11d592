"""The tree of digests and the diff that descends in it."""

import random
import time

from pyspark.sql import functions as F

from muster.operators import digests

PROPS = "cluster_id bigint, role string, role_group string, file string, prop string, value string"


def fleet(rng, clusters=30):
    rows = {}
    for c in range(clusters):
        for _ in range(rng.randrange(1, 12)):
            key = (c, rng.choice(["master", "slave"]), f"g{rng.randrange(2)}", rng.choice("xy"), rng.choice("abcdef"))
            rows[key] = rng.choice(["1", "2", "", None])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], PROPS)


def simple_diff(old, new):
    return sorted(
        ((*k, old.get(k), new.get(k)) for k in old.keys() | new.keys() if old.get(k) != new.get(k)), key=repr
    )


def test_diff_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    old = fleet(rng)
    new = dict(old)
    for k in rng.sample(sorted(new), 6):
        del new[k]
    for k in rng.sample(sorted(new), 6):
        new[k] = "changed"
    new[99, "master", "g0", "x", "a"] = "1"
    paths = [str(tmp_path / n) for n in ("old", "new", "same")]
    for path, rows in zip(paths, (old, new, dict(reversed(old.items())))):
        digests.write_tree(frame(spark, rows).repartition(5), path)
    got = digests.diff_trees(spark, *paths[:2]).collect()
    assert sorted(map(tuple, got), key=repr) == simple_diff(old, new)
    assert digests.diff_trees(spark, paths[0], paths[2]).count() == 0


def test_a_parent_changes_exactly_with_its_children(spark):
    rows = fleet(random.Random(3))
    key = sorted(rows)[7]
    trees = [digests.tree(frame(spark, r)) for r in (rows, {**rows, key: "changed"})]
    for level, keys in digests.LEVELS.items():
        a, b = ({tuple(r[k] for k in keys): r.digest for r in t[level].collect()} for t in trees)
        assert a.keys() == b.keys()
        assert [k for k in a if a[k] != b[k]] == [key[: len(keys)] if level != "file" else key[:4]]


def test_texts_that_run_together_differ(spark):
    one = frame(spark, {(1, "master", "g", "x", "ab"): "c", (1, "master", "g", "x", "n"): None})
    two = frame(spark, {(1, "master", "g", "x", "a"): "bc", (1, "master", "g", "x", "n"): ""})
    a, b = (digests.discovery_digests(df).first().digest for df in (one, two))
    assert a != b and len(a) == 60


def test_parts_of_a_node_merge(spark):
    rows = fleet(random.Random(4))
    files = digests.tree(frame(spark, rows))["file"].select("cluster_id", "digest", "n")
    whole = digests.merged([files])
    halves = [files.filter(F.pmod(F.xxhash64("digest"), F.lit(2)) == i) for i in (0, 1)]
    both = digests.merged([digests.merged([h]) for h in halves])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, both.collect()))


def test_the_diff_reads_buckets_that_differ(spark, tmp_path):
    """One changed cluster: of the properties, only files of its bucket are opened."""
    rows = fleet(random.Random(5), clusters=200)
    key = sorted(rows)[50]
    for name, r in (("old", rows), ("new", {**rows, key: "changed"})):
        digests.write_tree(frame(spark, r), str(tmp_path / name))
    diff = digests.diff_trees(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert [tuple(r)[:5] for r in diff.collect()] == [key]
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = {(c, "master", "g", "x", "a"): "1" for c in range(400)}
    changed = {**rows, (7, "master", "g", "x", "a"): "2"}
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for name, fleet_rows in (("old", rows), ("new", changed)):
            digests.write_tree(frame(spark, fleet_rows), str(tmp_path / name), buckets=2)
        got = digests.diff_trees(spark, str(tmp_path / "old"), str(tmp_path / "new")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in got] == [(7, "master", "g", "x", "a", "1", "2")]
    for bucket in (tmp_path / "old" / "prop").glob("bucket=*"):
        assert len(list(bucket.glob("*.parquet"))) > 4
    same = digests.properties_of(spark, str(tmp_path / "old")).collect()
    assert sorted(map(tuple, same)) == sorted((*k, v) for k, v in rows.items())


def test_sums_of_parts_are_exact(spark):
    """Digests equal sums of whole numbers modulo 2^60, whatever carries over."""
    size, hashes = 1 << 60, ["f" * 64, "f" * 60 + "0" * 4, "0" * 14 + "1" + "8" + "0" * 48, "7" * 64] * 50
    want = "".join(
        f"{sum(int(h[15 * k : 15 * k + 15], 16) for h in hashes) % size:015x}" for k in range(4)
    )
    rows = spark.createDataFrame([(1, h) for h in hashes], "k int, hash string")
    got = digests._text(rows, ["k"], "hash", F.count("*")).first()
    assert (got.digest, got.n) == (want, len(hashes))


def _shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_written_levels_leave_no_shuffle_files(spark, tmp_path):
    """What the steps have shuffled does not add up on disk, and rows are not shuffled only to
    be written."""
    rows = fleet(random.Random(6), clusters=100)
    key = sorted(rows)[50]
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(setting), _shuffle_files(spark)
    for name, r in (("old", rows), ("new", {**rows, key: "changed"})):
        digests.write_tree(frame(spark, r), str(tmp_path / name))
    diff = digests.diff_trees(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    for _ in range(100):
        left = _shuffle_files(spark) - files
        if not left:
            break
        time.sleep(0.1)
    assert left == set() and spark.conf.get(setting) == before
    assert [tuple(r)[:5] for r in diff.collect()] == [key]


def test_a_full_sketch_leaves_the_diff_exact(spark, tmp_path, monkeypatch):
    """One word for all nodes lets others through, among them files with a property that
    comes twice, and so is not the same as itself."""
    monkeypatch.setattr(digests, "SKETCH_WORDS", 1)
    rng = random.Random(7)
    old = fleet(rng, clusters=60)
    keys = rng.sample(sorted(old), 25)
    new = {**old, **dict.fromkeys(keys, "changed")}
    twice = [(c, "master", "g0", "z", "a", v) for c in range(60) for v in "12"]
    for name, rows in (("old", old), ("new", new)):
        both = frame(spark, rows).unionByName(spark.createDataFrame(twice, PROPS))
        digests.write_tree(both, str(tmp_path / name))
    got = digests.diff_trees(spark, str(tmp_path / "old"), str(tmp_path / "new")).collect()
    assert sorted(map(tuple, got), key=repr) == simple_diff(old, new)


def test_rows_below_nodes_that_do_not_differ_are_not_shuffled(spark):
    nodes = spark.createDataFrame([(0, 1, "master", "g0")], "bucket int, cluster_id bigint, role string, role_group string")
    rows = [(0, c, "master", f"g{g}", "x", "d") for c in range(500) for g in range(2)] + [(0, 1, None, "g0", "x", "d")]
    table = spark.createDataFrame(rows, "bucket int, cluster_id bigint, role string, role_group string, file string, digest string")
    keys = digests.LEVELS["group"]
    left = digests._below(table, digests._sketch(nodes, keys), keys).collect()
    assert (0, 1, "master", "g0", "x", "d") in map(tuple, left) and len(left) < 20
