"""Three-way merges, reconciling by content with retries, errors, texts within rows."""

import random

from pyspark.sql import functions as F

from muster.operators import errors, patch, render
from muster.plans import effective, queries
from muster.plans.bindings import Fleet
from muster.schema import KEY
from muster.sources import snapshot
from muster.streaming import reconcile
from test_config import HISTORY, MASTER, WORKER, cluster, groups, overrides

FIELDS = "id int, fields map<string,string>"


def simple_merge(want, gave, has):
    """(action, patch, after) of one object; a side that is None is not there."""
    w, g, h = ({k: v for k, v in (m or {}).items() if v is not None} for m in (want, gave, has))
    steps = []
    for path in sorted(set(w) | (set(g) & set(h))):
        taken = path in g and path in h and g[path] != h[path]
        if path in w and w[path] != h.get(path):
            steps.append((path, "set", w[path], taken))
        elif path not in w and g[path] == h[path]:
            steps.append((path, "remove", None, taken))
    if has is None:
        return "create", steps, w
    if want is None:
        return "orphan", [], h
    gone = {p for p, op, *_ in steps if op == "remove"}
    after = {**{p: v for p, v in h.items() if p not in gone}, **w}
    return ("update" if steps else "adopt" if w != g else "noop"), steps, after


def test_three_way_against_brute_force(spark):
    rng = random.Random(1)

    def side():
        if rng.random() < 0.15:
            return None
        return {p: rng.choice(["1", "1", "2", None]) for p in rng.sample("abcdé", rng.randrange(6))}

    objects = [(i, side(), side(), side()) for i in range(400)]
    objects += [(i, x[1], x[1], x[1]) for i, x in enumerate(objects[:40], 400)]
    sides = [
        spark.createDataFrame([(o[0], o[k]) for o in objects if o[k] is not None], FIELDS)
        for k in (1, 2, 3)
    ]
    got = patch.three_way(*sides, keys=["id"]).collect()
    want = {
        i: simple_merge(w, g, h) for i, w, g, h in objects if w is not None or h is not None
    }
    assert len(got) == len(want)
    for r in got:
        assert (r.action, [tuple(p) for p in r.patch], r.after) == want[r.id], r.id
    assert {r.action for r in got} == {"create", "update", "adopt", "noop", "orphan"}


def test_a_patch_applied_leaves_nothing_to_do(spark):
    """Foreign fields survive, and once more nothing differs."""
    desired = spark.createDataFrame([(1, {"a": "1", "b": "2"})], FIELDS)
    applied = spark.createDataFrame([(1, {"a": "0", "old": "x", "lost": "y"})], FIELDS)
    observed = spark.createDataFrame([(1, {"a": "0", "old": "x", "lost": "z", "theirs": "t"})], FIELDS)
    (first,) = patch.three_way(desired, applied, observed, ["id"]).collect()
    assert [(p.path, p.op, p.value) for p in first.patch] == [
        ("a", "set", "1"), ("b", "set", "2"), ("old", "remove", None)
    ]
    assert first.after == {"a": "1", "b": "2", "lost": "z", "theirs": "t"}
    after = spark.createDataFrame([(1, first.after)], FIELDS)
    (second,) = patch.three_way(desired, desired, after, ["id"]).collect()
    assert second.action == "noop" and second.patch == [] and second.after == first.after


def test_one_shuffle_meets_all_sides(spark):
    df = spark.createDataFrame([(1, {"a": "1"})], FIELDS)
    plan = patch.three_way(df, df, df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


CHANGES = "resource_version bigint, ts timestamp, owner string, kind string, change string, error_category string, value double"


def test_reconcile_by_content_with_retries(spark, catalog, tmp_path):
    """Batch by batch: create; a changed property alone; nothing; a broken cluster that goes
    well later, without a change of its own."""
    rgs = groups(spark, MASTER, WORKER, HISTORY)
    world = {"overrides": overrides(spark), "version": "3.1.1"}
    there = {"fields": spark.createDataFrame([], "cluster_id int, role string, role_group string, fields map<string,string>")}
    target, source = str(tmp_path / "rows"), str(tmp_path / "in")

    def fleet():
        return cluster(spark, world["version"]), rgs, world["overrides"]

    def batch(number, seconds, owner="simple-spark"):
        row = [(number, seconds, owner, "SparkCluster", "MODIFIED", None, 1.0)]
        df = spark.createDataFrame(row, CHANGES.replace("ts timestamp", "ts bigint"))
        df = df.withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        reconcile.reconcile_stream(
            stream, fleet, lambda: there["fields"], catalog, target, str(tmp_path / "cp"),
            str(tmp_path / "errors"),
        ).awaitTermination()
        rows = snapshot.read_snapshot(spark, target, KEY, ["reconciled_in"]).collect()
        # The world takes the patches.
        there["fields"] = spark.createDataFrame(
            [(r.cluster_id, r.role, r.role_group, r.after) for r in rows], there["fields"].schema
        )
        return {r.role: r for r in rows if r.reconciled_in == max(x.reconciled_in for x in rows)}

    first = batch(1, 100)
    assert {r.action for r in first.values()} == {"create"} and len(first) == 3
    world["overrides"] = overrides(
        spark, (1, "slave", "2core2g", 4, "spark-defaults.conf", "spark.port.maxRetries", "7")
    )
    second = batch(2, 200)
    assert set(second) == {"slave"} and second["slave"].action == "update"
    assert [tuple(p) for p in second["slave"].patch] == [
        ("spark-defaults.conf/spark.port.maxRetries", "set", "7", False)
    ]
    assert second["slave"].fingerprint != first["slave"].fingerprint
    n = snapshot.read_manifest(spark, target).last_batch
    assert batch(3, 300) == second and snapshot.read_manifest(spark, target).last_batch == n + 1
    world["version"] = "x.y"
    batch(4, 400)
    report = spark.read.parquet(str(tmp_path / "errors")).collect()
    assert [(r.object, r.category) for r in report] == [("simple-spark", "invalid_version")]
    # Mended, and due: another cluster's change is enough.
    world["version"] = "3.1.1"
    world["overrides"] = overrides(spark)
    assert {r.reconciled_in for r in batch(5, 404, "other").values()} == {1}  # not due yet
    last = batch(6, 406, "other")
    assert last["slave"].action == "update" and last["slave"].patch[0].op in ("set", "remove")
    due = snapshot.read_snapshot(spark, f"{target}-due", ["cluster"], ["batch"]).collect()
    assert [(r.cluster, r.due_us) for r in due] == [("simple-spark", None)]


def test_all_errors(spark):
    rows = [(1, "worker", "a", 1, None, None, None), (1, "slave", "b", 65_536, None, None, None),
            (1, None, "c", -1, None, None, None), (1, "master", "d", None, None, None, None)]
    homeless = cluster(spark, "x.y", namespace=None)
    got = {(r.object, r.category) for r in errors.errors_of(homeless, groups(spark, *rows)).collect()}
    assert got == {
        ("simple-spark", "invalid_version"), ("simple-spark", "NoNamespace"),
        ("simple-spark-worker-a", "InvalidRole"), ("simple-spark-slave-b", "InvalidReplicas"),
        ("simple-spark-slave-b", "SparkMasterFqdnIsMissing"), ("simple-spark-c", "InvalidRole"),
        ("simple-spark-c", "InvalidReplicas"),
    }
    fine = cluster(spark)
    assert errors.errors_of(fine, groups(spark, MASTER, WORKER)).count() == 0


def test_texts_within_rows_equal_those_of_grouped_rows(spark, catalog, monkeypatch):
    from muster import session

    cl, rgs = cluster(spark, secret="secret"), groups(spark, MASTER, WORKER, HISTORY)
    ovs = overrides(spark, (1, "slave", None, 2, "env", "E", "1"), (1, "slave", None, 2, "x.conf", "k", "v"))
    config = effective.effective_config(cl, rgs, ovs, catalog)

    def same(a, b):
        assert sorted(map(tuple, a.select(*sorted(a.columns)).collect()), key=repr) == sorted(
            map(tuple, b.select(*sorted(b.columns)).collect()), key=repr
        )

    for large in (False, True):
        if large:
            monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
            monkeypatch.setattr(type(catalog), "is_small", lambda *_: False)
        rows = effective.effective_rows(cl, rgs, ovs, catalog)
        same(render.texts_of(rows), render.render_config(config))
        same(
            render.config_map_columns(rows).select(*KEY, "spark_defaults", "spark_env", "metrics", "env", "error"),
            render.config_maps(rgs, config),
        )
        same(
            rows.select(*KEY, render.digest_of(F.col("props")).alias("fingerprint")),
            render.fingerprint(config),
        )
    merged = effective.merged_rows(cl, rgs, ovs, catalog)
    long = effective.merged_layers(cl, rgs, ovs, catalog)
    same(render.positions_of(merged), render.stable_order(long))


def test_texts_shuffle_nothing_after_the_joins(spark, catalog):
    cl, rgs, ovs = cluster(spark), groups(spark, MASTER), overrides(spark)
    rows = effective.effective_rows(cl, rgs, ovs, catalog)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    before = exchanges(effective.group_rows(cl, rgs, ovs))
    for df in (render.texts_of(rows), render.config_map_columns(rows), render.positions_of(rows)):
        assert exchanges(df) <= before




def _generators(df):
    """The generators of a plan that interpret what they are given."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Generate " in line and "lambda" in line]


def test_no_lambda_runs_within_a_generator(spark):
    """With one inside, a generator interprets everything it is given: objects, patches."""
    folder = "/root/testdata/sf0.001"
    assert _generators(queries.QUERIES["desired_objects"](spark, folder)) == []
    assert _generators(queries.QUERIES["patch_objects"](spark, folder)) == []


def test_fields_with_and_without_values(spark):
    row = "props array<struct<file:string,prop:string,value:string>>, n int"
    props = [("f", "a", "1"), ("f", "b", None), ("g", "a", "2")]
    df = spark.createDataFrame([(props, 3), (props, None), ([], None), (None, 1)], row)
    got = [r.m for r in df.select(patch.fields_of(F.col("props"), F.col("n")).alias("m")).collect()]
    assert got == [{"replicas": "3", "f/a": "1", "g/a": "2"}, {"f/a": "1", "g/a": "2"}, {}, {"replicas": "1"}]


def test_line_items_of_some_clusters_are_narrowed_before_grouping(spark):
    """Reconciling aggregates the line items of the clusters that change, not all of them."""
    fleet = Fleet(spark, "/root/testdata/sf0.001")
    ids = fleet.clusters().filter("cluster_id % 7 = 0").select("cluster_id")
    some = fleet.of_clusters(ids)
    for name in ("role_groups", "overrides", "observed"):
        got, whole = getattr(some, name)(), getattr(fleet, name)()
        want = whole.filter("cluster_id % 7 = 0")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
        plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = {w: min(i for i, x in enumerate(plan) if w in x) for w in ("Aggregate", "LeftSemi")}
        assert depth["Aggregate"] < depth["LeftSemi"], name


def test_sides_of_a_patch_are_not_shuffled_with_their_fields(spark, monkeypatch):
    """They are made where the rows of what is wanted are, of shuffles that all sides share,
    and nothing is written in between."""
    monkeypatch.setattr(queries, "work_dir", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.QUERIES["patch_objects"](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        union = min(i for i, line in enumerate(plan) if "Union" in line)
        assert not [line for line in plan[:union] if "Exchange" in line]
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # Three sides of four shuffles and more, two of them only shared.
        assert final.count("ReusedExchange") >= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
