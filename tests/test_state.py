"""Names, pods, selectors, state, matrices."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from muster.operators import matrix, project, selectors, state, steps
from muster.schema import KEY
from test_config import HISTORY, MASTER, WORKER, cluster, groups


def joined(spark, *rows, **kw):
    return groups(spark, *rows).join(cluster(spark, **kw), "cluster_id")


def test_names_and_ports(spark):
    df = joined(spark, MASTER, WORKER, HISTORY)
    names = {r.role: r for r in project.object_names(df).collect()}
    assert names["history-server"].object_name == "simple-spark-history-server-default"
    assert names["master"].global_service == "simple-spark-master"
    assert names["slave"].object_name == "simple-spark-slave-2core2g"
    assert names["master"].global_fqdn == "simple-spark-master.ns.svc.cluster.local"
    ports = {(r.role, r.port_name, r.port) for r in project.endpoints(df).collect()}
    assert ports == {
        ("master", "http", 8080), ("master", "rpc", 7077),
        ("slave", "http", 8081), ("history-server", "http", 18080),
    }
    commands = {r.role: r.command for r in project.start_command(df).collect()}
    assert commands == {
        "master": "sbin/start-master.sh",
        "slave": "sbin/start-slave.sh spark://simple-spark-master.ns.svc.cluster.local:7077",
        "history-server": "sbin/start-history-server.sh",
    }


def test_missing_parts_are_errors(spark):
    df = joined(spark, MASTER, WORKER, namespace=None)
    rows = {r.role: r for r in project.start_command(df).collect()}
    assert rows["slave"].error == "SparkMasterFqdnIsMissing" and rows["master"].error is None
    pods = project.expand_pods(df).collect()
    assert {(r.error, r.pod) for r in pods} == {("NoNamespace", None)}


def test_replicas_and_pods(spark):
    rows = [
        (1, "master", g, n, None, None, None) for g, n in (("a", 2), ("b", 0), ("c", None))
    ]
    df = joined(spark, *rows, stopped=True)
    got = {r.role_group: r.n for r in df.select("role_group", project.effective_replicas().alias("n")).collect()}
    assert got == {"a": 0, "b": 0, "c": 0}
    running = joined(spark, *rows, stopped=None)
    got = {r.role_group: r.n for r in running.select("role_group", project.effective_replicas().alias("n")).collect()}
    assert got == {"a": 2, "b": 0, "c": None}
    # Prediction ignores `stopped` unless asked to look.
    assert {r.pod for r in project.expand_pods(df).collect()} == {
        "simple-spark-master-a-0", "simple-spark-master-a-1"
    }
    assert project.expand_pods(df, respect_stopped=True).count() == 0


def test_unknown_role(spark):
    df = spark.createDataFrame([("master",), ("worker",), (None,)], "role string")
    errors = {r.role: r.error for r in project.check_role(df).collect()}
    assert errors["master"] is None
    assert errors["worker"].startswith("no role is called worker;")
    assert errors[None] is not None


def test_version_errors_are_rows(spark):
    df = cluster(spark, None).unionByName(cluster(spark, "x.y"))
    got = {r.version: r.version_error for r in project.with_product_version(df).collect()}
    assert got == {None: "ObjectHasNoVersion", "x.y": "invalid_version"}


def test_scenarios(spark, monkeypatch):
    dims = [("spark", v) for v in ("3.2.1", "3.2.2", "3.2.3")]
    dims += [("hadoop", v) for v in ("3.1.0", "3.2.0")] + [("aws", v) for v in ("abc", "xyz")]
    dimensions = spark.createDataFrame(dims, "dim string, value string")
    tests = spark.createDataFrame(
        [("pi", ["spark", "hadoop"]), ("none", []), ("odd", ["nope"])],
        "test string, dims array<string>",
    )
    expected = [f"spark-{s}_hadoop-{h}" for s in ("3.2.1", "3.2.2", "3.2.3") for h in ("3.1.0", "3.2.0")]
    for small in (True, False):
        monkeypatch.setattr(matrix, "settled", lambda df, name, small=small: (df, small))
        rows = matrix.scenario_grid(dimensions, tests).collect()
        assert sorted(r.scenario for r in rows if r.test == "pi") == expected
        assert {r.test for r in rows} == {"pi", "none"}


OPERATORS = {
    "In": lambda have, vals: have in vals,
    "NotIn": lambda have, vals: have not in vals,
    "Exists": lambda have, vals: have is not None,
    "DoesNotExist": lambda have, vals: have is None,
}


@pytest.mark.parametrize("rows, short", [(50_000, 64), (7, 1)])
def test_selectors_against_brute_force(spark, monkeypatch, rows, short):
    """Also with many salts, and where lists of two values count as long."""
    monkeypatch.setattr(selectors, "SALT_ROWS", rows)
    monkeypatch.setattr(selectors, "SHORT", short)
    rng = random.Random(7)
    # A third of all objects look the same.
    objects = [
        (i, {"zone": "hot"} if i % 3 == 0 else
         {k: rng.choice("xyz") for k in rng.sample(["zone", "disk", "arch"], rng.randint(0, 3))})
        for i in range(300)
    ]
    def expr():
        op = rng.choice([*OPERATORS, "Unknown"])
        vals = rng.sample(["x", "y", "z", "hot", ""], rng.randint(0, 3)) if op in ("In", "NotIn") else []
        return (rng.choice(["zone", "disk", "arch"]), op, vals)

    chosen = [(s, None if s == 0 else [expr() for _ in range(rng.randint(0, 3))]) for s in range(60)]
    want = {
        (s, i)
        for (s, exprs), (i, labels) in itertools.product(chosen, objects)
        if exprs is not None
        and all(op in OPERATORS and OPERATORS[op](labels.get(k), v) for k, op, v in exprs)
    }
    got = selectors.select_by_labels(
        spark.createDataFrame(objects, "id int, labels map<string,string>"),
        spark.createDataFrame(
            chosen,
            "selector_id int, exprs array<struct<label_key:string,operator:string,vals:array<string>>>",
        ),
        ["id"],
    )
    rows = [(r.selector_id, r.id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_long_lists_are_joined_after_the_match(spark):
    """Many selectors of many values; the plan repeats no list for an object."""
    n = 300
    objects = spark.range(2_000).select(
        "id", F.create_map(F.lit("zone"), (F.col("id") % n).cast("string"), F.lit("hot"), F.lit("yes")).alias("labels")
    )
    values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("string"))
    rest = F.filter(values, lambda v: v != F.col("id").cast("string"))

    def expr(key, operator, vals):
        return F.struct(F.lit(key).alias("label_key"), F.lit(operator).alias("operator"), vals.alias("vals"))

    hot = F.array(F.lit("yes"))
    chosen = spark.range(n).select(
        F.col("id").alias("selector_id"), F.array(expr("hot", "In", hot), expr("zone", "NotIn", rest)).alias("exprs")
    )
    got = selectors.select_by_labels(objects, chosen, ["id"]).collect()
    assert sorted((r.selector_id, r.id) for r in got) == sorted((i % n, i) for i in range(2_000))


def test_selector_of_a_spec(spark):
    schema = "s struct<matchLabels:map<string,string>,matchExpressions:array<struct<key:string,operator:string,values:array<string>>>>"
    rows = [((({"os": "linux"}), [("gpu", "Exists", None)]),), (None,), ((None, None),)]
    got = [r.e for r in spark.createDataFrame(rows, schema).select(
        selectors.selector_expressions(F.col("s")).alias("e")).collect()]
    assert [tuple(x) for x in got[0]] == [("os", "In", ["linux"]), ("gpu", "Exists", [])]
    assert got[1] is None and got[2] == []


def test_diff_covers_every_key_once(spark):
    desired = spark.createDataFrame(
        [(1, "master", "a", 1), (1, "master", "b", None), (1, "master", "c", 2)],
        "cluster_id int, role string, role_group string, desired_replicas int",
    )
    observed = spark.createDataFrame(
        [(1, "master", "a", 3), (1, "master", "b", 9), (1, "master", "d", 1)],
        "cluster_id int, role string, role_group string, observed_replicas int",
    )
    got = {r.role_group: r.action for r in state.diff_state(desired, observed).collect()}
    assert got == {"a": "update", "b": "noop", "c": "create", "d": "orphan"}


def test_expectations_of_the_two_steps(spark):
    names = ["spark-master-default", "spark-slave-default", "spark-history-server-default"]
    schema = "name string, replicas int, ready_replicas int"
    expected = spark.createDataFrame([(n, 3 if "slave" in n else 1, None) for n in names], schema)
    seen = spark.createDataFrame([(names[0], 1, 0), (names[1], 1, 1)], schema)
    got = {
        r.name: r.result
        for r in state.check_expectations(expected, seen, ["name"], ["replicas", "ready_replicas"]).collect()
    }
    assert got == {names[0]: "pass", names[1]: "mismatch", names[2]: "missing"}


def test_a_cluster_with_a_third_of_all_role_groups(spark, catalog):
    """The hot cluster's result is whole, and its rows end up in many partitions."""
    from muster.plans.effective import effective_config, group_rows
    from test_config import CLUSTER, GROUP, OVERRIDE

    n = 3000
    rgs = spark.range(n).selectExpr(
        "if(id % 3 = 0, 0, id) AS cluster_id", "'slave' AS role",
        "concat('g', id) AS role_group", "1 AS replicas", "id AS cores",
        "'1g' AS memory", "CAST(NULL AS STRING) AS store_path",
    )
    clusters = rgs.select("cluster_id").distinct().selectExpr(
        "cluster_id", "'c' AS cluster", "'n' AS namespace", "'3.1.1' AS version",
        "false AS stopped", "CAST(NULL AS STRING) AS secret", "1L AS max_port_retries",
    )
    hot_override = spark.createDataFrame(
        [(0, "slave", None, 2, "spark-defaults.conf", "spark.port.maxRetries", "5")], OVERRIDE
    )
    config = effective_config(clusters, rgs, hot_override, catalog)
    retries = config.filter("prop = 'spark.port.maxRetries'").groupBy("value", "layer").count()
    assert {(r.value, r.layer): r["count"] for r in retries.collect()} == {
        ("5", 2): n // 3, ("1", 1): n - n // 3
    }
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = (
            group_rows(clusters, rgs, hot_override).filter("cluster_id = 0")
            .groupBy(F.spark_partition_id()).count().count()
        )
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


def test_latest_per_key_keeps_columns(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, x string")
    got = state.latest_per_key(df, ["k"], ["v"])
    assert got.columns == ["k", "v", "x"]
    assert sorted(map(tuple, got.collect())) == [("a", 2, "y"), ("b", 1, "z")]
    assert KEY == ["cluster_id", "role", "role_group"]


def simple_steps(tests, expectations, changes, timeout):
    """Every instant of a step's time, one after the other."""

    def status(thing, t):
        past = [(us, v, s) for o, us, v, s in changes if o == thing and us <= t]
        return max(past)[2] if past else None

    out = {}
    for test, start in tests:
        mine = {}
        for t, k, thing, want in expectations:
            if t == test:
                mine.setdefault(k, set()).add((thing, want))
        for k in sorted(mine):
            if start is None:
                out[test, k] = ("not_run", None, None)
                continue
            end = start + timeout
            instants = sorted({start, *(us for o, us, _, _ in changes if start < us <= end)})
            met = next((t for t in instants if all(status(o, t) == w for o, w in mine[k])), None)
            out[test, k] = ("timeout", start, end) if met is None else ("pass", start, met)
            start = met
    return out


def run_steps(spark, tests, expectations, changes, timeout_s):
    got = steps.run_steps(
        spark.createDataFrame(tests, "test string, start_us bigint"),
        spark.createDataFrame(expectations, "test string, step int, object string, expected string"),
        spark.createDataFrame(changes, "object string, us bigint, version bigint, status string"),
        timeout_s,
    ).collect()
    assert len(got) == len({(r.test, r.step) for r in got})
    return {(r.test, r.step): (r.result, r.start_us, r.end_us) for r in got}


def test_steps_against_brute_force(spark):
    rng = random.Random(11)
    second = 1_000_000
    changes = [
        (rng.choice("abc"), rng.randrange(60) * second, i, rng.choice("01")) for i in range(60)
    ]
    tests = [(f"t{i}", rng.randrange(30) * second) for i in range(40)]
    expectations = [
        (t, k, thing, rng.choice("01"))
        for t, _ in tests
        for k in range(1, rng.randint(1, 4) + 1)
        for thing in rng.sample("abcz" if rng.random() < 0.1 else "abc", rng.randint(1, 3))
    ]
    want = simple_steps(tests, expectations, changes, 20 * second)
    assert run_steps(spark, tests, expectations + expectations[:3], changes, 20) == want
    assert {r for r, *_ in want.values()} == {"pass", "timeout", "not_run"}
    assert run_steps(spark, tests, [], changes, 20) == {}


def test_expectations_that_never_hold_together_time_out(spark):
    """Each holds at times, the second only when the first does not; at the instant both
    turn, and where both hold for no time at all, neither counts."""
    second = 1_000_000
    changes = [("a", 0, 1, "up"), ("b", 0, 2, "down")]
    changes += [("a", 10 * second, 3, "down"), ("b", 10 * second, 4, "up")]
    changes += [("a", 20 * second, 5, "up"), ("b", 20 * second, 6, "up"), ("b", 20 * second, 7, "down")]
    both = [("t", 1, "a", "up"), ("t", 1, "b", "up"), ("t", 2, "a", "up")]
    got = run_steps(spark, [("t", 0)], both, changes, 300)
    assert got == {("t", 1): ("timeout", 0, 300 * second), ("t", 2): ("not_run", None, None)}
    changes.append(("b", 30 * second, 8, "up"))
    got = run_steps(spark, [("t", 0)], both, changes, 300)
    assert got == {("t", 1): ("pass", 0, 30 * second), ("t", 2): ("pass", 30 * second, 30 * second)}
