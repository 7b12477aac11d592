"""Layers, catalog, validation and rendering on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from muster.catalog import Catalog, local_table
from muster.functions.checks import fits_datatype, fits_unit, java_pattern, java_pattern_of
from muster.functions.versions import bump, product_version, version_key, version_rank
from muster.operators import project, properties, render, validation
from muster.plans.effective import effective_config, effective_config_of_specs
from muster.sources import catalogs, specs

CLUSTER = (
    "cluster_id bigint, cluster string, namespace string, version string, stopped boolean, "
    "secret string, max_port_retries bigint"
)
GROUP = (
    "cluster_id bigint, role string, role_group string, replicas int, cores bigint, "
    "memory string, store_path string"
)
OVERRIDE = (
    "cluster_id bigint, role string, role_group string, layer int, file string, prop string, "
    "value string"
)
D = "spark-defaults.conf"


def cluster(spark, version="3.1.1-x0", secret=None, retries=None, stopped=None, namespace="ns"):
    row = [(1, "simple-spark", namespace, version, stopped, secret, retries)]
    return spark.createDataFrame(row, CLUSTER)


def groups(spark, *rows):
    return spark.createDataFrame(list(rows), GROUP)


def overrides(spark, *rows):
    return spark.createDataFrame(list(rows), OVERRIDE)


def effective(spark, catalog, clusters, rgs, ovs=()):
    df = effective_config(clusters, rgs, overrides(spark, *ovs), catalog)
    return {(r.role, r.role_group, r.file, r.prop): r for r in df.collect()}


MASTER = (1, "master", "default", 1, None, None, None)
WORKER = (1, "slave", "2core2g", None, 2, "2g", None)
HISTORY = (1, "history-server", "default", 1, None, None, "/data/a")


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_retries_are_written_even_when_unset(spark, catalog):
    got = effective(spark, catalog, cluster(spark), groups(spark, MASTER))
    row = got["master", "default", D, "spark.port.maxRetries"]
    assert (row.value, row.layer, row.status) == ("0", 1, "ok")


def test_secret_sets_two_properties(spark, catalog):
    got = effective(spark, catalog, cluster(spark, secret="hunter_22"), groups(spark, MASTER))
    assert got["master", "default", D, "spark.authenticate"].value == "true"
    assert got["master", "default", D, "spark.authenticate.secret"].value == "hunter_22"


def test_role_properties(spark, catalog):
    got = effective(spark, catalog, cluster(spark), groups(spark, MASTER, WORKER, HISTORY))
    assert got["master", "default", "env", "SPARK_MASTER_PORT"].value == "7077"
    assert ("slave", "2core2g", "env", "SPARK_MASTER_PORT") not in got
    assert got["slave", "2core2g", "spark-env.sh", "SPARK_WORKER_CORES"].value == "2"
    assert ("master", "default", "spark-env.sh", "SPARK_WORKER_CORES") not in got
    assert got["history-server", "default", D, "spark.history.store.path"].value == "/data/a"
    for role, group in (("master", "default"), ("slave", "2core2g"), ("history-server", "default")):
        metrics = [k for k in got if k[:2] == (role, group) and k[2] == "metrics.properties"]
        assert len(metrics) == 3


def test_required_is_filled_and_implies(spark, catalog):
    got = effective(spark, catalog, cluster(spark), groups(spark, HISTORY))
    fill = got["history-server", "default", D, "spark.history.fs.logDirectory"]
    assert (fill.layer, fill.status) == (0, "ok")
    implied = got["history-server", "default", D, "spark.eventLog.enabled"]
    assert (implied.value, implied.layer) == ("true", -1)


def test_layers_and_statuses(spark, catalog):
    ovs = [
        (1, "slave", None, 2, D, "spark.port.maxRetries", "r1"),
        (1, "slave", "2core2g", 4, D, "spark.driver.cores", "2"),
        (1, "slave", "2core2g", 4, D, "spark.history.store.path", "/x/y"),
        (1, "slave", "2core2g", 4, "env", "SPARK_WORKER_PORT", "9"),
        (1, "slave", "2core2g", 4, "spark-env.sh", "SPARK_WORKER_MEMORY", "2G"),
        (1, "slave", "2core2g", 4, D, "spark.eventLog.enabled", "false"),
        (1, "slave", "2core2g", 4, D, "spark.eventLog.dir", "/logs/a"),
        (1, "slave", "2core2g", 4, D, "spark.authenticate", None),
    ]
    got = effective(spark, catalog, cluster(spark, secret="secret"), groups(spark, WORKER), ovs)

    def row(prop, file=D):
        r = got["slave", "2core2g", file, prop]
        return r.value, r.layer, r.status

    assert row("spark.port.maxRetries") == ("r1", 2, "bad_type")
    assert row("spark.driver.cores") == ("2", 4, "uncatalogued")
    assert row("spark.history.store.path") == ("/x/y", 4, "wrong_role")
    assert row("SPARK_WORKER_PORT", "env") == ("9", 4, "reserved_port")
    assert row("SPARK_WORKER_MEMORY", "spark-env.sh") == ("2G", 4, "bad_unit")
    assert row("spark.eventLog.enabled") == ("false", 4, "ok")  # explicit beats implied
    assert row("spark.authenticate") == ("true", 1, "ok")  # NULL hides nothing


def test_versions_decide(spark, catalog):
    old = effective(spark, catalog, cluster(spark, "0.9.0"), groups(spark, MASTER))
    assert old["master", "default", D, "spark.port.maxRetries"].status == "not_yet_available"
    assert ("master", "default", "env", "SPARK_CONF_DIR") not in old
    assert effective(spark, catalog, cluster(spark, None), groups(spark, MASTER)) == {}
    odd = effective(spark, catalog, cluster(spark, "abc-1"), groups(spark, MASTER))
    assert {r.status for r in odd.values()} == {"invalid_version"}


def test_missing_required_without_a_value(spark):
    shipped = Catalog.built_in(spark)
    poor = Catalog.of(
        shipped.unit,
        shipped.property,
        shipped.property_role,
        shipped.property_value.filter("prop <> 'SPARK_CONF_DIR'"),
        shipped.property_expansion,
    )
    got = effective(spark, poor, cluster(spark), groups(spark, MASTER))
    row = got["master", "default", "env", "SPARK_CONF_DIR"]
    assert (row.value, row.layer, row.status) == (None, None, "missing_required")


def test_implications_are_transitive(spark):
    shipped = Catalog.built_in(spark)
    extra = local_table(
        spark,
        [("spark.eventLog.enabled", "spark.authenticate", "true")],
        "prop string,expands_to string,value string",
    )
    deep = Catalog.of(
        shipped.unit,
        shipped.property,
        shipped.property_role,
        shipped.property_value,
        shipped.property_expansion.unionByName(extra),
    )
    got = effective(spark, deep, cluster(spark), groups(spark, HISTORY))
    row = got["history-server", "default", D, "spark.authenticate"]
    assert (row.value, row.layer) == ("true", -1)


def expansions_of(spark, catalog, pairs):
    """The closure of a catalog whose properties are those of ``pairs``."""
    names = sorted({p for pair in pairs for p in pair[:2]})
    made = Catalog.of(
        catalog.unit,
        spark.createDataFrame([(n, "file", D, "string", None, "0.1.0") for n in names], catalog.property.schema),
        spark.createDataFrame([(n, "master", False) for n in names], catalog.property_role.schema),
        catalog.property_value,
        spark.createDataFrame(pairs, catalog.property_expansion.schema),
    )
    return {(r.prop, r.implied): r.value for r in made.implications().collect()}


def test_closures_of_any_depth_and_shape(spark, catalog):
    chain = [(f"p{i:02}", f"p{i + 1:02}", str(i)) for i in range(40)]
    got = expansions_of(spark, catalog, chain)
    assert len(got) == 40 * 41 // 2 and got["p00", "p40"] == "39"
    stages = [(f"{a}{i:02}", f"{b}{i + 1:02}", "v") for i in range(12) for a in "ab" for b in "ab"]
    assert len(expansions_of(spark, catalog, stages)) == 4 * 12 * 13 // 2
    cycle = [("x", "y", "1"), ("y", "z", "2"), ("z", "x", "3"), ("x", "z", "0")]
    assert expansions_of(spark, catalog, cycle) == {
        ("x", "y"): "1", ("x", "z"): "0", ("x", "x"): "3", ("y", "z"): "2", ("y", "x"): "3",
        ("y", "y"): "1", ("z", "x"): "3", ("z", "y"): "1", ("z", "z"): "0",
    }


def test_a_catalog_of_tables_gives_the_same(spark, catalog, monkeypatch):
    """Patterns as a column, and nothing small enough to broadcast."""
    from muster import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    large = Catalog.of(
        catalog.unit, catalog.property, catalog.property_role, catalog.property_value,
        catalog.property_expansion,
    )
    rgs, cl = groups(spark, MASTER, WORKER, HISTORY), cluster(spark, secret="secret")
    assert effective(spark, large, cl, rgs) == effective(spark, catalog, cl, rgs)


def test_value_ranges_by_version(spark, catalog):
    rows = [(v, "SPARK_DAEMON_MEMORY") for v in ("0.6.2", "1.4.1", "1.5.0", "3.1.1", "0.5.0")]
    props = spark.createDataFrame(rows, "v string, prop string").withColumn(
        "version_rank", version_rank(F.col("v"))
    )
    got = {r.v: r.range_value for r in validation.values_for_version(props, catalog).collect()}
    assert got == {"0.6.2": "512m", "1.4.1": "512m", "1.5.0": "1g", "3.1.1": "1g"}


def test_merge_does_not_depend_on_input_order(spark):
    rows = [(1, "master", "g", layer, D, p, f"{p}{layer}") for p in "abc" for layer in range(5)]
    schema = OVERRIDE
    forward = properties.merge_layers(spark.createDataFrame(rows, schema))
    backward = properties.merge_layers(spark.createDataFrame(rows[::-1], schema))
    assert sorted(forward.collect()) == sorted(backward.collect())
    again = properties.merge_layers(forward.select(spark.createDataFrame(rows, schema).columns))
    assert sorted(again.collect()) == sorted(forward.collect())
    assert {r.layer for r in forward.collect()} == {4}


@pytest.mark.parametrize(
    "value, unit, fits",
    [
        ("1024b", "memory", True), ("1024kb", "memory", True), ("500m", "memory", True),
        ("1g", "memory", True), ("2G", "memory", False), ("1000M", "memory", False),
        ("1 g", "memory", True), ("1g\n", "memory", False), ("g", "memory", False),
        ("/tmp/xyz", "directory", True), ("/tmp", "directory", False), ("/a/b/", "directory", False),
        ("secret", "password", True), ("shrt", "password", False), ("1secret", "password", False),
        ("s" * 21, "password", True), ("s" * 22, "password", False), ("Sécrets", "password", True),
        ("anything", "no such unit", True),
    ],
)
def test_units(spark, catalog, value, unit, fits):
    assert column(spark, value, lambda c: fits_unit(c, F.lit(unit), catalog.units)) is fits


def test_units_without_number_or_name(spark, catalog):
    many = [(f"u{i}", "^x+$") for i in range(2_000)]
    made = Catalog.of(
        spark.createDataFrame(many, catalog.unit.schema),
        spark.createDataFrame(
            [("p", "file", D, "string", "u1999", "0.1.0"), ("q", "file", D, "string", "none", "0.1.0")],
            catalog.property.schema,
        ),
        spark.createDataFrame([("p", "master", False), ("q", "master", False)], catalog.property_role.schema),
        catalog.property_value,
        catalog.property_expansion,
    )
    rows = [("p", "xx"), ("p", "xy"), ("q", "xx")]
    props = spark.createDataFrame(rows, "prop string, value string").withColumns(
        {"file": F.lit(D), "role": F.lit("master"), "layer": F.lit(4), "version_rank": F.lit("013.")}
    )
    matched = validation.match_catalog(props, made).withColumn("status", validation.status(made))
    got = {(r.prop, r.value): r.status for r in matched.collect()}
    assert got == {("p", "xx"): "ok", ("p", "xy"): "bad_unit", ("q", "xx"): "unknown_unit"}


def test_pattern_columns(spark):
    for regex in ("^a$", r"(a$)", r"a\$", "a", "(^b+)((c|d)\\b$)", "$"):
        assert column(spark, regex, java_pattern_of) == java_pattern(regex)


def test_pattern_endings():
    assert java_pattern("^a$") == r"(?U)^a\z"
    assert java_pattern(r"(a$)") == r"(?U)(a\z)"
    assert java_pattern(r"a\$") == r"(?U)a\$"


@pytest.mark.parametrize(
    "value, datatype, fits",
    [("5", "integer", True), ("-5", "integer", True), ("+5", "integer", False),
     (" 5 ", "integer", False), ("5\n", "integer", False), ("true", "bool", True),
     ("yes", "bool", False), ("1", "bool", False), ("x", "string", True)],
)
def test_datatypes(spark, value, datatype, fits):
    assert column(spark, value, lambda c: fits_datatype(c, F.lit(datatype))) is fits


def test_version_functions(spark):
    assert column(spark, "3.1.1-x0-y", product_version) == "3.1.1"
    assert column(spark, "3.10", version_key) == [3, 10, 0]
    assert column(spark, "abc", version_key) is None
    in_order = (
        "0", "0.0.1", "1.0", "3.1.1", "3.1.1.1", "3.1.1.2", "3.1.2", "3.9.0", "3.10", "3.10.1",
        "1234567.0.0", "1" + "0" * 30,
    )
    ranks = [column(spark, v, version_rank) for v in in_order]
    assert ranks == sorted(set(ranks))
    assert column(spark, "3.1", version_rank) == column(spark, "03.1.0.0", version_rank)
    for v, w in zip(ranks, ranks[1:]):
        assert v < v + "010." <= w
    assert column(spark, "5010.0", version_rank) == "045010."
    for malformed in ("x", "1..2", "", "9" * 100, "1.2-", " 1"):
        assert column(spark, malformed, version_rank) is None
    assert column(spark, "9" * 39, version_key) is None


@pytest.mark.parametrize(
    "version, level, bumped",
    [("0.6.0", "next_minor", "0.7.0-nightly"), ("0.6.0-nightly", "patch", "0.6.1"),
     ("0.6.3-nightly", "finalize", "0.6.3"), ("1.2.3", "major", "2.0.0"),
     ("1.2.3-rc.1", "following", "1.2.3"), ("1.2.3", "following", "1.2.4"),
     ("1.2.3", "prerelease", "1.2.3-nightly"), ("abc", "minor", None), ("1.2", "patch", None),
     ("1.2.x", "next_major", None)],
)
def test_bumps(spark, version, level, bumped):
    assert column(spark, version, lambda c: bump(c, level)) == bumped


def test_rendering(spark):
    rows = [
        (1, "slave", "g", 1, D, "b", "2"), (1, "slave", "g", 1, D, "B", "1"),
        (1, "slave", "g", 1, D, "a b", "x = y"), (1, "slave", "g", 1, "spark-env.sh", "K", "v"),
        (1, "slave", "g", 1, "env", "E", "1"),
    ]
    props = overrides(spark, *rows)
    texts = {r.file: r.text for r in render.render_config(props).collect()}
    assert texts == {D: "B 1\na b x = y\nb 2\n", "spark-env.sh": "K=v\n"}
    keys = groups(spark, (1, "slave", "g", 1, None, None, None), (1, "master", "h", 1, None, None, None))
    maps = {r.role: r for r in render.config_maps(keys, props).collect()}
    assert maps["slave"].metrics == "" and maps["slave"].error is None
    assert [tuple(e) for e in maps["slave"].env] == [("E", "1")]
    assert (maps["master"].spark_defaults, maps["master"].spark_env) == ("", "")
    undeclared = render.config_maps(keys, props, declared=("spark-env.sh",)).first()
    assert undeclared.error == "SerializeSparkDefaults"
    assert undeclared.spark_defaults is None and undeclared.metrics == ""


def test_rendered_lines_parse_back(spark):
    rows = [(1, "slave", "g", 1, "spark-env.sh", f"K{i}", f"v={i}") for i in range(20)]
    text = render.render_config(overrides(spark, *rows)).first().text
    assert dict(line.split("=", 1) for line in text.splitlines()) == {r[5]: r[6] for r in rows}


def test_fingerprint_follows_content(spark):
    rows = [(1, "slave", "g", 1, D, "a", "1"), (1, "slave", "g", 1, D, "b", "2")]

    def of(*rows):
        return render.fingerprint(overrides(spark, *rows)).first().fingerprint

    assert of(*rows) == of(*rows[::-1])
    assert of(*rows) != of(rows[0], (1, "slave", "g", 1, D, "b", "3"))


def test_rules_can_be_added(spark):
    rules = properties.register_rule("master", D, "spark.master.extra", "upper(cluster)")
    df = groups(spark, MASTER, WORKER).join(cluster(spark), "cluster_id")
    got = {(r.role, r.prop): r.value for r in properties.derive_properties(df, rules).collect()}
    assert got["master", "spark.master.extra"] == "SIMPLE-SPARK"
    assert ("slave", "spark.master.extra") not in got
    with pytest.raises(ValueError):
        properties.register_rule("worker", D, "p", "'v'")


SPEC_DOCUMENT = {
    "metadata": {"name": "spark", "namespace": "default", "uid": "u1"},
    "spec": {
        "version": "3.1.1-x0",
        "config": {"enableMonitoring": True, "maxPortRetries": 3},
        "masters": {"roleGroups": {"default": {"replicas": 1, "selector": {"matchLabels": {"os": "linux"}}}}},
        "workers": {
            "config": {"cores": 1, "memory": "1g"},
            "configOverrides": {D: {"spark.port.maxRetries": "7"}},
            "roleGroups": {
                "big": {"replicas": 3, "config": {"cores": 4}, "envOverrides": {"MY": "v"}},
                "small": {"configOverrides": {D: {"spark.port.maxRetries": "9"}}},
            },
        },
    },
}


def test_specs_from_json_and_yaml(spark, tmp_path, catalog):
    import yaml

    (tmp_path / "json").mkdir()
    lines = [json.dumps(SPEC_DOCUMENT), "not json"]
    (tmp_path / "json" / "a.json").write_text("\n".join(lines))
    rows = specs.read_specs(spark, str(tmp_path / "json"), corrupt=True)
    assert rows.filter("corrupt = 'not json' AND metadata IS NULL").count() == 1
    docs = specs.read_specs(spark, str(tmp_path / "json")).filter("metadata.uid = 'u1'")
    flat = {(r.role, r.role_group): r for r in project.flatten_role_groups(docs).collect()}
    assert set(flat) == {("master", "default"), ("slave", "big"), ("slave", "small")}
    assert (flat["slave", "big"].cores, flat["slave", "big"].role_cores) == (4, 1)

    (tmp_path / "yaml").mkdir()
    (tmp_path / "yaml" / "a.yaml").write_text("---\n" + yaml.safe_dump(SPEC_DOCUMENT) + "---\n")
    parsed = specs.parse_specs(specs.yaml_to_json(spark, str(tmp_path / "yaml")))
    assert parsed.collect() == docs.collect()

    config = effective_config_of_specs(docs, catalog).collect()
    got = {(r.role_group, r.file, r.prop): (r.value, r.layer, r.status) for r in config if r.role == "slave"}
    assert got["big", "spark-env.sh", "SPARK_WORKER_CORES"] == ("4", 3, "ok")
    assert got["big", "spark-env.sh", "SPARK_WORKER_MEMORY"] == ("1g", 1, "ok")
    assert got["small", "spark-env.sh", "SPARK_WORKER_CORES"] == ("1", 1, "ok")
    assert got["big", D, "spark.port.maxRetries"] == ("7", 2, "ok")
    assert got["small", D, "spark.port.maxRetries"] == ("9", 4, "ok")
    assert got["big", "env", "MY"] == ("v", 4, "uncatalogued")


def test_catalog_document_round_trip(spark, tmp_path, catalog):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(catalogs.catalog_document()))
    read = catalogs.read_catalog(spark, [str(tmp_path / "absent.json"), str(path)])
    for table in ("unit", "property", "property_role", "property_value", "property_expansion"):
        mine, theirs = getattr(catalog, table), getattr(read, table)
        assert mine.exceptAll(theirs.select(mine.columns)).count() == 0
        assert theirs.count() == mine.count()
    with pytest.raises(FileNotFoundError):
        catalogs.read_catalog(spark, [str(tmp_path / "absent.json")])


def yaml_of(numbers):
    """Documents of three sizes with marks of every kind."""
    import yaml

    out = []
    for n in numbers:
        spec = {"version": "3.1.1", "text": "a\n---\nb" * (n % 3), "config": {"secret": "x" * (n % 40)}}
        out.append(yaml.safe_dump({"metadata": {"name": f"c{n}", "uid": str(n)}, "spec": spec}))
    marks = ["---\n", "--- # more\n", "---\n# note\n", "...\n---\n"]
    return "".join(marks[n % 4] + text for n, text in zip(numbers, out))


def test_one_yaml_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.yaml").write_text("%YAML 1.1\n" + yaml_of(range(600)))
    sizes = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        lines = specs.yaml_to_json(spark, str(tmp_path / "one"))
        parts = lines.select(F.spark_partition_id().alias("p")).distinct().count()
        uids = [json.loads(r.value)["metadata"]["uid"] for r in lines.collect()]
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert parts > 5 and sorted(map(int, uids)) == list(range(600))


def test_yaml_is_parsed_by_libyaml_with_the_same_results():
    import yaml

    assert yaml.__with_libyaml__ and specs.yaml_loader() is yaml.CSafeLoader
    texts = [yaml_of(range(40)), '{"a": {"b": [1, 2.5, true, null, "é\\n\\u00e9"]}, "c":"1e5"}', "a: 012\nb: 1e5\n", ""]
    for text in texts:
        assert list(yaml.load_all(text, specs.yaml_loader())) == list(yaml.safe_load_all(text))


def test_a_stream_of_yaml_that_is_started_again(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def ran():
        stream = specs.yaml_to_json(spark, str(source), stream=True, maxFilesPerTrigger="1")
        stream.writeStream.format("text").option("path", target).option(
            "checkpointLocation", f"{target}-cp"
        ).trigger(availableNow=True).start().awaitTermination()
        rows = specs.parse_specs(spark.read.text(target)).select("metadata.uid").collect()
        return sorted(int(r.uid) for r in rows)

    for i in range(3):
        (source / f"{i}.yaml").write_text(yaml_of(range(10 * i, 10 * i + 10)))
    assert ran() == list(range(30))
    assert ran() == list(range(30))
    (source / "3.yaml").write_text(yaml_of(range(30, 45)))
    assert ran() == list(range(45))


def test_fills_of_distinct_versions(spark, catalog, monkeypatch):
    """Answers of distinct (role, version) pairs equal the look-up row by row, and one pair
    with nearly all rows is spread."""
    rows = [(i, role, f"g{i}", v) for i, (role, v) in enumerate(
        (role, v) for role in ("master", "slave", "history-server", "other", None)
        for v in ("0.1.0", "0.6.2", "1.4.1", "1.5.0", "3.1.1", "x.y", None)
    )]
    rows += [(i, "slave", f"g{i}", "3.1.1") for i in range(100, 2_000)]
    df = spark.createDataFrame(rows, "cluster_id bigint, role string, role_group string, v string")
    df = df.withColumn("version_rank", version_rank(F.col("v")))
    want = sorted(map(repr, validation.with_fills(df, catalog).drop("version_rank").collect()))
    with monkeypatch.context() as large:
        large.setattr(type(catalog), "is_small", lambda *_: False)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            got = validation.with_fills(df, catalog)
            tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
            got = sorted(map(repr, got.select(*[c for c in df.columns if c != "version_rank"], "fills").collect()))
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == want
    sizes = sorted(r["count"] for r in tasks)
    assert len(sizes) == 1 or sizes[-1] < 2 * sizes[len(sizes) // 2]
