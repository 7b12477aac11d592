"""The shared merge within the row: what it does, and what it must not cost."""

import pytest
from pyspark.sql import functions as F

from muster.functions import packing
from muster.operators import properties, validation
from muster.plans import effective
from muster.plans.bindings import Fleet, by_kind
from muster.plans.queries import QUERIES
from muster.schema import SPARK_DEFAULTS
from muster.sources import specs
from test_config import OVERRIDE

FOLDER = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Joins as they are of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def fleet_of(spark):
    rows = spark.range(60).selectExpr(
        "id % 20 AS cluster_id",
        "CASE id % 4 WHEN 0 THEN 'master' WHEN 1 THEN 'slave' WHEN 2 THEN 'history-server' ELSE 'other' END AS role",
        "concat('g', id) AS role_group", "1 AS replicas",
        "CASE WHEN id % 3 = 0 THEN id END AS cores", "CASE WHEN id % 5 <> 0 THEN '1g' END AS memory",
        "CASE WHEN id % 2 = 0 THEN '/a/b' END AS store_path",
    )
    clusters = spark.range(20).selectExpr(
        "id AS cluster_id", "concat('c-', id) AS cluster", "'n' AS namespace",
        "CASE id % 3 WHEN 0 THEN '3.1.1' WHEN 1 THEN '0.9.0' ELSE 'x' END AS version",
        "false AS stopped", "CASE WHEN id % 2 = 0 THEN 'secret' END AS secret", "1L AS max_port_retries",
    )
    entries = [
        (c, role, None if c % 2 else f"g{i}", 2 if c % 2 else 4, SPARK_DEFAULTS, prop, value)
        for i in range(60)
        for c in [i % 20]
        for role in ["master slave history-server other".split()[i % 4]]
        for prop, value in (("spark.authenticate", None), ("spark.eventLog.dir", f"/l/{c}"), ("spark.x", "1"))
    ]
    return clusters, rows, spark.createDataFrame(sorted(set(entries), key=repr), OVERRIDE)


def bag(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_merging_in_the_row_equals_merging_by_groups(spark, catalog):
    tables = fleet_of(spark)
    layers = effective.property_layers(*tables)
    merged = effective.merged_layers(*tables, catalog)
    assert bag(merged.drop("version_rank")) == bag(properties.merge_layers(layers))
    implied = effective.merged_layers(*tables, catalog, imply=True)
    expanded = validation.expand_implied(layers, catalog)
    assert bag(implied.drop("version_rank")) == bag(properties.merge_layers(expanded))
    assert implied.filter("layer = -1").count() > 0
    # An override without a value hides nothing.
    assert merged.filter("prop = 'spark.authenticate' AND layer = 1").count() > 0


def test_implied_by_a_large_catalog(spark, catalog, monkeypatch):
    tables = fleet_of(spark)
    want = bag(effective.merged_layers(*tables, catalog, imply=True))
    monkeypatch.setattr(type(catalog), "is_small", lambda *_: False)
    assert bag(effective.merged_layers(*tables, catalog, imply=True)) == want


@pytest.mark.parametrize("name", ["merge_layers", "expand_implied"])
def test_layers_are_not_sorted_after_they_multiply(spark, shuffled, name):
    """Rows of a task are not sorted one by one again, in the memory of the task."""
    assert "SortAggregate" not in planned(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["effective_config", "validate", "render_config", "stable_order"])
def test_the_merge_is_compiled(spark, name):
    """No comparator of an array is interpreted, and no layers are sorted twice."""
    plan = planned(QUERIES[name](spark, FOLDER))
    assert "array_sort(" not in plan
    assert plan.count("sort_array(") == 1


def test_role_groups_meet_clusters_and_their_overrides_at_once(spark, shuffled):
    fleet = Fleet(spark, FOLDER)
    groups = effective.group_rows(fleet.clusters(), fleet.role_groups(), fleet.overrides())
    # Of role groups: of line items, to their cluster, and to the overrides of the group.
    below = sum(planned(df).count("Exchange hashpartitioning") for df in (fleet.role_groups(), fleet.clusters()))
    of_overrides = 3  # of groups; distinct roles; roles of a cluster
    assert planned(groups).count("Exchange hashpartitioning") == below + of_overrides + 3
    assert planned(groups).count("FileScan") == 5


def test_documents_are_made_and_parsed_once(spark, shuffled):
    fleet = Fleet(spark, FOLDER)
    joined = fleet.role_groups().join(fleet.clusters(), "cluster_id")
    before = planned(joined).count("Exchange")
    documents = specs.spec_documents(joined)
    assert planned(documents).count("Exchange") == before
    lines = documents.select(F.to_json(F.struct("metadata", "spec")).alias("value"))
    parsed = specs.parse_specs(lines).filter("spec.version IS NOT NULL")
    assert planned(parsed).count("from_json(") == 1


def test_documents_of_clusters_without_some_roles(spark):
    clusters, rows, _ = fleet_of(spark)
    joined = rows.filter("role <> 'slave'").join(clusters, "cluster_id")
    documents = specs.spec_documents(joined).select("spec.*", "metadata.name").collect()
    want = {}
    for r in joined.collect():
        want.setdefault(r.cluster, {}).setdefault(r.role, set()).add(r.role_group)
    assert {r.name for r in documents} == set(want)
    for r in documents:
        assert r.workers is None
        for role, field in (("master", r.masters), ("history-server", r.historyServers)):
            assert (set(field.roleGroups) if field else None) == want[r.name].get(role)


def test_objects_of_few_selectors_are_not_shuffled(spark, shuffled, monkeypatch):
    """Only counts of labels are; by a shuffle, as of many selectors, the rows are the same."""
    from muster import session

    few = QUERIES["select_by_labels"](spark, FOLDER)
    assert "salt" not in planned(few)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    many = QUERIES["select_by_labels"](spark, FOLDER)
    assert "salt" in planned(many)
    assert bag(few) == bag(many)


def test_a_batch_of_changes_is_written_by_several_tasks(spark, tmp_path):
    changes = by_kind(Fleet(spark, FOLDER).watch())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = changes.select("kind", F.spark_partition_id().alias("p")).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len({r.kind for r in placed}) == len(placed) and len({r.p for r in placed}) > 1
    changes.write.partitionBy("kind").parquet(str(tmp_path / "batch"))
    for kind in (tmp_path / "batch").glob("kind=*"):
        assert len(list(kind.glob("*.parquet"))) == 1


ODD = "cluster_id bigint, a string, b int, c boolean, d double, e string, f bigint"


def test_columns_as_one_text(spark):
    """Any text comes back, NULLs and empty ones too; of other kinds columns stay."""
    texts = ["", None, "\\", "\\0", "\\s", "\\e", "\x01", "a\x01b\\s\x01\\", "\\\x01", "é\n", " ", "\\\\e0"]
    rows = [
        (i, a, None if i % 3 else i - 9, [None, True, False][i % 3], i / 3, e, [None, -(1 << 63)][i % 2])
        for i, (a, e) in enumerate((a, e) for a in texts for e in texts)
    ]
    df = spark.createDataFrame(rows, ODD)
    narrow, fields = packing.packed(df, list("abcdef"), "text")
    assert narrow.columns == ["cluster_id", "d", "text"] and [f.name for f in fields] == list("abcef")
    back = packing.unpacked(narrow.repartition(3), fields, "text").select(df.columns)
    assert back.dtypes == df.dtypes and bag(back) == bag(df)


def _widths(plan):
    """How many columns each shuffle has."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _widths(plan.initialPlan())
    below = [w for i in range(plan.children().size()) for w in _widths(plan.children().apply(i))]
    return below + [plan.output().size()] * (plan.nodeName() == "Exchange")


def test_few_columns_are_shuffled(spark, shuffled):
    df = QUERIES["desired_objects"](spark, FOLDER)
    assert max(_widths(df._jdf.queryExecution().executedPlan())) <= 6


def test_groups_keep_odd_texts(spark):
    clusters, rows, overrides = fleet_of(spark)
    odd = rows.withColumns({"memory": F.lit("\\0\x01\\"), "store_path": F.lit("")})
    clusters = clusters.withColumn("secret", F.lit("\x01\\s"))
    groups = effective.group_rows(clusters, odd, overrides, ["cluster", "stopped"])
    assert groups.columns == [
        *odd.columns, "secret", "max_port_retries", "version_rank", "cluster", "stopped", "overrides"
    ]
    assert dict(groups.dtypes).items() >= dict(odd.dtypes).items()
    got = groups.select("memory", "store_path", "secret").distinct().collect()
    assert [tuple(r) for r in got] == [("\\0\x01\\", "", "\x01\\s")]
    assert bag(groups.select(odd.columns)) == bag(odd)
