"""Every operator as a query over the test tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.catalog import Catalog
from muster.functions.checks import fits_datatype, fits_unit
from muster.functions.versions import bump, product_version, version_key
from muster.operators import digests, errors, matrix, patch, project, properties, render, selectors, state, steps, validation
from muster.plans import effective
from muster.plans.bindings import Fleet
from muster.schema import KEY, OWNED_KINDS, SCRAPE_LABEL, SPARK_DEFAULTS, SPARK_ENV, METRICS
from muster.session import work_dir
from muster.sources import catalogs, sinks, snapshot, specs
from muster.streaming import latest, reconcile, timing


@dataclass(frozen=True)
class Parameters:
    """What a query and its SQL must agree on.  Events are minutes apart and cover a
    month, so delays and periods are hours here."""

    namespace: str = "building"
    registry: str = "registry.example.org/spark"
    conf_dir: str = "/etc/spark/conf"
    log_dir: str = "/var/log/spark"
    retry_delay: int = 2 * 3600
    timeout: int = 6 * 3600
    step_timeout: int = 14 * 24 * 3600
    delay: int = 10 * 3600
    period: int = 24 * 3600
    width: int = 3600


P = Parameters()
# (step, kind, status) of the tests of `run_steps`.
STEPS = [
    (1, "Service", "0"),
    (1, "StatefulSet", "1"),
    (2, "ConfigMap", "0"),
    (2, "StatefulSet", "0"),
]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_catalogs: dict[str, Catalog] = {}


def shipped_catalog(spark: SparkSession) -> Catalog:
    """The built-in catalog, made once per application."""
    app = spark.sparkContext.applicationId
    if app not in _catalogs:
        _catalogs.clear()
        _catalogs[app] = Catalog.built_in(spark)
    return _catalogs[app]


def query(f: Callable[[Fleet], DataFrame]) -> Callable[[Fleet], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Fleet(spark, folder))
    return f


def _catalog(fleet: Fleet) -> Catalog:
    return shipped_catalog(fleet.spark)


def _groups(fleet: Fleet) -> DataFrame:
    """Role groups with the columns of their cluster."""
    return fleet.role_groups().join(fleet.clusters(), "cluster_id")


def _versioned_groups(fleet: Fleet) -> DataFrame:
    return fleet.role_groups().join(
        project.with_product_version(fleet.clusters().filter("version IS NOT NULL")), "cluster_id"
    )


def _homeless(df: DataFrame) -> DataFrame:
    """Rows of some clusters without their namespace, as a broken document has them."""
    return df.withColumn("namespace", F.expr("CASE WHEN cluster_id % 17 <> 0 THEN namespace END"))


def _layers(fleet: Fleet) -> DataFrame:
    """Derived properties and overrides, layer by layer."""
    return effective.property_layers(fleet.clusters(), fleet.role_groups(), fleet.overrides())


def _merged(fleet: Fleet, imply: bool = False) -> DataFrame:
    """The winning layer of each property."""
    return effective.merged_layers(
        fleet.clusters(), fleet.role_groups(), fleet.overrides(), _catalog(fleet), imply=imply
    )


def _effective(fleet: Fleet) -> DataFrame:
    return effective.effective_config(
        fleet.clusters(), fleet.role_groups(), fleet.overrides(), _catalog(fleet)
    )


def _effective_rows(fleet: Fleet, *keep: str) -> DataFrame:
    """The effective properties of a role group as an array of its row."""
    return effective.effective_rows(
        fleet.clusters(), fleet.role_groups(), fleet.overrides(), _catalog(fleet), keep=keep
    )


# ------------------------------------------------------------------ whole pipelines


@query
def effective_config(fleet: Fleet) -> DataFrame:
    return _effective(fleet)


@query
def effective_status(fleet: Fleet) -> DataFrame:
    return _effective(fleet).groupBy("layer", "status").agg(F.count("*").alias("n"))


@query
def merge_layers(fleet: Fleet) -> DataFrame:
    return _merged(fleet).drop("version_rank")


@query
def validate(fleet: Fleet) -> DataFrame:
    return effective.validated_layers(
        fleet.clusters(), fleet.role_groups(), fleet.overrides(), _catalog(fleet)
    )


# ------------------------------------------------------------------ sources and sinks


def _write_specs(fleet: Fleet) -> str:
    """Spec documents as JSON lines, one per cluster."""
    path = work_dir(fleet.spark, "specs")
    specs.spec_documents(_groups(fleet)).write.json(path)
    return path


@query
def read_specs(fleet: Fleet) -> DataFrame:
    documents = specs.read_specs(fleet.spark, _write_specs(fleet))
    return project.clusters_of(documents).drop("cluster_id")


@query
def flatten_role_groups(fleet: Fleet) -> DataFrame:
    documents = specs.read_specs(fleet.spark, _write_specs(fleet))
    return project.flatten_role_groups(documents).select(
        "cluster_id", "role", "role_group", "replicas", "cores", "memory", "store_path"
    )


@query
def read_specs_yaml(fleet: Fleet) -> DataFrame:
    """The same documents as YAML, many to a file, read as a stream."""
    lines = specs.spec_documents(_groups(fleet)).select(F.to_json(F.struct("metadata", "spec")))
    source, root = work_dir(fleet.spark, "yaml"), work_dir(fleet.spark, "json")
    lines.write.option("lineSep", specs.YAML_MARK).text(source)
    documents = specs.yaml_to_json(fleet.spark, source, stream=True, maxFilesPerTrigger="2")
    run = documents.writeStream.format("text").option("path", f"{root}/rows").option(
        "checkpointLocation", f"{root}/checkpoint"
    )
    run.trigger(availableNow=True).start().awaitTermination()
    parsed = specs.parse_specs(fleet.spark.read.text(f"{root}/rows"))
    return project.clusters_of(parsed).drop("cluster_id")


@query
def effective_config_of_specs(fleet: Fleet) -> DataFrame:
    def as_maps(overrides: DataFrame, keys: list[str], column: str) -> DataFrame:
        """All overrides of a key as a map of maps, file to property to value."""

        def mapped(key: str, value: str) -> F.Column:
            return F.map_from_entries(F.collect_list(F.struct(key, value)))

        once = overrides.groupBy(*keys, "file", "prop").agg(F.max("value").alias("value"))
        per_file = once.groupBy(*keys, "file").agg(mapped("prop", "value").alias("props"))
        return per_file.groupBy(*keys).agg(mapped("file", "props").alias(column))

    overrides = fleet.overrides()
    of_group = as_maps(overrides.filter("role_group IS NOT NULL"), KEY, "override_map")
    of_role = as_maps(
        overrides.filter("role_group IS NULL"), ["cluster_id", "role"], "role_override_map"
    )
    # The join on the cluster comes last, where its document is made.
    groups = (
        fleet.role_groups()
        .join(of_group, KEY, "left")
        .join(of_role, ["cluster_id", "role"], "left")
        .join(fleet.clusters(), "cluster_id")
    )
    lines = specs.spec_documents(groups).select(F.to_json(F.struct("metadata", "spec")).alias("value"))
    return effective.effective_config_of_specs(specs.parse_specs(lines), _catalog(fleet))


@query
def read_catalog(fleet: Fleet) -> DataFrame:
    spark = fleet.spark
    root = work_dir(spark, "catalog")
    document = [(json.dumps(catalogs.catalog_document()),)]
    spark.createDataFrame(document, "value string").coalesce(1).write.text(f"{root}/second")
    catalog = catalogs.read_catalog(spark, [f"{root}/first", f"{root}/second"])
    used = fleet.overrides().groupBy("prop", "role").agg(F.count("*").alias("n"))
    return (
        catalog.definitions()
        .drop("as_of_rank", "roles", "pattern")
        .join(catalog.property_role, "prop")
        .join(used, ["prop", "role"], "left")
        .withColumn("overrides", F.coalesce("n", F.lit(0)))
        .drop("n")
    )


@query
def write_config(fleet: Fleet) -> DataFrame:
    path = work_dir(fleet.spark, "config")
    sinks.write_config(render.texts_of(_effective_rows(fleet)), path)
    return fleet.spark.read.parquet(path).select(*KEY, "file", "text")


@query
def apply_snapshot(fleet: Fleet) -> DataFrame:
    """Four batches of changes, the second of them delivered twice."""
    target = work_dir(fleet.spark, "snapshot")
    rows = fleet.watch().select("owner", "kind", "resource_version", "change")
    keys, order = ["owner", "kind"], ["resource_version"]
    for batch_id in (0, 1, 1, 2, 3):
        part = rows.filter(F.pmod("resource_version", F.lit(4)) == batch_id)
        snapshot.apply_snapshot(part, target, keys, order, batch_id)
    return snapshot.read_snapshot(fleet.spark, target, keys, order)


def _broken(fleet: Fleet) -> tuple[DataFrame, DataFrame]:
    """Clusters and role groups some of which cannot be built."""
    groups = fleet.role_groups().withColumns(
        {
            "role": F.expr("CASE WHEN cluster_id % 23 = 0 AND role = 'slave' THEN 'worker' ELSE role END"),
            "replicas": F.expr("CASE WHEN cluster_id % 19 = 0 THEN replicas + 65534 ELSE replicas END"),
        }
    )
    return _homeless(fleet.clusters()), groups


@query
def report_errors(fleet: Fleet) -> DataFrame:
    """Failed changes and the errors of every operator in one report."""
    target = work_dir(fleet.spark, "report")
    changed = fleet.watch().groupBy(F.col("owner").alias("cluster")).agg(F.max("ts").alias("ts"))
    clusters, groups = _broken(fleet)
    # A catalog of roles without the defaults file, as some clusters have it.
    rows = _effective_rows(fleet, "cluster").filter("cluster_id % 29 = 0")
    texts = render.config_map_columns(rows, declared=(SPARK_ENV,))
    found = state.union_kinds(errors.errors_of(clusters, groups), errors.config_errors(texts))
    timed = found.join(changed, "cluster", "left").withColumn("time", F.col("ts"))
    sinks.report(sinks.report_of_watch(fleet.watch()), target)
    sinks.report(timed, target)
    return fleet.spark.read.parquet(target).select(
        "object", "category", "message", F.unix_micros("time").alias("time_us")
    )


# ------------------------------------------------------------------ projections


@query
def in_namespace(fleet: Fleet) -> DataFrame:
    return project.in_namespace(fleet.clusters(), P.namespace).select(
        "cluster_id", "cluster", "version"
    )


@query
def check_role(fleet: Fleet) -> DataFrame:
    flag = F.col("l_returnflag")
    role = (
        F.when((F.col("l_linestatus") == "O") & (flag == "N"), "worker")
        .when(flag == "A", "master")
        .when(flag == "N", "slave")
        .otherwise("history-server")
    )
    rows = fleet.table("lineitem").select(
        F.col("l_orderkey").alias("cluster_id"),
        F.col("l_linenumber").alias("number"),
        role.alias("role"),
    )
    counted = rows.groupBy("cluster_id", "number", "role").agg(F.count("*").alias("n"))
    return project.check_role(counted)


@query
def product_version_of(fleet: Fleet) -> DataFrame:
    return project.with_product_version(fleet.clusters()).select(
        "cluster_id", "version", "product", "version_error"
    )


QUERIES["product_version"] = QUERIES.pop("product_version_of")


@query
def effective_replicas(fleet: Fleet) -> DataFrame:
    return _groups(fleet).select(*KEY, project.effective_replicas().alias("replicas"))


@query
def object_names(fleet: Fleet) -> DataFrame:
    return project.object_names(_groups(fleet)).select(
        *KEY, "object_name", "service_fqdn", "global_service", "global_fqdn"
    )


@query
def expand_pods(fleet: Fleet) -> DataFrame:
    masters = _homeless(_groups(fleet)).filter("role = 'master'")
    return project.expand_pods(masters).select(
        "cluster_id", "role_group", "ordinal", "pod", "pod_fqdn", "error"
    )


@query
def endpoints(fleet: Fleet) -> DataFrame:
    return project.endpoints(fleet.role_groups().select(*KEY))


@query
def start_command(fleet: Fleet) -> DataFrame:
    return project.start_command(_homeless(_groups(fleet))).select(*KEY, "command", "error")


@query
def image_ref(fleet: Fleet) -> DataFrame:
    versioned = fleet.clusters().filter("version IS NOT NULL")
    return project.image_ref(versioned, P.registry).select("cluster_id", "image")


@query
def scrape_targets(fleet: Fleet) -> DataFrame:
    """Services of role groups carry the label; those of the whole cluster do not."""
    groups = _groups(fleet)
    labelled = groups.withColumn("labels", F.create_map(F.lit(SCRAPE_LABEL), F.lit("true")))
    plain = groups.filter("role = 'master'").withColumn(
        "labels", F.create_map().cast("map<string,string>")
    )
    services = labelled.unionByName(plain)
    return project.scrape_targets(services).select(*KEY, "target", "path")


@query
def derive_properties(fleet: Fleet) -> DataFrame:
    return properties.derive_properties(_versioned_groups(fleet))


@query
def register_rule(fleet: Fleet) -> DataFrame:
    rules = properties.register_rule(
        "slave",
        "spark-env.sh",
        "SPARK_WORKER_INSTANCES",
        "CASE WHEN replicas > 0 THEN CAST(replicas AS STRING) END",
    )
    return properties.derive_properties(_versioned_groups(fleet), rules)


@query
def desired_objects(fleet: Fleet) -> DataFrame:
    rows = _effective_rows(fleet, "cluster", "namespace", "version", "stopped")
    return state.union_kinds(
        state.global_services(fleet.clusters()),
        state.role_group_objects(
            render.config_map_columns(rows), P.registry, P.conf_dir, P.log_dir
        ),
    )


@query
def label_columns(fleet: Fleet) -> DataFrame:
    of_groups = project.label_columns(_groups(fleet).filter("version IS NOT NULL"))
    of_clusters = project.global_label_columns(fleet.clusters().filter("version IS NOT NULL"))
    labelled = state.union_kinds(*[df.select(*KEY, "labels", "selector_labels") for df in (of_groups, of_clusters)])
    labels, selector = F.col("labels"), F.col("selector_labels")
    return labelled.select(
        *KEY,
        labels["name"].alias("label_name"),
        labels["instance"].alias("label_instance"),
        labels["version"].alias("label_version"),
        labels["component"].alias("label_component"),
        labels["role-group"].alias("label_role_group"),
        selector["name"].alias("selector_name"),
        selector["instance"].alias("selector_instance"),
        selector["component"].alias("selector_component"),
        selector["role-group"].alias("selector_role_group"),
        F.size("selector_labels").alias("selector_size"),
    )


# ------------------------------------------------------------------ catalog


@query
def match_catalog(fleet: Fleet) -> DataFrame:
    return validation.match_catalog(_layers(fleet), _catalog(fleet)).select(
        *KEY, "file", "prop", "value", "datatype", "unit", "known", "wrong_role"
    )


@query
def values_for_version(fleet: Fleet) -> DataFrame:
    return validation.values_for_version(_layers(fleet), _catalog(fleet)).select(
        *KEY, "layer", "prop", "value_kind", "range_value", "available"
    )


@query
def missing_required(fleet: Fleet) -> DataFrame:
    return effective.absent_required(
        fleet.clusters(), fleet.role_groups(), fleet.overrides(), _catalog(fleet)
    )


@query
def expand_implied(fleet: Fleet) -> DataFrame:
    return _merged(fleet, imply=True).drop("version_rank")


@query
def check_datatype(fleet: Fleet) -> DataFrame:
    matched = validation.match_catalog(_layers(fleet), _catalog(fleet)).filter("known")
    fits = fits_datatype(F.col("value"), F.col("datatype"))
    return matched.select(*KEY, "file", "prop", "value", fits.alias("fits"))


@query
def check_unit(fleet: Fleet) -> DataFrame:
    catalog = _catalog(fleet)
    matched = validation.match_catalog(_layers(fleet), catalog).filter("unit IS NOT NULL")
    fits = fits_unit(F.col("value"), F.col("unit"), catalog.units, F.col("pattern"))
    return matched.select(*KEY, "file", "prop", "value", "unit", fits.alias("fits"))


# ------------------------------------------------------------------ state


@query
def select_by_labels(fleet: Fleet) -> DataFrame:
    groups = fleet.role_groups()
    sized = F.when(F.col("cores").isNotNull(), F.create_map(F.lit("sized"), F.lit("yes"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    labels = F.map_concat(
        F.create_map(F.lit("role"), F.col("role"), F.lit("group"), F.col("role_group")), sized
    )
    chosen = selectors.selectors_from_rows(*fleet.selectors())
    return selectors.select_by_labels(groups.select(*KEY, labels.alias("labels")), chosen, KEY)


def _desired_replicas(fleet: Fleet) -> DataFrame:
    return _groups(fleet).select(*KEY, project.effective_replicas().alias("desired_replicas"))


@query
def diff_state(fleet: Fleet) -> DataFrame:
    return state.diff_state(_desired_replicas(fleet), fleet.observed())


def _changed(fields: F.Column, path: str, when: str, value: str | None) -> F.Column:
    """``fields`` with another value at ``path`` where ``when`` holds."""
    rest = F.map_filter(fields, lambda p, _: p != path)
    own = F.create_map(F.lit(path), F.lit(value).cast("string"))
    return F.when(F.expr(when), F.map_concat(rest, own)).otherwise(fields)


def _sides(fleet: Fleet, desired: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is wanted of the role groups, what was applied of it when some properties were
    others, and what is there, where others have set fields too.

    All three are made of ``desired`` where its rows are: they stay dealt by K.
    """
    retries, old = f"{SPARK_DEFAULTS}/spark.port.maxRetries", f"{SPARK_DEFAULTS}/spark.old"
    fields = _changed(F.col("fields"), retries, "cluster_id % 5 = 0", "99")
    fields = _changed(fields, old, "cluster_id % 7 = 0", "x")
    before = desired.select(*KEY, fields.alias("fields"))
    served = f"{METRICS}/*.sink.prometheusServlet.path"
    there = _changed(F.col("fields"), served, "cluster_id % 11 = 0", "/other")
    there = F.map_filter(there, lambda p, _: p != "replicas")
    there = F.coalesce(there, F.create_map().cast(patch.FIELDS))
    there = _changed(there, "annotations/team", "cluster_id % 4 = 0", "blue")
    count = F.create_map(F.lit("replicas"), F.col("observed_replicas").cast("string"))
    observed = fleet.observed().join(before, KEY, "left").select(
        *KEY, F.map_concat(there, count).alias("fields")
    )
    # A column first: a filter would move below the shuffles that all sides share, which
    # would then be others for this one.
    applied = effective.settled_in_row(before, F.expr("cluster_id % 3 <> 0"), "was_applied")
    return desired, applied.filter("was_applied").select(before.columns), observed


@query
def patch_objects(fleet: Fleet) -> DataFrame:
    """The sides are merged from the same shuffles three times, rather than written once and
    shuffled with all their fields."""
    desired = reconcile.desired_state(
        fleet.clusters(), fleet.role_groups(), fleet.overrides(), _catalog(fleet)
    )
    merged = patch.three_way(*_sides(fleet, desired))
    return merged.select(*KEY, "action", F.explode_outer("patch").alias("p")).select(
        *KEY, "action", "p.path", "p.op", "p.value", "p.conflict"
    )


@query
def owner_of(fleet: Fleet) -> DataFrame:
    children = fleet.watch().filter(F.col("kind").isin(OWNED_KINDS))
    owners = fleet.clusters().select("cluster", "cluster_id", "namespace")
    return state.owner_of(children, owners).select(
        "resource_version", "kind", "owner", "cluster_id", "namespace"
    )


@query
def check_expectations(fleet: Fleet) -> DataFrame:
    expected = fleet.role_groups().select(
        *KEY, "replicas", F.col("replicas").alias("ready_replicas")
    )
    seen = fleet.observed().withColumnRenamed("observed_replicas", "replicas")
    return state.check_expectations(expected, seen, KEY, ["replicas", "ready_replicas"]).select(
        *KEY, "result"
    )


@query
def readiness(fleet: Fleet) -> DataFrame:
    n = F.col("observed_replicas")
    ordinals = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    pods = (
        fleet.observed()
        .select(*KEY, "ready_replicas", F.explode_outer(ordinals).alias("ordinal"))
        .withColumn("ready", F.col("ordinal") < F.col("ready_replicas"))
    )
    return state.readiness(pods)


@query
def error_counts(fleet: Fleet) -> DataFrame:
    return state.error_counts(sinks.report_of_watch(fleet.watch()))


@query
def latest_per_key(fleet: Fleet) -> DataFrame:
    return state.latest_per_key(fleet.watch(), ["owner"], ["resource_version"]).select(
        "owner", "resource_version", "kind", "change", "value"
    )


@query
def union_kinds(fleet: Fleet) -> DataFrame:
    named = project.object_names(_groups(fleet).filter("version IS NOT NULL"))
    of_group = named.select("cluster_id", F.col("object_name").alias("name"))
    sets = named.select(
        "cluster_id",
        F.col("object_name").alias("name"),
        project.effective_replicas().alias("replicas"),
    )
    everyone = fleet.clusters().filter("version IS NOT NULL")
    return state.union_kinds(
        sets.withColumn("kind", F.lit("StatefulSet")),
        of_group.withColumn("kind", F.explode(F.array(F.lit("Service"), F.lit("ConfigMap")))),
        everyone.select(
            "cluster_id",
            F.concat("cluster", F.lit("-master")).alias("name"),
            F.lit("Service").alias("kind"),
        ),
    ).select("kind", "name", "cluster_id", "replicas")


# ------------------------------------------------------------------ texts


@query
def render_config(fleet: Fleet) -> DataFrame:
    return render.texts_of(_effective_rows(fleet))


@query
def config_maps(fleet: Fleet) -> DataFrame:
    return render.config_map_columns(_effective_rows(fleet)).select(
        *KEY, *render.COLUMN_OF_FILE.values(), "error"
    )


@query
def fingerprint(fleet: Fleet) -> DataFrame:
    return _effective_rows(fleet).select(*KEY, render.digest_of(F.col("props")).alias("fingerprint"))


@query
def cluster_digests(fleet: Fleet) -> DataFrame:
    return digests.discovery_digests(_effective(fleet))


@query
def diff_trees(fleet: Fleet) -> DataFrame:
    """Two fleets, one of which has had other values and another property in some clusters."""
    root = work_dir(fleet.spark, "trees")
    digests.write_tree(_effective(fleet), f"{root}/now")
    # The other fleet is made of the properties as they were written, worked out once.
    now = digests.properties_of(fleet.spark, f"{root}/now")
    retries = (F.col("prop") == "spark.port.maxRetries") & (F.col("cluster_id") % 5 == 0)
    before = now.withColumn("value", F.when(retries, "99").otherwise(F.col("value")))
    old = before.filter((F.col("prop") == "spark.port.maxRetries") & (F.col("cluster_id") % 7 == 0))
    before = before.unionByName(old.withColumns({"prop": F.lit("spark.old"), "value": F.lit("x")}))
    digests.write_tree(before, f"{root}/before")
    return digests.diff_trees(fleet.spark, f"{root}/before", f"{root}/now")


@query
def stable_order(fleet: Fleet) -> DataFrame:
    return render.positions_of(
        effective.merged_rows(
            fleet.clusters(), fleet.role_groups(), fleet.overrides(), _catalog(fleet)
        )
    )


@query
def split_tokens(fleet: Fleet) -> DataFrame:
    words = F.split("memory", " ")
    return (
        fleet.role_groups()
        .filter("memory IS NOT NULL")
        .select(
            *KEY,
            words[0].alias("first_token"),
            F.size(words).alias("tokens"),
            F.upper("memory").alias("upper_memory"),
        )
    )


# ------------------------------------------------------------------ matrix and packages


@query
def scenario_grid(fleet: Fleet) -> DataFrame:
    def dimension(name: str, values: DataFrame) -> DataFrame:
        return values.distinct().toDF("value").withColumn("dim", F.lit(name))

    dimensions = state.union_kinds(
        dimension("event", fleet.table("events").select("event_type")),
        dimension("status", fleet.table("orders").select("o_orderstatus")),
        dimension("segment", fleet.table("customer").select(F.lower("c_mktsegment"))),
    )
    even = F.array(F.lit("event"), F.lit("status"))
    odd = F.array(F.lit("segment"), F.lit("event"), F.lit("status"))
    tests = fleet.table("nation").select(
        F.col("n_name").alias("test"),
        F.when(F.col("n_regionkey") % 2 == 0, even).otherwise(odd).alias("dims"),
    )
    return matrix.scenario_grid(dimensions, tests)


@query
def version_key_of(fleet: Fleet) -> DataFrame:
    key = version_key(product_version(F.col("version")))
    return fleet.packages().select(
        "package_id",
        key[0].cast("int").alias("major"),
        key[1].cast("int").alias("minor"),
        key[2].cast("int").alias("patch"),
        (key >= F.array(F.lit(2), F.lit(9), F.lit(0)).cast("array<decimal(38,0)>")).alias(
            "at_least_2_9"
        ),
    )


QUERIES["version_key"] = QUERIES.pop("version_key_of")


@query
def bump_version(fleet: Fleet) -> DataFrame:
    v = F.col("version")
    return matrix.set_version(fleet.packages(), "7.0.0").select(
        "package_id",
        "version",
        bump(v, "next_major").alias("next_major"),
        bump(v, "next_minor").alias("next_minor"),
        bump(v, "next_patch").alias("next_patch"),
        bump(v, "finalize").alias("finalized"),
        bump(v, "prerelease", "rc1").alias("tagged"),
        bump(v, "following").alias("following"),
        F.col("new_version").alias("fixed"),
    )


@query
def propagate_versions(fleet: Fleet) -> DataFrame:
    bumped = matrix.bump_version(fleet.packages(), "next_minor")
    return matrix.propagate_versions(bumped, fleet.dependencies())


# ------------------------------------------------------------------ time rules, batch


@query
def retry_due(fleet: Fleet) -> DataFrame:
    return timing.retry_due(fleet.watch(), P.retry_delay)


@query
def eventually(fleet: Fleet) -> DataFrame:
    watch = fleet.watch()
    steps, met = watch.filter("change = 'ADDED'"), watch.filter("kind = 'StatefulSet'")
    return timing.eventually(steps, met, P.timeout)


@query
def liveness(fleet: Fleet) -> DataFrame:
    return timing.liveness(fleet.watch(), P.delay, P.period)


@query
def run_steps(fleet: Fleet) -> DataFrame:
    """Tests that start with the first change of their cluster: at first its service and
    its replica set, then its configuration and its replica set must have a status at once."""
    changes = fleet.watch().select(
        "owner",
        F.concat_ws("/", "owner", "kind").alias("object"),
        "kind",
        F.unix_micros("ts").alias("us"),
        F.col("resource_version").alias("version"),
        (F.col("resource_version") % 2).cast("string").alias("status"),
    )
    tests = changes.groupBy(F.col("owner").alias("test")).agg(F.min("us").alias("start_us"))
    wanted = F.array(
        *[
            F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.lit(status).alias("expected"))
            for step, kind, status in STEPS
        ]
    )
    expectations = tests.select("test", F.inline(wanted)).withColumn(
        "object", F.concat_ws("/", "test", "kind")
    )
    return steps.run_steps(
        tests, expectations.drop("kind"), changes.drop("owner", "kind"), P.step_timeout
    )


def _rates(rate: DataFrame) -> DataFrame:
    return rate.select("category", F.unix_seconds("window_start").alias("window_s"), "n")


@query
def error_rate_batch(fleet: Fleet) -> DataFrame:
    return _rates(latest.error_rate(fleet.watch(), f"{P.width} seconds"))


# ------------------------------------------------------------------ streams


def _watch_stream(fleet: Fleet) -> DataFrame:
    return fleet.watch_stream()


def _append(fleet: Fleet, df: DataFrame, name: str) -> DataFrame:
    """What an append stream has written when it has seen everything there is."""
    root = work_dir(fleet.spark, name)
    run = (
        df.writeStream.format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return fleet.spark.read.schema(df.schema).parquet(f"{root}/rows")


def _upsert(
    fleet: Fleet, df: DataFrame, name: str, keys: list[str], order: list[str]
) -> DataFrame:
    """The snapshot an update stream has left when it has seen everything there is."""
    root = work_dir(fleet.spark, name)
    latest.upsert_stream(
        df, f"{root}/rows", f"{root}/checkpoint", keys, order
    ).awaitTermination()
    return snapshot.read_snapshot(fleet.spark, f"{root}/rows", keys, order)


@query
def watch_stream(fleet: Fleet) -> DataFrame:
    once = latest.dedupe_stream(_watch_stream(fleet))
    seen = _append(fleet, once, "watch")
    return seen.groupBy("kind", "change").agg(
        F.count("*").alias("n"), F.count_distinct("owner").alias("owners")
    )


@query
def latest_stream(fleet: Fleet) -> DataFrame:
    stream = latest.latest_stream(_watch_stream(fleet))
    return _upsert(fleet, stream, "latest", ["owner"], ["resource_version"]).select(
        "owner", "resource_version", "kind", "change"
    )


@query
def dedupe_stream(fleet: Fleet) -> DataFrame:
    """Every change delivered twice."""
    once = _watch_stream(fleet)
    twice = state.union_kinds(once, once)
    return _append(fleet, latest.dedupe_stream(twice), "dedupe").select(
        "resource_version", "owner", "kind", "change"
    )


@query
def error_rate(fleet: Fleet) -> DataFrame:
    stream = latest.error_rate(_watch_stream(fleet), f"{P.width} seconds")
    return _rates(_upsert(fleet, stream, "rate", ["category", "window_start"], ["n"]))


def _emitted(fleet: Fleet, name: str, start: Callable, *args, schema: str) -> DataFrame:
    """What a rule about time has emitted when it has seen everything there is."""
    root = work_dir(fleet.spark, name)
    start(*args, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return fleet.spark.read.schema(schema).parquet(f"{root}/rows")


@query
def liveness_stream(fleet: Fleet) -> DataFrame:
    def start(*args) -> StreamingQuery:
        return timing.liveness_stream(*args, P.delay, P.period)

    return _emitted(fleet, "liveness", start, _watch_stream(fleet), schema=timing.TICKS)


def _reconcile(fleet: Fleet) -> str:
    """Objects take the patches they are given, so what the stream has left is observed."""
    root = work_dir(fleet.spark, "reconcile")
    # The tables of the fleet as they are kept, of the clusters that change.
    owners = fleet.watch().select(F.col("owner").alias("cluster")).distinct()
    changing = fleet.clusters().join(owners, "cluster", "left_semi")

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{root}/fleet/{name}")
        return fleet.spark.read.schema(df.schema).parquet(f"{root}/fleet/{name}")

    clusters = keep("clusters", changing)
    some = fleet.of_clusters(clusters)
    kept = [clusters, keep("role_groups", some.role_groups()), keep("overrides", some.overrides())]
    path = work_dir(fleet.spark, "desired")
    reconcile.desired_state(*kept, _catalog(fleet)).write.parquet(path)
    _, before, there_first = _sides(some, fleet.spark.read.parquet(path))
    # Every batch reads it anew.
    observed = keep("observed", there_first)
    order = ["reconciled_in"]
    row = "cluster_id bigint, role string, role_group string, after map<string,string>, reconciled_in bigint"

    def there() -> DataFrame:
        done = snapshot.read_snapshot(fleet.spark, f"{root}/rows", KEY, order, row)
        done = done.select(*KEY, F.col("after").alias("fields"), *order)
        first = observed.withColumn(*order, F.lit(-1).cast("bigint"))
        return state.latest_per_key(state.union_kinds(done, first), KEY, order).drop(*order)

    reconcile.reconcile_stream(
        _watch_stream(fleet),
        lambda: tuple(kept),
        there,
        _catalog(fleet),
        f"{root}/rows",
        f"{root}/checkpoint",
        f"{root}/errors",
        applied=lambda: before,
    ).awaitTermination()
    return root


@query
def reconcile_stream(fleet: Fleet) -> DataFrame:
    """Of each role group what was done to it first; later changes found it as it should be."""
    rows = f"{_reconcile(fleet)}/rows"
    steps = F.transform(
        "patch", lambda p: F.concat(p["path"], F.lit(" "), p["op"], F.lit(" "), F.coalesce(p["value"], F.lit("")))
    )
    return snapshot.read_snapshot(fleet.spark, rows, KEY, ["reconciled_in"]).select(
        *KEY, "desired_replicas", "fingerprint", "action", F.array_join(steps, "\n").alias("steps")
    )


@query
def reconcile_errors(fleet: Fleet) -> DataFrame:
    """The last report of each cluster that could not be reconciled."""
    errors = fleet.spark.read.parquet(f"{_reconcile(fleet)}/errors")
    return errors.groupBy("object", "category", "message").agg(
        F.unix_micros(F.max("time")).alias("time_us")
    )


@query
def retry_due_stream(fleet: Fleet) -> DataFrame:
    def start(*args) -> StreamingQuery:
        return timing.retry_due_stream(*args, P.retry_delay)

    return _emitted(fleet, "retry", start, _watch_stream(fleet), schema=timing.DUE)


@query
def eventually_stream(fleet: Fleet) -> DataFrame:
    def start(*args) -> StreamingQuery:
        return timing.eventually_stream(*args, P.timeout)

    step, met = F.col("change") == "ADDED", F.col("kind") == "StatefulSet"
    return _emitted(fleet, "eventually", start, _watch_stream(fleet), step, met, schema=timing.WAITED)


@query
def stop_stream(fleet: Fleet) -> DataFrame:
    """A stream that would wait for more, stopped once it has seen what there is."""
    root = work_dir(fleet.spark, "stop")
    run = (
        latest.dedupe_stream(_watch_stream(fleet))
        .writeStream.format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .start()
    )
    latest.stop_stream(run)
    return fleet.spark.read.parquet(f"{root}/rows").groupBy("kind").agg(F.count("*").alias("n"))
