"""Row types of the fleet tables, and the vocabulary every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Role names, file names, separators, ports, property names and texts below must
# be exactly these for a rendered configuration to be right.
ROLES = ["master", "slave", "history-server"]
SPEC_FIELD_OF_ROLE = {
    "master": "masters",
    "slave": "workers",
    "history-server": "historyServers",
}

SPARK_DEFAULTS = "spark-defaults.conf"
SPARK_ENV = "spark-env.sh"
METRICS = "metrics.properties"
ENV = "env"  # stands in the `file` column for environment variables
SEPARATOR_OF_FILE = {SPARK_DEFAULTS: " ", SPARK_ENV: "=", METRICS: "="}
FILES_THAT_MUST_EXIST = [SPARK_DEFAULTS, SPARK_ENV]

HTTP_PORT_OF_ROLE = {"master": 8080, "slave": 8081, "history-server": 18080}
MASTER_RPC_PORT = 7077

RESERVED_PORT_PROPERTIES = [
    "spark.master.port",
    "SPARK_MASTER_PORT",
    "SPARK_MASTER_WEBUI_PORT",
    "SPARK_WORKER_PORT",
    "SPARK_WORKER_WEBUI_PORT",
    "spark.history.ui.port",
]
BUILT_IN_PROPERTIES = [
    ("SPARK_MASTER_PORT", ENV),
    ("*.sink.prometheusServlet.class", METRICS),
    ("*.sink.prometheusServlet.path", METRICS),
    ("*.source.jvm.class", METRICS),
]
METRICS_PATH = "/metrics"
SCRAPE_LABEL = "prometheus.io/scrape"
DNS_SUFFIX = "svc.cluster.local"
APP_NAME = "spark"
GLOBAL_GROUP = "global"  # the role group of objects that belong to a whole cluster
LOG_CLAIM_SIZE = "1Gi"
REPLICAS_MAX = 65535
# Categories users group error reports by.
ERROR_CATEGORIES = {
    "no_version": "ObjectHasNoVersion",
    "bad_version": "invalid_version",
    "no_namespace": "NoNamespace",
    "no_master": "SparkMasterFqdnIsMissing",
    "no_defaults": "SerializeSparkDefaults",
    "no_env": "SerializeSparkEnv",
    "bad_role": "InvalidRole",
    "bad_replicas": "InvalidReplicas",
}
RETRY_DELAY_SECONDS = 5
PROBE_PERIOD_SECONDS = 10
PROBE_INITIAL_DELAY_SECONDS = 10
EXPECTATION_TIMEOUT_SECONDS = 300
# ------------------------------------------------------------------------------

# Layers, low to high; the highest layer that sets a property wins.
LAYER_MISSING = -2  # a required property for which no value is known
LAYER_IMPLIED = -1
LAYER_FILLED = 0
LAYER_ROLE_CONFIG = 1
LAYER_ROLE_OVERRIDE = 2
LAYER_GROUP_CONFIG = 3
LAYER_GROUP_OVERRIDE = 4
OVERRIDE_LAYERS = [LAYER_ROLE_OVERRIDE, LAYER_GROUP_OVERRIDE]

KEY = ["cluster_id", "role", "role_group"]

_STR_MAP = T.MapType(T.StringType(), T.StringType())
_FILE_MAP = T.MapType(T.StringType(), _STR_MAP)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# One config struct for all roles: fields a role does not know stay NULL, and
# Parquet has no column for the empty struct of a master.
ROLE_CONFIG = _struct(cores=T.LongType(), memory=T.StringType(), storePath=T.StringType())
SELECTOR = _struct(
    matchLabels=_STR_MAP,
    matchExpressions=T.ArrayType(
        _struct(
            key=T.StringType(),
            operator=T.StringType(),
            values=T.ArrayType(T.StringType()),
        )
    ),
)
_OVERRIDES = dict(configOverrides=_FILE_MAP, envOverrides=_STR_MAP, cliOverrides=_STR_MAP)
GROUP = _struct(config=ROLE_CONFIG, **_OVERRIDES, replicas=T.IntegerType(), selector=SELECTOR)
ROLE = _struct(
    config=ROLE_CONFIG, **_OVERRIDES, roleGroups=T.MapType(T.StringType(), GROUP)
)
SPEC = _struct(
    metadata=_struct(name=T.StringType(), namespace=T.StringType(), uid=T.StringType()),
    spec=_struct(
        version=T.StringType(),
        stopped=T.BooleanType(),
        config=_struct(
            secret=T.StringType(), logDir=T.StringType(), maxPortRetries=T.LongType()
        ),
        **_OVERRIDES,
        masters=ROLE,
        workers=ROLE,
        historyServers=ROLE,
    ),
    status=_struct(discoveryHash=T.StringType()),
)

WATCH = _struct(
    resource_version=T.LongType(),
    ts=T.TimestampType(),
    owner=T.StringType(),
    kind=T.StringType(),
    change=T.StringType(),
    error_category=T.StringType(),
    value=T.DoubleType(),
)
PRIMARY_KIND = "SparkCluster"
OWNED_KINDS = ["Service", "ConfigMap", "StatefulSet"]
