"""The same queries as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import re

from muster import catalog
from muster.plans.bindings import SELECTOR_EXPRESSIONS, SELECTORS


def _values(rows: list[tuple], columns: str) -> str:
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def _rank(version: str) -> str:
    """Comparable number of a dotted version, within one query."""
    parts = [
        f"coalesce(nullif(split_part({version}, '.', {i}), ''), '0')::BIGINT" for i in (1, 2, 3)
    ]
    return f"({parts[0]} * 1000000 + {parts[1]} * 1000 + {parts[2]})"


_ROLE = (
    "CASE l_returnflag WHEN 'A' THEN 'master' WHEN 'N' THEN 'slave' ELSE 'history-server' END"
)

# Views in the order of their dependencies.
VIEWS: dict[str, str] = {
    "v_cluster": """
SELECT CAST(o_orderkey AS BIGINT) AS cluster_id,
       concat('c-', CAST(o_orderkey AS STRING)) AS cluster,
       lower(c_mktsegment) AS namespace,
       CASE o_orderkey % 6 WHEN 0 THEN '3.0.1-rel0' WHEN 1 THEN '3.1.1-rel0'
            WHEN 2 THEN '1.4.1-rel0' WHEN 3 THEN '0.9.0' WHEN 4 THEN '3.1.1'
            ELSE NULL END AS version,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE NULL END AS stopped,
       CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'secret' WHEN 2 THEN 'shrt'
            ELSE concat('Secret_', CAST(o_custkey AS STRING)) END AS secret,
       CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 20 END AS max_port_retries
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_role_group": f"""
SELECT l_orderkey AS cluster_id, {_ROLE} AS role,
       concat('g', CAST(l_linenumber AS STRING)) AS role_group,
       CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 11 = 0 THEN NULL
            ELSE CAST(CAST(sum(l_quantity) AS BIGINT) % 5 AS INT) END AS replicas,
       CASE WHEN l_returnflag = 'N' AND min(l_suppkey) % 3 <> 0
            THEN min(l_suppkey) % 16 + 1 END AS cores,
       CASE WHEN l_returnflag = 'N' THEN concat(CAST(CAST(sum(l_quantity) AS BIGINT) AS STRING),
            CASE min(l_suppkey) % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'm' WHEN 2 THEN 'G'
                 ELSE ' kb' END) END AS memory,
       CASE WHEN l_returnflag = 'R' AND min(l_suppkey) % 2 = 0
            THEN concat('/data/history',
                        CASE min(l_suppkey) % 3 WHEN 0 THEN '/' ELSE '/a' END) END AS store_path
FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linenumber""",
    "v_override": f"""
SELECT DISTINCT l_orderkey AS cluster_id, {_ROLE} AS role,
       CAST(NULL AS STRING) AS role_group, 2 AS layer,
       'spark-defaults.conf' AS file, 'spark.port.maxRetries' AS prop, 'r1' AS value
FROM lineitem WHERE l_linenumber = 1
UNION ALL
SELECT l_orderkey, {_ROLE}, concat('g', CAST(l_linenumber AS STRING)), 4,
       'spark-defaults.conf',
       CASE l_linenumber % 3 WHEN 0 THEN 'spark.port.maxRetries' WHEN 1 THEN 'spark.eventLog.dir'
            ELSE 'spark.driver.cores' END,
       CASE l_linenumber % 3 WHEN 0 THEN CAST(max(l_suppkey) % 32 AS STRING)
            WHEN 1 THEN concat('/logs/', CAST(max(l_suppkey) AS STRING))
            ELSE CAST(max(l_suppkey) % 8 AS STRING) END
FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linenumber""",
    "v_watch": """
SELECT event_id AS resource_version, ts,
       concat('c-', CAST(user_id AS STRING)) AS owner,
       CASE event_type WHEN 'signup' THEN 'SparkCluster' WHEN 'view' THEN 'Service'
            WHEN 'click' THEN 'ConfigMap' WHEN 'purchase' THEN 'StatefulSet'
            ELSE 'SparkCluster' END AS kind,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'ADDED'
            ELSE 'MODIFIED' END AS change,
       CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'ApplyRoleGroupService'
            WHEN 1 THEN 'InvalidProductConfig' ELSE 'SparkVersionParseFailure' END
            END AS error_category,
       value
FROM events""",
    "v_observed": f"""
SELECT l_orderkey AS cluster_id, {_ROLE} AS role,
       concat('g', CAST(CASE WHEN l_linenumber = 7 THEN 8 ELSE l_linenumber END AS STRING))
         AS role_group,
       CAST(CAST(sum(l_quantity) AS BIGINT) % 5 AS INT) AS observed_replicas,
       CAST(CAST(sum(l_quantity) AS BIGINT) % 5 * (min(l_suppkey) % 2) AS INT) AS ready_replicas
FROM lineitem WHERE l_linestatus = 'F'
GROUP BY l_orderkey, l_returnflag, l_linenumber""",
    "unit": _values(list(catalog.UNITS.items()), "unit, regex"),
    "property": _values(catalog.PROPERTIES, "prop, kind, file, datatype, unit, as_of"),
    "property_role": _values(catalog.property_role_rows(), "prop, role, required"),
    "property_value": _values(
        catalog.PROPERTY_VALUES, "prop, value_kind, from_version, to_version, value"
    ),
    "property_expansion": _values(catalog.PROPERTY_EXPANSIONS, "prop, expands_to, value"),
    "v_label": """
SELECT cluster_id, role, role_group, 'role' AS label_key, role AS label_value FROM v_role_group
UNION ALL
SELECT cluster_id, role, role_group, 'group', role_group FROM v_role_group
UNION ALL
SELECT cluster_id, role, role_group, 'sized', 'yes' FROM v_role_group WHERE cores IS NOT NULL""",
    "v_selector": _values(SELECTORS, "selector_id, is_null"),
    "v_selector_expr": _values(
        SELECTOR_EXPRESSIONS, "selector_id, expr_no, label_key, operator, label_value"
    ),
    "v_package": """
SELECT p_partkey AS package_id,
       concat(CAST(p_size % 4 AS STRING), '.', CAST(p_size AS STRING), '.',
              CAST(p_partkey % 13 AS STRING),
              CASE WHEN p_partkey % 3 = 0 THEN '-nightly' ELSE '' END) AS version
FROM part""",
    "v_dependency": """
SELECT DISTINCT l_partkey AS package_id, l_suppkey * 25 AS depends_on
FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_suppkey * 25""",
    # ---- shared steps of several oracles
    "v_versioned": f"""
SELECT *, split_part(version, '-', 1) AS product,
       {_rank("split_part(version, '-', 1)")} AS vk
FROM v_cluster WHERE version IS NOT NULL""",
    "v_group": """
SELECT r.*, c.cluster, c.namespace, c.version, c.product, c.vk, c.stopped, c.secret,
       c.max_port_retries
FROM v_role_group r JOIN v_versioned c USING (cluster_id)""",
    "v_def": f"""
SELECT prop, coalesce(file, 'env') AS file, datatype, unit, {_rank("as_of")} AS as_of_vk
FROM property""",
    "v_derived": """
SELECT g.cluster_id, g.role, g.role_group, d.* FROM v_group g, LATERAL (VALUES
  (1, 'spark-defaults.conf', 'spark.authenticate', CASE WHEN g.secret IS NOT NULL THEN 'true' END),
  (1, 'spark-defaults.conf', 'spark.authenticate.secret', g.secret),
  (1, 'spark-defaults.conf', 'spark.port.maxRetries',
      CAST(coalesce(g.max_port_retries, 0) AS STRING)),
  (1, 'metrics.properties', '*.sink.prometheusServlet.class',
      'org.apache.spark.metrics.sink.PrometheusServlet'),
  (1, 'metrics.properties', '*.sink.prometheusServlet.path', '/metrics'),
  (1, 'metrics.properties', '*.source.jvm.class', 'org.apache.spark.metrics.source.JvmSource'),
  (1, 'env', 'SPARK_MASTER_PORT', CASE WHEN g.role = 'master' THEN '7077' END),
  (3, 'spark-env.sh', 'SPARK_WORKER_CORES',
      CASE WHEN g.role = 'slave' THEN CAST(g.cores AS STRING) END),
  (3, 'spark-env.sh', 'SPARK_WORKER_MEMORY', CASE WHEN g.role = 'slave' THEN g.memory END),
  (3, 'spark-defaults.conf', 'spark.history.store.path',
      CASE WHEN g.role = 'history-server' THEN g.store_path END)
) AS d(layer, file, prop, value)
WHERE d.value IS NOT NULL""",
    "v_spread": """
SELECT o.cluster_id, o.role, g.role_group, o.layer, o.file, o.prop, o.value
FROM v_override o JOIN v_group g ON o.cluster_id = g.cluster_id AND o.role = g.role
 AND (o.role_group IS NULL OR o.role_group = g.role_group)""",
    "v_layers": "SELECT * FROM v_derived UNION ALL SELECT * FROM v_spread",
    "v_merged": """
SELECT cluster_id, role, role_group, file, prop, value, layer FROM (
  SELECT *, row_number() OVER (
      PARTITION BY cluster_id, role, role_group, file, prop ORDER BY layer DESC, value DESC) AS rn
  FROM v_layers) WHERE rn = 1""",
    "v_required": """
SELECT g.cluster_id, g.role, g.role_group, g.vk, d.file, d.prop
FROM v_group g JOIN property_role pr ON pr.role = g.role AND pr.required
JOIN v_def d ON d.prop = pr.prop AND d.as_of_vk <= g.vk""",
    "v_absent": """
SELECT r.* FROM v_required r WHERE NOT EXISTS (
  SELECT 1 FROM v_merged m WHERE m.cluster_id = r.cluster_id AND m.role = r.role
   AND m.role_group = r.role_group AND m.file = r.file AND m.prop = r.prop)""",
    "v_filled": f"""
SELECT cluster_id, role, role_group, file, prop, value, 0 AS layer FROM (
  SELECT a.*, v.value, row_number() OVER (
      PARTITION BY a.cluster_id, a.role, a.role_group, a.file, a.prop
      ORDER BY CASE v.value_kind WHEN 'recommended' THEN 0 ELSE 1 END,
               {_rank("v.from_version")} DESC) AS rn
  FROM v_absent a JOIN property_value v ON v.prop = a.prop
   AND {_rank("v.from_version")} <= a.vk
   AND (v.to_version IS NULL OR a.vk <= {_rank("v.to_version")})) WHERE rn = 1""",
    "v_present": "SELECT * FROM v_merged UNION ALL SELECT * FROM v_filled",
    "v_implied": """
SELECT DISTINCT p.cluster_id, p.role, p.role_group, d.file, d.prop, x.value, -1 AS layer
FROM v_present p JOIN property_expansion x ON x.prop = p.prop
JOIN v_def d ON d.prop = x.expands_to
JOIN property_role pr ON pr.prop = d.prop AND pr.role = p.role
WHERE NOT EXISTS (SELECT 1 FROM v_present q WHERE q.cluster_id = p.cluster_id
  AND q.role = p.role AND q.role_group = p.role_group AND q.file = d.file AND q.prop = d.prop)""",
    "v_effective": """
SELECT e.cluster_id, e.role, e.role_group, e.file, e.prop, e.value, e.layer,
  CASE WHEN e.layer IN (2, 4) AND e.prop IN ('spark.master.port', 'SPARK_MASTER_PORT',
              'SPARK_MASTER_WEBUI_PORT', 'SPARK_WORKER_PORT', 'SPARK_WORKER_WEBUI_PORT',
              'spark.history.ui.port') THEN 'reserved_port'
       WHEN e.prop IN ('SPARK_MASTER_PORT', '*.sink.prometheusServlet.class',
              '*.sink.prometheusServlet.path', '*.source.jvm.class') THEN 'ok'
       WHEN d.prop IS NULL THEN 'uncatalogued'
       WHEN NOT EXISTS (SELECT 1 FROM property_role pr
                        WHERE pr.prop = e.prop AND pr.role = e.role) THEN 'wrong_role'
       WHEN d.as_of_vk > c.vk THEN 'not_yet_available'
       WHEN d.datatype = 'integer' AND NOT regexp_full_match(e.value, '-?[0-9]+')
         THEN 'bad_type'
       WHEN d.datatype = 'bool' AND e.value NOT IN ('true', 'false') THEN 'bad_type'
       WHEN d.unit IS NOT NULL AND NOT regexp_matches(e.value, u.regex) THEN 'bad_unit'
       ELSE 'ok' END AS status
FROM (SELECT * FROM v_present UNION ALL SELECT * FROM v_implied) e
JOIN v_versioned c ON c.cluster_id = e.cluster_id
LEFT JOIN v_def d ON d.prop = e.prop AND d.file = e.file
LEFT JOIN unit u ON u.unit = d.unit""",
    "v_field": """
SELECT cluster_id, role, role_group, concat(file, '/', prop) AS path, value FROM v_effective
WHERE value IS NOT NULL
UNION ALL
SELECT cluster_id, role, role_group, 'replicas',
  CAST(CASE WHEN coalesce(stopped, false) THEN 0 ELSE replicas END AS VARCHAR)
FROM v_group WHERE coalesce(stopped, false) OR replicas IS NOT NULL""",
    "v_before": """
SELECT cluster_id, role, role_group, path,
  CASE WHEN cluster_id % 5 = 0 AND path = 'spark-defaults.conf/spark.port.maxRetries' THEN '99'
       ELSE value END AS value FROM v_field
UNION ALL
SELECT cluster_id, role, role_group, 'spark-defaults.conf/spark.old', 'x'
FROM v_group WHERE cluster_id % 7 = 0""",
    "v_there": """
SELECT b.cluster_id, b.role, b.role_group, path,
  CASE WHEN cluster_id % 11 = 0 AND path = 'metrics.properties/*.sink.prometheusServlet.path'
       THEN '/other' ELSE value END AS value
FROM v_before b JOIN v_observed USING (cluster_id, role, role_group) WHERE path <> 'replicas'
UNION ALL
SELECT cluster_id, role, role_group, 'replicas', CAST(observed_replicas AS VARCHAR) FROM v_observed
UNION ALL
SELECT cluster_id, role, role_group, 'annotations/team', 'blue' FROM v_observed
WHERE cluster_id % 4 = 0""",
    "v_patch": """
SELECT cluster_id, role, role_group, path, op, CASE op WHEN 'set' THEN want END AS value,
  gave IS NOT NULL AND has IS NOT NULL AND gave <> has AS conflict, owned
FROM (SELECT *, CASE WHEN want IS NOT NULL AND want IS DISTINCT FROM has THEN 'set'
                     WHEN want IS NULL AND gave = has THEN 'remove' END AS op,
        want IS NULL OR want IS NOT DISTINCT FROM gave AS owned
      FROM (SELECT cluster_id, role, role_group, path, max(want) AS want, max(gave) AS gave,
              max(has) AS has
            FROM (SELECT cluster_id, role, role_group, path, value AS want, NULL AS gave, NULL AS has
                  FROM v_field
                  UNION ALL
                  SELECT cluster_id, role, role_group, path, NULL, value, NULL FROM v_before
                  WHERE cluster_id % 3 <> 0
                  UNION ALL
                  SELECT cluster_id, role, role_group, path, NULL, NULL, value FROM v_there)
            GROUP BY ALL))""",
    "v_action": """
SELECT cluster_id, role, role_group,
  CASE WHEN o.there IS NULL THEN 'create' WHEN g.wanted IS NULL THEN 'orphan'
       WHEN steps > 0 THEN 'update' WHEN NOT owned THEN 'adopt' ELSE 'noop' END AS action
FROM (SELECT cluster_id, role, role_group, true AS wanted FROM v_group) g
FULL JOIN (SELECT cluster_id, role, role_group, true AS there FROM v_observed) o
  USING (cluster_id, role, role_group)
LEFT JOIN (SELECT cluster_id, role, role_group, count(op) AS steps,
             bool_and(owned AND NOT (path = 'spark-defaults.conf/spark.old' AND cluster_id % 3 <> 0))
               AS owned
           FROM v_patch GROUP BY ALL) p USING (cluster_id, role, role_group)""",
    "v_port": """
SELECT * FROM (VALUES ('master', 'http', 8080), ('master', 'rpc', 7077), ('slave', 'http', 8081),
  ('history-server', 'http', 18080)) AS t(role, port_name, port)""",
    "v_pod": """
SELECT g.*, CAST(o.ordinal AS INT) AS ordinal,
       concat(g.cluster, '-', g.role, '-', g.role_group) AS service,
       concat(g.cluster, '-', g.role, '-', g.role_group, '-', CAST(o.ordinal AS STRING)) AS pod
FROM (SELECT r.*, c.cluster, c.namespace, c.stopped
      FROM v_role_group r JOIN v_cluster c USING (cluster_id)) g,
     LATERAL (SELECT unnest(generate_series(0, coalesce(g.replicas, 0) - 1)) AS ordinal) o""",
    "v_text": """
SELECT cluster_id, role, role_group, file,
       string_agg(concat(prop, CASE file WHEN 'spark-defaults.conf' THEN ' ' ELSE '=' END,
                         value, chr(10)), '' ORDER BY prop) AS text
FROM v_effective WHERE file <> 'env' GROUP BY ALL""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it needs, directly or through others, as CTEs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in needed)
    if not ctes:
        return sql.strip()
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_K = "cluster_id, role, role_group"
_RECORD = (
    "concat(length(file), ':', file, length(prop), ':', prop, "
    "CASE WHEN value IS NULL THEN '-' ELSE concat(length(value), ':', value) END)"
)

_BUMP = """
SELECT package_id, version, major, minor, patch, pre,
  concat(major + 1, '.0.0') AS v_major,
  concat(major, '.', minor + 1, '.0') AS v_minor,
  concat(major, '.', minor, '.', patch + 1) AS v_patch,
  concat(major, '.', minor, '.', patch) AS v_final
FROM (SELECT package_id, version,
   split_part(split_part(version, '-', 1), '.', 1)::BIGINT AS major,
   split_part(split_part(version, '-', 1), '.', 2)::BIGINT AS minor,
   split_part(split_part(version, '-', 1), '.', 3)::BIGINT AS patch,
   split_part(version, '-', 2) AS pre FROM v_package)"""

_PORTS_JSON = """CASE {role} WHEN 'master'
  THEN '[{{"name":"http","port":8080,"protocol":"TCP"}},{{"name":"rpc","port":7077,"protocol":"TCP"}}]'
  WHEN 'slave' THEN '[{{"name":"http","port":8081,"protocol":"TCP"}}]'
  ELSE '[{{"name":"http","port":18080,"protocol":"TCP"}}]' END"""

_SELECTOR_JSON = (
    """concat('{"name":"spark","instance":"', cluster, '","component":"', role, """
    """'","role-group":"', role_group, '"}')"""
)

_LABELS_JSON = (
    """concat('"name":"spark","instance":"', cluster, '","version":"', version, """
    """'","component":"', role, '","role-group":"', role_group, '"')"""
)
_PROBE_JSON = '{"httpGet":{"port":"http"},"initialDelaySeconds":10,"periodSeconds":10}'


def _json_text(file: str) -> str:
    return (
        f"replace(coalesce(max(CASE WHEN file = '{file}' THEN text END), ''), chr(10), '\\n')"
    )


_FOLLOWING = """
SELECT a.*, (SELECT min(b.ts) FROM {right} b WHERE b.owner = a.owner
   AND b.ts {strict} a.ts AND b.ts <= a.ts + INTERVAL '{seconds} seconds') AS next_ts
FROM {left} a"""


def oracles(p) -> dict[str, str]:
    """``p`` holds the parameters both sides share (see queries)."""
    desired_objects = f"""
WITH maps AS (SELECT g.cluster_id, g.role, g.role_group,
    {_json_text("spark-defaults.conf")} AS sd, {_json_text("spark-env.sh")} AS se,
    {_json_text("metrics.properties")} AS me
  FROM v_group g LEFT JOIN v_text t ON g.cluster_id = t.cluster_id AND g.role = t.role
   AND g.role_group = t.role_group GROUP BY ALL),
envs AS (SELECT {_K}, concat('[', string_agg(
    concat('{{"name":"', prop, '","value":"', value, '"}}'), ',' ORDER BY prop), ']') AS env
  FROM v_effective WHERE file = 'env' GROUP BY ALL),
named AS (SELECT g.*, concat(cluster, '-', role, '-', role_group) AS name FROM v_group g)
SELECT 'Service' AS kind, namespace, concat(cluster, '-master') AS name, cluster_id,
       cluster AS owner, 'master' AS component, 'global' AS role_group, version,
       NULL::STRING AS scrape,
       concat('{{"name":"spark","instance":"', cluster, '","version":"', version,
              '","component":"master","role-group":"global"}}') AS labels,
       concat('{{"type":"NodePort","ports":', {_PORTS_JSON.format(role="'master'")},
              ',"selector":{{"name":"spark","instance":"', cluster,
              '","component":"master"}}}}') AS spec
FROM v_versioned
UNION ALL
SELECT 'Service', namespace, name, cluster_id, cluster, role, role_group, version, 'true',
       concat('{{', {_LABELS_JSON}, ',"prometheus.io/scrape":"true"}}'),
       concat('{{"clusterIP":"None","ports":', {_PORTS_JSON.format(role="role")},
              ',"selector":', {_SELECTOR_JSON}, ',"publishNotReadyAddresses":true}}')
FROM named
UNION ALL
SELECT 'ConfigMap', namespace, name, cluster_id, cluster, role, role_group, version, NULL,
       concat('{{', {_LABELS_JSON}, '}}'),
       concat('{{"data":{{"spark-defaults.conf":"', sd, '","spark-env.sh":"', se,
              '","metrics.properties":"', me, '"}}}}')
FROM named JOIN maps USING ({_K})
UNION ALL
SELECT 'StatefulSet', namespace, name, cluster_id, cluster, role, role_group, version, NULL,
       concat('{{', {_LABELS_JSON}, '}}'),
       concat('{{"podManagementPolicy":"Parallel",',
              CASE WHEN coalesce(stopped, false) THEN '"replicas":0,'
                   WHEN replicas IS NULL THEN ''
                   ELSE concat('"replicas":', replicas, ',') END,
              '"serviceName":"', name, '","selector":', {_SELECTOR_JSON},
              ',"image":"{p.registry}:', version, '","args":["sbin/start-', role, '.sh"',
              CASE WHEN role = 'slave' THEN concat(',"spark://', cluster, '-master.', namespace,
                   '.svc.cluster.local:7077"') ELSE '' END,
              '],"env":', coalesce(env, '[]'),
              ',"ports":', replace({_PORTS_JSON.format(role="role")}, '"port":', '"containerPort":'),
              ',"readinessProbe":{_PROBE_JSON},"livenessProbe":{_PROBE_JSON},"volumeMounts":[',
              '{{"name":"log","mountPath":"{p.log_dir}"}},',
              '{{"name":"config","mountPath":"{p.conf_dir}"}}],"podLabels":{{', {_LABELS_JSON},
              '}},"volumes":[{{"name":"config","configMap":"', name,
              '"}}],"volumeClaimTemplates":[{{"name":"log","accessModes":["ReadWriteOnce"],',
              '"storage":"1Gi"}}]}}')
FROM named LEFT JOIN envs USING ({_K})"""

    selected = f"""
SELECT s.selector_id, {_K} FROM v_selector s CROSS JOIN v_role_group g
WHERE NOT s.is_null AND NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT selector_id, expr_no, label_key, operator FROM v_selector_expr) e
  WHERE e.selector_id = s.selector_id AND NOT CASE e.operator
    WHEN 'In' THEN {{value}} IS NOT NULL AND {{inside}}
    WHEN 'NotIn' THEN NOT ({{value}} IS NOT NULL AND {{inside}})
    WHEN 'Exists' THEN {{value}} IS NOT NULL
    ELSE {{value}} IS NULL END)"""
    value = (
        "CASE e.label_key WHEN 'role' THEN g.role WHEN 'group' THEN g.role_group "
        "WHEN 'sized' THEN CASE WHEN g.cores IS NOT NULL THEN 'yes' END END"
    )
    inside = (
        "concat(e.selector_id, '|', e.expr_no, '|', " + value + ") IN (SELECT "
        "concat(selector_id, '|', expr_no, '|', label_value) FROM v_selector_expr "
        "WHERE label_value IS NOT NULL)"
    )

    failures = "SELECT * FROM v_watch WHERE change = 'ERROR'"
    out = {
        "effective_config": "SELECT * FROM v_effective",
        "effective_status": """
SELECT layer, status, count(*) AS n FROM v_effective GROUP BY layer, status""",
        "merge_layers": "SELECT * FROM v_merged",
        "read_specs": """
SELECT cluster, namespace, version, stopped, secret, max_port_retries
FROM v_cluster WHERE cluster_id IN (SELECT cluster_id FROM v_role_group)""",
        "flatten_role_groups": """
SELECT c.cluster AS cluster_id, r.role, r.role_group,
       r.replicas, r.cores, r.memory, r.store_path
FROM v_role_group r JOIN v_cluster c USING (cluster_id)""",
        "effective_config_of_specs": """
SELECT concat('c-', cluster_id) AS cluster_id, role, role_group,
       file, prop, value, layer, status FROM v_effective""",
        "read_catalog": """
SELECT d.prop, d.file, d.datatype, d.unit, pr.role, pr.required,
       (SELECT count(*) FROM v_override o WHERE o.prop = d.prop AND o.role = pr.role)
         AS overrides
FROM v_def d JOIN property_role pr ON pr.prop = d.prop""",
        "watch_stream": """
SELECT kind, change, count(*) AS n, count(DISTINCT owner) AS owners FROM v_watch GROUP BY ALL""",
        "write_config": """
SELECT cluster_id, role, role_group, file, text FROM v_text""",
        "apply_snapshot": """
SELECT owner, kind, resource_version, change FROM (
  SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY resource_version DESC) AS rn
  FROM v_watch) WHERE rn = 1""",
        "report_errors": """
WITH c AS (SELECT *, CASE WHEN cluster_id % 17 <> 0 THEN namespace END AS home FROM v_cluster),
g AS (SELECT r.* EXCLUDE (role, replicas), c.cluster, c.home,
        CASE WHEN cluster_id % 23 = 0 AND role = 'slave' THEN 'worker' ELSE role END AS role,
        CASE WHEN cluster_id % 19 = 0 THEN replicas + 65534 ELSE replicas END AS replicas
      FROM v_role_group r JOIN c USING (cluster_id)),
e AS (
  SELECT cluster, cluster AS object, 'ObjectHasNoVersion' AS category,
    concat('cannot use version none of ', cluster) AS message FROM c WHERE version IS NULL
  UNION ALL
  SELECT cluster, cluster, 'NoNamespace', concat(cluster, ' has no namespace') FROM c
  WHERE home IS NULL
  UNION ALL
  SELECT cluster, concat(cluster, '-', role, '-', role_group), 'InvalidRole',
    'no role is called worker; there are master, slave, history-server' FROM g
  WHERE role = 'worker'
  UNION ALL
  SELECT cluster, concat(cluster, '-', role, '-', role_group), 'InvalidReplicas',
    concat('replicas ', replicas, ' are not within 0 and 65535') FROM g WHERE replicas > 65535
  UNION ALL
  SELECT cluster, concat(cluster, '-', role, '-', role_group), 'SparkMasterFqdnIsMissing',
    concat('the master of ', cluster, ' has no address') FROM g WHERE role = 'slave' AND home IS NULL
  UNION ALL
  SELECT cluster, concat(cluster, '-', role, '-', role_group), 'SerializeSparkDefaults',
    concat('a file of ', cluster, '-', role, '-', role_group, ' is not declared') FROM v_group
  WHERE cluster_id % 29 = 0)
SELECT object, category, message, epoch_us(ts) AS time_us
FROM e LEFT JOIN (SELECT owner AS cluster, max(ts) AS ts FROM v_watch GROUP BY owner) USING (cluster)
UNION ALL
SELECT owner, error_category, concat('change ', resource_version, ' of ', kind, ' failed'),
  epoch_us(ts) FROM v_watch WHERE change = 'ERROR'""",
        "in_namespace": f"""
SELECT cluster_id, cluster, version FROM v_cluster WHERE namespace = '{p.namespace}'""",
        "check_role": """
SELECT l_orderkey AS cluster_id, l_linenumber AS number, role, count(*) AS n,
  CASE WHEN role NOT IN ('master', 'slave', 'history-server') THEN
    concat('no role is called ', role, '; there are master, slave, history-server') END AS error
FROM (SELECT *, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'worker'
        WHEN l_returnflag = 'A' THEN 'master' WHEN l_returnflag = 'N' THEN 'slave'
        ELSE 'history-server' END AS role FROM lineitem) GROUP BY ALL""",
        "product_version": f"""
SELECT cluster_id, version, split_part(version, '-', 1) AS product,
       CASE WHEN version IS NULL THEN 'ObjectHasNoVersion' END AS version_error FROM v_cluster""",
        "effective_replicas": """
SELECT r.cluster_id, r.role, r.role_group,
       CASE WHEN coalesce(stopped, false) THEN 0 ELSE replicas END AS replicas
FROM v_role_group r JOIN v_cluster c USING (cluster_id)""",
        "object_names": """
SELECT cluster_id, role, role_group, object_name,
       concat(object_name, '.', namespace, '.svc.cluster.local') AS service_fqdn, global_service,
       concat(global_service, '.', namespace, '.svc.cluster.local') AS global_fqdn
FROM (SELECT r.*, c.namespace, concat(cluster, '-', role, '-', role_group) AS object_name,
        concat(cluster, '-master') AS global_service
      FROM v_role_group r JOIN v_cluster c USING (cluster_id))""",
        "expand_pods": """
SELECT cluster_id, role_group, ordinal, pod,
       concat(pod, '.', service, '.', namespace, '.svc.cluster.local') AS pod_fqdn,
       NULL::VARCHAR AS error
FROM v_pod WHERE role = 'master' AND cluster_id % 17 <> 0
UNION ALL
SELECT cluster_id, role_group, NULL, NULL, NULL, 'NoNamespace'
FROM v_role_group JOIN v_cluster USING (cluster_id) WHERE role = 'master' AND cluster_id % 17 = 0""",
        "endpoints": f"""
SELECT {_K}, port_name, port, 'TCP' AS protocol FROM v_role_group JOIN v_port USING (role)""",
        "start_command": """
SELECT r.cluster_id, r.role, r.role_group,
  CASE WHEN role <> 'slave' OR cluster_id % 17 <> 0 THEN concat('sbin/start-', role, '.sh',
    CASE WHEN role = 'slave' THEN concat(' spark://', cluster, '-master.', namespace,
         '.svc.cluster.local:7077') ELSE '' END) END AS command,
  CASE WHEN role = 'slave' AND cluster_id % 17 = 0 THEN 'SparkMasterFqdnIsMissing' END AS error
FROM v_role_group r JOIN v_cluster c USING (cluster_id)""",
        "image_ref": f"""
SELECT cluster_id, concat('{p.registry}:', version) AS image FROM v_versioned""",
        "scrape_targets": """
SELECT cluster_id, role, role_group, concat(pod, '.', service, '.', namespace,
       '.svc.cluster.local:', CAST(port AS STRING)) AS target, '/metrics' AS path
FROM v_pod JOIN v_port USING (role)
WHERE port_name = 'http' AND NOT coalesce(stopped, false)""",
        "derive_properties": "SELECT * FROM v_derived",
        "register_rule": """
SELECT * FROM v_derived UNION ALL
SELECT cluster_id, role, role_group, 1, 'spark-env.sh', 'SPARK_WORKER_INSTANCES',
       CAST(replicas AS STRING) FROM v_group WHERE role = 'slave' AND replicas > 0""",
        "desired_objects": desired_objects,
        "label_columns": """
SELECT cluster_id, role, role_group, 'spark' AS label_name, cluster AS label_instance,
       version AS label_version, role AS label_component, role_group AS label_role_group,
       'spark' AS selector_name, cluster AS selector_instance, role AS selector_component,
       role_group AS selector_role_group, CAST(4 AS INT) AS selector_size
FROM v_group
UNION ALL
SELECT cluster_id, 'master', 'global', 'spark', cluster, version, 'master', 'global',
       'spark', cluster, 'master', NULL, CAST(3 AS INT)
FROM v_versioned""",
        "match_catalog": f"""
SELECT o.{_K.replace(", ", ", o.")}, o.file, o.prop, o.value, d.datatype, d.unit,
  d.prop IS NOT NULL AS known,
  d.prop IS NOT NULL AND NOT EXISTS (SELECT 1 FROM property_role pr
     WHERE pr.prop = o.prop AND pr.role = o.role) AS wrong_role
FROM v_layers o LEFT JOIN v_def d ON d.prop = o.prop AND d.file = o.file""",
        "values_for_version": f"""
SELECT {_K}, layer, prop, value_kind, range_value, available FROM (
  SELECT s.*, v.value_kind, v.value AS range_value, d.as_of_vk <= g.vk AS available
  FROM v_layers s JOIN v_group g USING ({_K}) JOIN property_value v ON v.prop = s.prop
   AND {_rank("v.from_version")} <= g.vk
   AND (v.to_version IS NULL OR g.vk <= {_rank("v.to_version")})
  JOIN v_def d ON d.prop = s.prop)""",
        "missing_required": f"SELECT {_K}, file, prop FROM v_absent",
        "expand_implied": f"""
SELECT {_K}, file, prop, value, layer FROM v_merged
UNION ALL
SELECT DISTINCT p.cluster_id, p.role, p.role_group, d.file, d.prop, x.value, -1 AS layer
FROM v_merged p JOIN property_expansion x ON x.prop = p.prop
JOIN v_def d ON d.prop = x.expands_to
JOIN property_role pr ON pr.prop = d.prop AND pr.role = p.role
WHERE NOT EXISTS (SELECT 1 FROM v_merged q WHERE q.cluster_id = p.cluster_id
  AND q.role = p.role AND q.role_group = p.role_group AND q.file = d.file AND q.prop = d.prop)""",
        "select_by_labels": selected.format(value=value, inside=inside),
        "diff_state": f"""
SELECT coalesce(d.cluster_id, o.cluster_id) AS cluster_id, coalesce(d.role, o.role) AS role,
       coalesce(d.role_group, o.role_group) AS role_group, desired_replicas, observed_replicas,
       CASE WHEN o.cluster_id IS NULL THEN 'create' WHEN d.cluster_id IS NULL THEN 'orphan'
            WHEN desired_replicas IS NULL OR desired_replicas = observed_replicas THEN 'noop'
            ELSE 'update' END AS action
FROM (SELECT {_K}, CASE WHEN coalesce(stopped, false) THEN 0 ELSE replicas END AS desired_replicas
      FROM v_role_group JOIN v_cluster USING (cluster_id)) d
FULL OUTER JOIN v_observed o ON d.cluster_id = o.cluster_id AND d.role = o.role
 AND d.role_group = o.role_group""",
        "owner_of": """
SELECT w.resource_version, w.kind, w.owner, c.cluster_id, c.namespace
FROM v_watch w JOIN v_cluster c ON c.cluster = w.owner WHERE w.kind <> 'SparkCluster'""",
        "scenario_grid": """
WITH e AS (SELECT DISTINCT event_type AS v FROM events),
s AS (SELECT DISTINCT o_orderstatus AS v FROM orders),
q AS (SELECT DISTINCT lower(c_mktsegment) AS v FROM customer)
SELECT n_name AS test, concat('event-', e.v, '_status-', s.v) AS scenario
FROM nation, e, s WHERE n_regionkey % 2 = 0
UNION ALL
SELECT n_name, concat('segment-', q.v, '_event-', e.v, '_status-', s.v)
FROM nation, q, e, s WHERE n_regionkey % 2 = 1""",
        "check_expectations": f"""
SELECT {_K}, CASE WHEN o.cluster_id IS NULL THEN 'missing'
    WHEN r.replicas IS NULL OR (r.replicas = o.observed_replicas
                                AND r.replicas = o.ready_replicas) THEN 'pass'
    ELSE 'mismatch' END AS result
FROM v_role_group r LEFT JOIN v_observed o USING ({_K})""",
        "propagate_versions": f"""
WITH b AS ({_BUMP})
SELECT d.package_id, d.depends_on, concat(b.v_minor, '-nightly') AS dependency_version
FROM v_dependency d JOIN b ON b.package_id = d.depends_on
WHERE d.package_id IN (SELECT package_id FROM v_package)""",
        "render_config": "SELECT * FROM v_text",
        "config_maps": f"""
SELECT g.cluster_id, g.role, g.role_group,
  coalesce(max(CASE WHEN file = 'spark-defaults.conf' THEN text END), '') AS spark_defaults,
  coalesce(max(CASE WHEN file = 'spark-env.sh' THEN text END), '') AS spark_env,
  coalesce(max(CASE WHEN file = 'metrics.properties' THEN text END), '') AS metrics,
  NULL::VARCHAR AS error
FROM v_group g LEFT JOIN v_text t ON g.cluster_id = t.cluster_id AND g.role = t.role
 AND g.role_group = t.role_group GROUP BY ALL""",
        "fingerprint": f"""
SELECT {_K}, sha256(string_agg({_RECORD}, '' ORDER BY {_RECORD})) AS fingerprint FROM v_effective GROUP BY ALL""",
        "stable_order": f"""
SELECT {_K}, file, CAST(row_number() OVER (PARTITION BY {_K}, file ORDER BY prop) - 1 AS INT)
  AS pos, prop FROM v_merged""",
        "error_counts": """
SELECT error_category AS category, count(*) AS n FROM v_watch WHERE change = 'ERROR'
GROUP BY error_category""",
        "readiness": f"""
SELECT {_K}, CAST(observed_replicas AS BIGINT) AS replicas,
  CAST(ready_replicas AS BIGINT) AS ready_replicas,
  observed_replicas = ready_replicas AS all_ready FROM v_observed""",
        "latest_per_key": """
SELECT owner, resource_version, kind, change, value FROM (
  SELECT *, row_number() OVER (PARTITION BY owner ORDER BY resource_version DESC) AS rn
  FROM v_watch) WHERE rn = 1""",
        "union_kinds": f"""
SELECT 'Service' AS kind, concat(cluster, '-master') AS name, cluster_id, NULL::INT AS replicas
FROM v_versioned
UNION ALL
SELECT k.kind, concat(cluster, '-', role, '-', role_group), cluster_id,
  CASE WHEN k.kind = 'StatefulSet' THEN
    CASE WHEN coalesce(stopped, false) THEN 0 ELSE replicas END END
FROM v_group, (VALUES ('Service'), ('ConfigMap'), ('StatefulSet')) AS k(kind)""",
        "version_key": """
SELECT package_id, split_part(split_part(version, '-', 1), '.', 1)::INT AS major,
  split_part(split_part(version, '-', 1), '.', 2)::INT AS minor,
  split_part(split_part(version, '-', 1), '.', 3)::INT AS patch,
  [part::INT FOR part IN string_split(split_part(version, '-', 1), '.')] >= [2, 9, 0]
    AS at_least_2_9 FROM v_package""",
        "bump_version": f"""
SELECT package_id, version, concat(v_major, '-nightly') AS next_major,
  concat(v_minor, '-nightly') AS next_minor, concat(v_patch, '-nightly') AS next_patch,
  v_final AS finalized, concat(v_final, '-rc1') AS tagged,
  CASE WHEN pre = '' THEN v_patch ELSE v_final END AS following, '7.0.0' AS fixed
FROM ({_BUMP})""",
        "check_datatype": f"""
SELECT {_K}, m.file, m.prop, value, CASE datatype
   WHEN 'integer' THEN regexp_full_match(value, '-?[0-9]+')
   WHEN 'bool' THEN value IN ('true', 'false') ELSE true END AS fits
FROM v_layers m JOIN v_def d ON d.prop = m.prop AND d.file = m.file""",
        "check_unit": f"""
SELECT {_K}, m.file, m.prop, value, u.unit, regexp_matches(value, u.regex) AS fits
FROM v_layers m JOIN v_def d ON d.prop = m.prop AND d.file = m.file JOIN unit u USING (unit)""",
        "validate": f"""
SELECT {_K}, file, prop, value, layer, status FROM v_effective WHERE layer >= 1
UNION ALL
SELECT {_K}, file, prop, NULL, NULL, 'missing_required' FROM v_absent""",
        "split_tokens": """
SELECT cluster_id, role, role_group, split_part(memory, ' ', 1) AS first_token,
  CAST(len(string_split(memory, ' ')) AS INT) AS tokens, upper(memory) AS upper_memory
FROM v_role_group WHERE memory IS NOT NULL""",
        # ---- streams
        "latest_stream": """
SELECT owner, resource_version, kind, change FROM (
  SELECT *, row_number() OVER (PARTITION BY owner ORDER BY resource_version DESC) AS rn
  FROM v_watch) WHERE rn = 1""",
        "reconcile_stream": f"""
SELECT {_K}, desired_replicas, fingerprint, action, coalesce(steps, '') AS steps
FROM v_action
JOIN (SELECT {_K}, CASE WHEN coalesce(stopped, false) THEN 0 ELSE replicas END AS desired_replicas
      FROM v_group WHERE cluster IN (SELECT owner FROM v_watch)) USING ({_K})
LEFT JOIN (SELECT {_K}, sha256(string_agg({_RECORD}, '' ORDER BY {_RECORD})) AS fingerprint
           FROM v_effective GROUP BY ALL) USING ({_K})
LEFT JOIN (SELECT {_K}, string_agg(concat(path, ' ', op, ' ', value), chr(10) ORDER BY path) AS steps
           FROM v_patch WHERE op IS NOT NULL GROUP BY ALL) USING ({_K})
WHERE action IN ('create', 'update', 'adopt')""",
        "patch_objects": f"""
SELECT {_K}, action, path, op, value, conflict
FROM v_action LEFT JOIN (SELECT v_patch.* FROM v_patch JOIN v_group USING ({_K}) WHERE op IS NOT NULL)
  USING ({_K})""",
        "reconcile_errors": """
SELECT cluster AS object, 'ObjectHasNoVersion' AS category,
  concat('cannot use version none of ', cluster) AS message, max(epoch_us(ts)) AS time_us
FROM v_cluster JOIN v_watch ON owner = cluster WHERE version IS NULL GROUP BY cluster""",
        "retry_due": f"""
WITH f AS ({failures}), s AS (SELECT * FROM v_watch WHERE change <> 'ERROR')
SELECT resource_version, owner, epoch_us(ts) AS failed_us,
  epoch_us(ts) + {p.retry_delay * 1000000} AS due_us
FROM ({_FOLLOWING.format(left="f", right="s", strict=">", seconds=p.retry_delay)})
WHERE next_ts IS NULL""",
        "eventually": f"""
WITH a AS (SELECT * FROM v_watch WHERE change = 'ADDED'),
s AS (SELECT * FROM v_watch WHERE kind = 'StatefulSet')
SELECT resource_version, owner, CASE WHEN next_ts IS NULL THEN 'timeout' ELSE 'pass' END AS result,
  epoch_us(next_ts) - epoch_us(ts) AS waited_us
FROM ({_FOLLOWING.format(left="a", right="s", strict=">=", seconds=p.timeout)})""",
        "error_rate": f"""
SELECT error_category AS category, epoch_us(ts) // {p.width * 1000000} * {p.width} AS window_s,
  count(*) AS n FROM v_watch WHERE change = 'ERROR' GROUP BY ALL""",
        "dedupe_stream": """
SELECT resource_version, owner, kind, change FROM v_watch""",
        "stop_stream": """
SELECT kind, count(*) AS n FROM v_watch GROUP BY kind""",
    }
    passed = "(SELECT max(epoch_us(ts)) - 3600000000 FROM v_watch)"

    def liveness(until: str) -> str:
        """Ticks of the periods that ended by ``until``."""
        period = p.period * 1000000
        return f"""
WITH w AS (SELECT owner, epoch_us(ts) // {period} AS slot, min(epoch_us(ts)) AS us
           FROM v_watch GROUP BY ALL),
b AS (SELECT owner, min(us) AS first_us FROM w GROUP BY owner),
t AS (SELECT owner, unnest(generate_series(
        CAST(ceil((first_us + {p.delay * 1000000}) / {period}.0) AS BIGINT),
        {until} // {period} - 1)) AS slot FROM b)
SELECT t.owner, t.slot * {p.period} AS tick_s FROM t
WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.owner = t.owner AND w.slot = t.slot)"""

    # A stream answers what the watermark has passed.
    def closed(seconds: int) -> str:
        return f"us + {seconds * 1000000} <= {passed}"

    def met(step: int, first: str, second: str, wants: tuple[int, int]) -> str:
        """The first instant of an open step at which both kinds have what is wanted."""
        end = f"start_us + {p.step_timeout * 1000000}"
        return f"""
c{step} AS (SELECT test, start_us, start_us AS us FROM o{step}
  UNION SELECT test, start_us, us FROM o{step} JOIN st ON owner = test
  WHERE kind IN ('{first}', '{second}') AND us > start_us AND us <= {end}),
m{step} AS (SELECT test, min(c.us) AS met_us FROM c{step} c
  ASOF JOIN (SELECT * FROM st WHERE kind = '{first}') a ON a.owner = c.test AND c.us >= a.us
  ASOF JOIN (SELECT * FROM st WHERE kind = '{second}') b ON b.owner = c.test AND c.us >= b.us
  WHERE a.status = {wants[0]} AND b.status = {wants[1]} GROUP BY test),
r{step} AS (SELECT test, {step} AS step,
    CASE WHEN met_us IS NULL THEN 'timeout' ELSE 'pass' END AS result,
    start_us, coalesce(met_us, {end}) AS end_us FROM o{step} LEFT JOIN m{step} USING (test))"""

    out["run_steps"] = f"""
WITH st AS (SELECT owner, kind, epoch_us(ts) AS us, arg_max(resource_version % 2, resource_version) AS status
            FROM v_watch GROUP BY ALL),
o1 AS (SELECT owner AS test, min(us) AS start_us FROM st GROUP BY owner),
{met(1, "Service", "StatefulSet", (0, 1))},
o2 AS (SELECT test, end_us AS start_us FROM r1 WHERE result = 'pass'),
{met(2, "ConfigMap", "StatefulSet", (0, 0))}
SELECT test, step, result, start_us, end_us FROM r1
UNION ALL SELECT test, 2, coalesce(result, 'not_run'), r2.start_us, r2.end_us
FROM o1 LEFT JOIN r2 USING (test)"""
    out["liveness"] = liveness("(SELECT max(epoch_us(ts)) FROM v_watch)")
    out["liveness_stream"] = liveness(passed)
    out["retry_due_stream"] = f"""
WITH f AS ({failures}), s AS (SELECT * FROM v_watch WHERE change <> 'ERROR')
SELECT resource_version, owner, us AS failed_us, us + {p.retry_delay * 1000000} AS due_us
FROM (SELECT *, epoch_us(ts) AS us FROM
  ({_FOLLOWING.format(left="f", right="s", strict=">", seconds=p.retry_delay)}))
WHERE next_ts IS NULL AND {closed(p.retry_delay)}"""
    out["eventually_stream"] = f"""
WITH a AS (SELECT * FROM v_watch WHERE change = 'ADDED'),
s AS (SELECT * FROM v_watch WHERE kind = 'StatefulSet')
SELECT resource_version, owner, CASE WHEN next_ts IS NULL THEN 'timeout' ELSE 'pass' END AS result,
  epoch_us(next_ts) - us AS waited_us
FROM (SELECT *, epoch_us(ts) AS us FROM
  ({_FOLLOWING.format(left="a", right="s", strict=">=", seconds=p.timeout)}))
WHERE us + {(p.timeout + 1) * 1000000} < {passed}"""
    def digest(keys: str, record: str, table: str) -> str:
        """Nodes by ``keys``: sums of the parts of their children's hashes."""
        sums = ", ".join(
            f"CAST(sum(CAST(concat('0x', substr(h, {1 + 15 * k}, 15)) AS HUGEINT)) % {1 << 60} AS BIGINT) AS p{k}"
            for k in range(4)
        )
        text = ", ".join(f"lpad(lower(hex(p{k})), 15, '0')" for k in range(4))
        return (
            f"SELECT {keys}, concat({text}) AS digest, n FROM (SELECT {keys}, {sums}, count(*) AS n "
            f"FROM (SELECT {keys}, sha256({record}) AS h FROM {table}) GROUP BY {keys})"
        )

    def record(*names: str) -> str:
        return "concat(" + ", ".join(
            f"CASE WHEN {n} IS NULL THEN '-' ELSE concat(length({n}), ':', {n}) END" for n in names
        ) + ")"

    out["cluster_digests"] = f"""
WITH files AS ({digest(f"{_K}, file", record("prop", "value"), "v_effective")}),
of_groups AS ({digest(_K, record("file", "digest"), "files")})
{digest("cluster_id", record("role", "role_group", "digest"), "of_groups")}"""
    out["diff_trees"] = f"""
SELECT {_K}, file, prop, '99' AS old, value AS new FROM v_effective
WHERE prop = 'spark.port.maxRetries' AND cluster_id % 5 = 0 AND value <> '99'
UNION ALL
SELECT {_K}, file, 'spark.old', 'x', NULL FROM v_effective
WHERE prop = 'spark.port.maxRetries' AND cluster_id % 7 = 0"""
    out["error_rate_batch"] = out["error_rate"]
    out["read_specs_yaml"] = out["read_specs"]
    return {name: with_views(sql) for name, sql in out.items()}
