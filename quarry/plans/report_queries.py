"""Queries of the validation delta and the runtime summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import reports
from quarry.plans.inputs import derive
from quarry.plans.registry import query

_DELTA = {
    "docs": "SELECT c_custkey AS doc_id FROM customer",
    "issues": """
SELECT user_id AS doc_id, CASE event_type WHEN 'error' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'gap' END AS severity,
  CASE event_id % 8 WHEN 0 THEN 'missing_section' WHEN 1 THEN 'missing_database_schema' WHEN 2 THEN 'dependency_unreferenced' WHEN 3 THEN 'security_missing_authentication' WHEN 4 THEN 'security_missing_authorization' WHEN 5 THEN 'missing_modules' WHEN 6 THEN 'other' ELSE NULL END AS code,
  CASE WHEN event_id % 8 = 0 THEN 'Required section "S' || CAST(event_id % 5 AS STRING) || '" is missing.' WHEN event_id % 3 = 0 THEN NULL ELSE 'says ' || event_type END AS message,
  CASE WHEN event_id % 4 = 0 THEN 'doc#' || CAST(event_id % 6 AS STRING) ELSE NULL END AS source_ref, CASE WHEN event_id % 5 = 0 THEN event_id % 9 ELSE NULL END AS source_line FROM events""",
    "nodes": "SELECT o_custkey % 200 AS doc_id, o_orderpriority || CAST(o_orderkey % 5 AS STRING) AS type, o_orderkey AS ord FROM orders WHERE o_custkey % 200 < 150",
    "edges": "SELECT o_custkey % 200 AS doc_id FROM orders WHERE o_orderkey % 3 = 0",
    "tables": "SELECT s_suppkey AS doc_id FROM supplier WHERE s_suppkey % 2 = 0",
}
_DELTA_SQL = ", ".join(f"{k} AS ({sql})" for k, sql in _DELTA.items())


def _delta(s, d):  # noqa: ANN001, ANN202
    return [derive(s, d, sql) for sql in _DELTA.values()]


@query("a19_delta_items", f"""
WITH {_DELTA_SQL},
u AS (
  SELECT doc_id, 'missing_section' AS part, regexp_extract(message, '"(.*)"', 1) AS value FROM issues WHERE code = 'missing_section'
  UNION SELECT doc_id, 'schema_gap', coalesce(message, 'Database schema inference gap') FROM issues WHERE code = 'missing_database_schema'
  UNION SELECT doc_id, 'persistence_signal', coalesce(message, code) FROM issues WHERE code IN ('dependency_unreferenced', 'missing_database_schema')
  UNION SELECT doc_id, 'review_target', coalesce(source_ref, CAST(source_line AS VARCHAR), code, 'unknown') FROM issues
  UNION SELECT doc_id, 'hint', CASE code WHEN 'missing_section' THEN 'Add the missing semantic section explicitly so the MCP validator can anchor the expectation.' WHEN 'missing_modules' THEN 'Add explicit module boundaries when the slice is layered or enterprise-like.'
    WHEN 'missing_database_schema' THEN 'Describe tables, keys, and relationships in the semantic source so DB schema inference has stable anchors.' WHEN 'security_missing_authentication' THEN 'Make authentication explicit in the security section and in the affected flows.'
    WHEN 'security_missing_authorization' THEN 'Make authorization, ownership, and write access rules explicit.' ELSE 'Reference dependencies from the processes or interfaces that actually use them.' END FROM issues WHERE code NOT IN ('other')
  UNION SELECT doc_id, 'hint', 'No database schema was inferred; consider adding explicit persistence terminology if storage should be modeled.' FROM docs
    WHERE doc_id NOT IN (SELECT doc_id FROM tables) AND doc_id NOT IN (SELECT doc_id FROM issues WHERE severity = 'warning')
  UNION SELECT doc_id, 'layer', type FROM (SELECT doc_id, type FROM nodes GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) <= 12))
SELECT * FROM u""".replace("GROUP BY ALL QUALIFY", "GROUP BY doc_id, type QUALIFY"))
def _(s, d):
    return reports.validation_delta(*_delta(s, d))


@query("a19_graph_signals", f"""
WITH {_DELTA_SQL} SELECT doc_id, (SELECT count(*) FROM nodes n WHERE n.doc_id = docs.doc_id) AS n_nodes, (SELECT count(*) FROM edges e WHERE e.doc_id = docs.doc_id) AS n_edges, (SELECT count(*) FROM tables t WHERE t.doc_id = docs.doc_id) AS n_tables FROM docs""")
def _(s, d):
    docs, _issues, nodes, edges, tables = _delta(s, d)
    return reports.graph_signals(docs, nodes, edges, tables)


_TYPES = """
SELECT lower(replace(p_brand, '#', '')) AS project, CASE WHEN p_size % 5 < 3 THEN 'x/app/' ELSE 'x/lib/' END || CASE WHEN p_size % 4 = 0 THEN 'security/' ELSE '' END || 'P' || CAST(p_partkey AS STRING) || '.java' AS file,
  CASE WHEN p_size % 7 = 0 THEN 'com.app' ELSE 'com.x' END AS package, CASE WHEN p_size % 6 = 0 THEN 'Security' ELSE 'P' END || CAST(p_partkey % 90 AS STRING) AS type_name,
  CASE p_partkey % 6 WHEN 0 THEN 'SpringBootApplication' WHEN 1 THEN 'Configuration Primary' WHEN 2 THEN 'ConfigurationPropertiesScan' ELSE 'Component' END AS annotated,
  CASE WHEN p_size % 3 = 0 THEN 'main' ELSE 'start' END AS method, CASE WHEN p_size % 8 = 0 THEN 'Bean' ELSE 'Override' END AS method_annotated, p_partkey AS ord FROM part"""
_CONFIGS = """
SELECT 'brand' || CAST(1 + s_suppkey % 25 AS STRING) AS project, CASE WHEN s_suppkey % 5 = 0 THEN 'x/lib/' ELSE 'x/app/src/main/resources/' END || CASE s_nationkey % 4 WHEN 0 THEN 'mail' WHEN 1 THEN 'security' WHEN 2 THEN 'minio' ELSE 'application' END || '-' || CAST(s_suppkey % 3 AS STRING) || '.yml' AS file,
  CASE s_nationkey % 7 WHEN 0 THEN 'spring:' || chr(10) || '  flyway:' WHEN 1 THEN 'management: on' WHEN 2 THEN 'spring:' || chr(10) || '  datasource: x' WHEN 3 THEN 'spring:' || chr(10) || '  redis: y' WHEN 4 THEN 'Kafka: z' WHEN 5 THEN 'stomp issuer' ELSE NULL END AS text FROM supplier"""
_BUILDS = """
SELECT 'brand' || CAST(1 + n_nationkey AS STRING) AS project, CASE n_nationkey % 3 WHEN 0 THEN 'x/lib/pom.xml' ELSE 'x/app/pom.xml' END AS file, CASE n_nationkey % 2 WHEN 0 THEN '<a>spring-boot-starter-actuator</a>' ELSE '<a>flyway-core</a>' END AS text FROM nation"""


@query("a14_runtime_items", f"""
WITH t AS ({_TYPES}), a AS (SELECT * FROM t WHERE contains(file, '/app/') OR package = 'com.app'), c AS (SELECT *, regexp_extract(file, '([^/]+)$', 1) AS name FROM ({_CONFIGS}) WHERE contains(file, '/app/src/main/resources/')), b AS (SELECT * FROM ({_BUILDS}) WHERE file = 'x/app/pom.xml'),
f AS (SELECT project, arg_min(type_name, ord) AS boot FROM a WHERE annotated = 'SpringBootApplication' AND method = 'main' GROUP BY 1)
SELECT project, 'entry_point' AS part, boot || '.main' AS value FROM f UNION SELECT project, 'bootstrap', boot FROM f UNION SELECT project, 'feature', 'Spring Boot application entry point' FROM f
UNION SELECT project, 'feature', 'Configuration properties scanning' FROM a WHERE annotated = 'ConfigurationPropertiesScan' UNION SELECT project, 'bean', type_name FROM a WHERE method_annotated = 'Bean'
UNION SELECT project, 'security', type_name FROM a WHERE annotated LIKE 'Configuration%' AND (contains(file, 'security') OR contains(type_name, 'Security'))
UNION SELECT project, 'config', name FROM c UNION SELECT project, 'security', name FROM c WHERE contains(name, 'security') OR contains(text, 'issuer')
UNION SELECT project, 'feature', 'Flyway incremental database migrations' FROM c WHERE contains(text, 'flyway:') UNION SELECT project, 'feature', 'Actuator runtime endpoints' FROM c WHERE contains(text, 'management:')
UNION SELECT project, 'feature', 'Datasource bootstrap configuration' FROM c WHERE contains(text, 'datasource:') UNION SELECT project, 'feature', 'Redis runtime configuration' FROM c WHERE contains(text, 'redis:')
UNION SELECT project, 'external', 'Mail service' FROM c WHERE contains(name, 'mail') UNION SELECT project, 'external', 'MinIO / object storage' FROM c WHERE contains(name, 'minio') UNION SELECT project, 'external', 'Redis' FROM c WHERE contains(text, 'redis:')
UNION SELECT project, 'external', 'External auth providers' FROM c WHERE contains(name, 'security') OR contains(text, 'issuer') UNION SELECT project, 'external', 'WebSocket' FROM c WHERE contains(text, 'stomp') UNION SELECT project, 'external', 'Message broker / event stream' FROM c WHERE contains(text, 'Kafka')
UNION SELECT project, 'feature', 'Actuator runtime endpoints' FROM b WHERE contains(text, 'actuator') UNION SELECT project, 'feature', 'Flyway incremental database migrations' FROM b WHERE contains(text, 'flyway-core')""")
def _(s, d):
    types = derive(s, d, _TYPES).withColumns({"annotations": F.split("annotated", " "), "methods": F.array("method"), "method_annotations": F.array("method_annotated")})
    return reports.runtime_summary(types, derive(s, d, _CONFIGS), derive(s, d, _BUILDS))
