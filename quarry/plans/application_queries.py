"""Queries of applications: contracts, layers, flows, parse counts, integrity rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import applications as P
from quarry.operators import graph_checks as C
from quarry.operators import records
from quarry.plans.inputs import derive, table
from quarry.plans.registry import query

_OF_NATION = "FROM customer JOIN nation ON c_nationkey = n_nationkey"
#: A contract per customer: tags, guards, checks and words by its key.
_CONTRACTS = f"""
SELECT n_name AS project, 'api/C' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 53 = 0 THEN 'OpenApiConfig' ELSE '' END || '.java' AS file, c_custkey,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'N' || CAST(c_custkey % 40 AS STRING) || 'Api' END AS type_name,
  'a.dto.D' || CAST(c_custkey % 3 AS STRING) || ',a.dto.E1,b.Plain,b.E' || CAST(c_custkey % 4 AS STRING) || ',b.dto.D' || CAST(c_custkey % 3 AS STRING) AS imports,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'contract ' || CASE WHEN c_custkey % 4 = 0 THEN '@Tag( name = "T' || CAST(c_custkey % 20 AS STRING) || '") ' ELSE '' END
    || repeat('@SecurityRequirement(name = "jwt") ', CAST(c_custkey % 3 AS INT)) || CASE WHEN c_custkey % 6 = 0 THEN '@Valid ' ELSE '' END
    || CASE c_custkey % 7 WHEN 0 THEN 'Admin or owner' WHEN 1 THEN 'permitAll' ELSE '' END END AS text
{_OF_NATION}"""
_CALLS = """
SELECT n_name AS project, CASE WHEN o_custkey % 4 = 0 THEN 'T' || CAST(o_custkey % 20 AS STRING) ELSE 'N' || CAST(o_custkey % 40 AS STRING) || 'Api' END AS type_name,
  CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/o/' || CAST(o_orderkey % 3 AS STRING) AS path, o_orderkey AS ord
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_custkey % 8 < 6"""


def _contracts(s, d):  # noqa: ANN001, ANN202
    return derive(s, d, _CONTRACTS).withColumn("imports", F.split("imports", ","))


@query("a13_contracts", f"""
WITH c AS (SELECT c_custkey AS k, n_name AS project, CASE WHEN c_custkey % 4 = 0 THEN 'T' || c_custkey % 20 WHEN c_custkey % 5 = 0 THEN 'API' ELSE 'N' || c_custkey % 40 END AS family {_OF_NATION} WHERE c_custkey % 11 > 0),
e AS (SELECT project, replace(type_name, 'Api', '') AS family, method || ' ' || path AS call, ord FROM ({_CALLS.replace("STRING", "VARCHAR")})),
n AS (SELECT project, family, count(*) AS n FROM e GROUP BY ALL),
f AS (SELECT project, family, string_agg(call, ',' ORDER BY ord) AS samples FROM (SELECT project, family, call, min(ord) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY project, family ORDER BY ord, call) AS rn FROM e) WHERE rn <= 4 GROUP BY ALL) GROUP BY ALL)
SELECT project, k, family, coalesce(n, 0) AS n_endpoints, CAST(k % 3 AS INTEGER) AS n_protected,
  CASE WHEN k % 3 = 0 THEN 'public' WHEN coalesce(n, 0) BETWEEN 1 AND k % 3 THEN 'protected' ELSE 'mixed' END AS auth, coalesce(samples, '') AS samples,
  CASE WHEN k % 3 > 0 THEN 'jwt' ELSE '' END AS schemes, CASE k % 7 WHEN 0 THEN 'owner access,admin access' WHEN 1 THEN 'public access' ELSE '' END AS permissions,
  'D' || k % 3 AS dto_types, CASE k % 4 WHEN 2 THEN 'E1,E2' ELSE 'E1' END AS enum_types, k % 6 = 0 AS validated, k % 4 = 0 AS described
FROM c LEFT JOIN n USING (project, family) LEFT JOIN f USING (project, family)""")
def _(s, d):
    enums = table(s, d, "nation").select(F.col("n_name").alias("project"), F.explode(F.array(F.lit("E1"), F.lit("E2"))).alias("name"))
    out = P.api_surface(_contracts(s, d), derive(s, d, _CALLS), enums)
    out = out.withColumn("k", F.regexp_extract("file", r"C(\d+)", 1).cast("long")).drop("file")
    return out.withColumns({c: F.array_join(c, ",") for c in ("samples", "schemes", "permissions", "dto_types", "enum_types")})


@query("a13_contract_flags", f"""
WITH c AS (SELECT n_name AS project, bool_or(c_custkey % 53 = 0) AS config, bool_or(c_custkey % 6 = 0 AND c_custkey % 11 > 0) AS valid, bool_or(c_custkey % 11 > 0) AS filled {_OF_NATION} GROUP BY 1),
s AS (SELECT n_name AS project, bool_or(s_suppkey % 19 = 0) AS yaml FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT project, CASE WHEN coalesce(yaml, false) THEN 'openapi-generated' WHEN coalesce(filled, false) THEN 'java-contracts' ELSE 'unknown' END AS contract_source, coalesce(config, false) AS swagger, false AS generated, coalesce(valid, false) AS validated
FROM c FULL JOIN s USING (project)""")
def _(s, d):
    files = derive(s, d, "SELECT n_name AS project, s_name || CASE WHEN s_suppkey % 19 = 0 THEN '/openapi.yaml' ELSE '.java' END AS file FROM supplier JOIN nation ON s_nationkey = n_nationkey")
    return P.api_flags(_contracts(s, d), files)


_LAYERED = """
SELECT n_name AS project, CASE c_custkey % 13 WHEN 0 THEN 'family' WHEN 1 THEN 'entry point' WHEN 2 THEN 'cross-cutting' WHEN 3 THEN 'entity' WHEN 4 THEN 'listener' WHEN 5 THEN 'web configuration' WHEN 6 THEN 'security detail' WHEN 7 THEN 'external system' WHEN 8 THEN 'job' WHEN 9 THEN 'event' ELSE 'elsewhere' END AS source,
  CASE c_custkey % 4 WHEN 0 THEN 'Redis ' WHEN 1 THEN 'Notification ' ELSE '' END || c_mktsegment AS item
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_KINDS = "SELECT n_name AS project, CASE s_suppkey % 5 WHEN 0 THEN 'controller' WHEN 1 THEN 'component' WHEN 2 THEN 'listener' WHEN 3 THEN 'domain' ELSE 'record' END AS kind, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_APPS = "SELECT n_name AS project, lower(n_name) || x AS app, o AS ord FROM nation JOIN (SELECT '-backend' AS x, 2 AS o UNION ALL SELECT '-notification', 1 UNION ALL SELECT '-tool', 0) names ON n_nationkey < 20"


@query("a23_layer_items", f"""
WITH l AS (SELECT * FROM (VALUES ('family', 'api'), ('controller', 'api'), ('entry point', 'app'), ('cross-cutting', 'common'), ('event', 'common'), ('component', 'common'), ('entity', 'persistence'), ('domain', 'persistence'),
  ('listener', 'service'), ('job', 'service'), ('listener', 'notification'), ('external system', 'notification'), ('web configuration', 'web'), ('security detail', 'security')) t(source, layer)),
i AS (SELECT project, layer, item FROM ({_LAYERED}) JOIN l USING (source) UNION SELECT project, layer, name FROM ({_KINDS}) k JOIN l ON l.source = k.kind)
SELECT project, app, layer, item FROM i JOIN ({_APPS}) a USING (project)
WHERE CASE WHEN layer = 'common' THEN ord = 2 WHEN layer = 'notification' AND ord <> 1 THEN false WHEN ord = 1 THEN regexp_matches(lower(item), 'notification|redis|ws') WHEN ord = 2 THEN NOT contains(lower(item), 'notification') ELSE true END""")
def _(s, d):
    return P.application_layers(derive(s, d, _LAYERED), derive(s, d, _KINDS), derive(s, d, _APPS))


_TOLD = """
SELECT n_name AS project, o_orderkey AS flow_id, CASE o_orderkey % 5 WHEN 0 THEN 'In ' || n_name || '-TOOL and ' || n_name || '-Backend' WHEN 1 THEN 'some mail' WHEN 2 THEN NULL ELSE '' END AS summary,
  CASE o_orderkey % 3 WHEN 0 THEN n_name || '-notification ' || o_orderpriority WHEN 1 THEN 'mail ' || o_orderpriority ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS trigger
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


@query("a24_flow_apps", f"""
SELECT project, flow_id, CASE WHEN flow_id % 5 = 0 AND n_nationkey < 20 THEN lower(project) || '-tool' WHEN flow_id % 5 = 1 THEN 'mailer' WHEN flow_id % 3 = 0 AND n_nationkey < 20 THEN lower(project) || '-notification' WHEN flow_id % 3 = 1 THEN 'mailer' ELSE 'application' END AS app,
  coalesce(trigger, '') || ' -> ' || name AS label FROM ({_TOLD}) JOIN nation ON n_name = project""")
def _(s, d):
    return P.flows_by_app(derive(s, d, _TOLD), derive(s, d, _APPS), [("mail", "mailer")])


_PARSED = """
SELECT p_brand AS project, 'com.' || lower(p_brand) AS package, 'java.x' || CAST(p_size % 9 AS STRING) || ',java.y' AS imports, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS names,
  p_size * 10 AS nodes, CASE WHEN p_size % 2 = 0 THEN p_size END AS named_nodes, 1 AS types, p_size % 3 AS fields, p_size % 5 AS methods FROM part"""


@query("a30_parse_totals", "SELECT p_brand AS project, count(*) AS files, CAST(sum(p_size * 10) AS BIGINT) AS nodes, CAST(coalesce(sum(p_size) FILTER (WHERE p_size % 2 = 0), 0) AS BIGINT) AS named_nodes, count(*) AS types, CAST(sum(p_size % 3) AS BIGINT) AS fields, CAST(sum(p_size % 5) AS BIGINT) AS methods FROM part GROUP BY 1")
def _(s, d):
    return P.parse_totals(derive(s, d, _PARSED), ["project"])


@query("a30_parse_names", """
SELECT p_brand AS project, 'package' AS part, 'com.' || lower(p_brand) AS name FROM part UNION SELECT p_brand, 'import', 'java.x' || p_size % 9 FROM part
UNION SELECT p_brand, 'import', 'java.y' FROM part UNION SELECT p_brand, 'type', p_type FROM part WHERE p_size % 4 > 0""")
def _(s, d):
    return P.parse_names(derive(s, d, _PARSED).withColumns({"imports": F.split("imports", ","), "type_names": F.array("names")}), ["project"])


@query("a7_annotation_cards", """
WITH m AS (SELECT DISTINCT p_type AS annotation, p_name AS type FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY annotation ORDER BY type) AS rn FROM m)
SELECT annotation, count(*) AS n, string_agg(type, ',' ORDER BY type) FILTER (WHERE rn <= 16) AS first FROM r GROUP BY 1""")
def _(s, d):
    members = P.class_members(table(s, d, "part").select(F.col("p_type").alias("annotation"), F.col("p_name").alias("type")), "annotation", "type")
    return P.class_cards(members, "annotation", "type").withColumn("first", F.array_join("first", ","))


@query("p37_relationships", """
SELECT s_suppkey, CAST(i AS INTEGER) AS ord, CASE WHEN i = 0 THEN 't' || s_suppkey ELSE 'source_table' END AS from_table, 'source_column' AS from_column, 'u' AS to_table, CASE WHEN i = 0 THEN 'target_column' ELSE 'id' END AS to_column,
  CASE WHEN i = 0 THEN '1:1' ELSE 'N:1' END AS cardinality, CASE WHEN i = 1 THEN 'held' END AS description FROM supplier, range(2) t(i) WHERE s_suppkey % 3 > 0""")
def _(s, d):
    one = F.concat(F.lit('{"relationships":[{"fromTable":"t'), F.col("s_suppkey").cast("string"), F.lit('","fromColumn":" ","toTable":"u","cardinality":"1:1"},{"toTable":" u ","toColumn":"id","description":"held"}]}'))
    j = F.when(F.col("s_suppkey") % 3 > 0, one).when(F.col("s_suppkey") % 2 == 0, F.lit('{"relationships":[]}')).otherwise(F.lit("no json"))
    return records.normalize_relationships(table(s, d, "supplier").select("s_suppkey", j.alias("j")), "j", ["s_suppkey"])


#: Customers as nodes of ten types in rings of ten; every third ring has no links.
_RING = """
SELECT 'c' || CAST(c_custkey AS STRING) AS id, CASE c_custkey % 10 WHEN 0 THEN 'Process' WHEN 1 THEN 'Interface' WHEN 2 THEN 'DataFlow' WHEN 3 THEN 'Transformation' WHEN 4 THEN 'SecurityPolicy' WHEN 5 THEN 'Rule'
  WHEN 6 THEN 'Dependency' WHEN 7 THEN 'Issue' WHEN 8 THEN 'AcceptanceCriterion' ELSE 'Metric' END AS type, c_custkey % 17 = 0 AS external, c_custkey % 10 = 2 AS monitored FROM customer"""
_RING_EDGES = """
SELECT 'e' || CAST(c_custkey AS STRING) || '-' || CAST(step AS STRING) AS id, 'c' || CAST(c_custkey AS STRING) AS src, CASE WHEN step = 9 THEN 'e' || CAST(c_custkey - 2 AS STRING) || '-1' ELSE 'c' || CAST(c_custkey - step AS STRING) END AS dst
FROM customer JOIN (SELECT 3 AS place, 1 AS step UNION ALL SELECT 1, 1 UNION ALL SELECT 2, -1 UNION ALL SELECT 5, 1 UNION ALL SELECT 6, 6 UNION ALL SELECT 7, 9 UNION ALL SELECT 8, 8 UNION ALL SELECT 9, 7) steps ON c_custkey % 10 = place
WHERE c_custkey % 30 >= 10 AND c_custkey >= 10"""


@query("g6_integrity", f"""
WITH n AS (SELECT * FROM ({_RING})), b AS (SELECT id, src, dst FROM ({_RING_EDGES})),
l AS (SELECT b.src AS id, n.type, 'out' AS way FROM b JOIN (SELECT id, type FROM n UNION ALL SELECT id, 'Edge' FROM b) n ON b.dst = n.id UNION ALL SELECT b.dst, n.type, 'in' FROM b JOIN n ON b.src = n.id)
SELECT 'process without interface, data flow or dependency' AS rule, id AS node FROM n WHERE type = 'Process' AND id NOT IN (SELECT id FROM l WHERE type IN ('Interface', 'DataFlow', 'Dependency'))
UNION ALL SELECT 'transformation without input flow', id FROM n WHERE type = 'Transformation' AND id NOT IN (SELECT id FROM l WHERE way = 'in' AND type = 'DataFlow')
UNION ALL SELECT 'transformation without output flow', id FROM n WHERE type = 'Transformation' AND id NOT IN (SELECT id FROM l WHERE way = 'out' AND type = 'DataFlow')
UNION ALL SELECT 'security policy without rule or issue', id FROM n WHERE type = 'SecurityPolicy' AND id NOT IN (SELECT id FROM l WHERE type IN ('Rule', 'Issue'))
UNION ALL SELECT 'dependency without user', id FROM n WHERE type = 'Dependency' AND id NOT IN (SELECT id FROM l WHERE type IN ('Process', 'Interface'))
UNION ALL SELECT 'issue without cause', id FROM n WHERE type = 'Issue' AND id NOT IN (SELECT id FROM l WHERE way = 'out')
UNION ALL SELECT 'acceptance criterion without intent or process', id FROM n WHERE type = 'AcceptanceCriterion' AND id NOT IN (SELECT id FROM l WHERE type IN ('Intent', 'Process'))
UNION ALL SELECT 'monitored concern without monitor, metric or alert', id FROM n WHERE monitored AND id NOT IN (SELECT id FROM l WHERE type IN ('Monitor', 'Metric', 'Alert'))
UNION ALL SELECT 'external integration of another type', id FROM n WHERE external AND type <> 'Dependency'""")
def _(s, d):
    return C.integrity_violations(derive(s, d, _RING), derive(s, d, _RING_EDGES))


_USERS = """
SELECT c_custkey AS doc_id, 'proc' AS id, 'Process' AS type, 'Write to ' || c_mktsegment || ' Registry' AS name FROM customer
UNION ALL SELECT c_custkey, 'short', 'Process', 'postgres' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'dep', 'Dependency', lower(c_mktsegment) || ' registry' FROM customer
UNION ALL SELECT c_custkey, 'db', 'Persistence', 'Postgres database' FROM customer
UNION ALL SELECT c_custkey, 'svc', 'Service', 'service' FROM customer WHERE c_custkey % 3 = 0"""


@query("g2_dependency_edges", """
SELECT c_custkey AS doc_id, 'proc' AS src, 'dep' AS dst, 'dependsOn' AS type FROM customer UNION ALL SELECT c_custkey, 'short', 'db', 'writesTo' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'svc', 'dep', 'dependsOn' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'svc', 'db', 'writesTo' FROM customer WHERE c_custkey % 3 = 0""")
def _(s, d):
    return C.dependency_edges(derive(s, d, _USERS))


@query("j26_persistence", "SELECT DISTINCT CASE WHEN c_custkey % 5 = 3 THEN c_mktsegment || 'Store' ELSE c_mktsegment END || ' persistence' AS process FROM customer WHERE c_custkey % 5 IN (0, 1, 3)")
def _(s, d):
    names = "SELECT c_mktsegment || CASE c_custkey % 5 WHEN 0 THEN 'Repository' WHEN 1 THEN 'repo' WHEN 2 THEN 'Service' ELSE 'Store' END AS name, CASE c_custkey % 5 WHEN 3 THEN 'JpaRepository' ELSE 'Class' END AS type FROM customer UNION ALL SELECT 'Repo', 'Class' FROM region"
    return C.persistence_processes(derive(s, d, names))


_FOUND = """
SELECT o_custkey AS doc_id, 'data_flows' AS section, 'document' AS source, o_orderpriority || ' flow' AS line, o_orderkey AS ord FROM orders
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'processes' ELSE 'data_flows' END, 'graph', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' persistence' ELSE '1-URGENT flow' END, c_nationkey FROM customer
UNION ALL SELECT c_custkey, 'processes', 'graph', '', 0 FROM customer"""
_STANDING = "SELECT c_custkey AS doc_id, 'data_flows' AS section, '- 2-HIGH flow' || chr(10) || '*  own line' || chr(10) || chr(10) || 'own line' AS text FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'processes', NULL FROM customer"


@query("u2_flow_sections", f"""
WITH u AS (SELECT doc_id, section, line, CASE source WHEN 'document' THEN 1 ELSE 2 END AS rank, ord FROM ({_FOUND}) WHERE line <> ''
  UNION ALL SELECT c_custkey, 'data_flows', unnest(['2-HIGH flow', 'own line']), 3, unnest([0, 1]) FROM customer WHERE c_custkey % 3 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section, line ORDER BY rank, ord) AS rn FROM u),
o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, section ORDER BY rank, ord, line) - 1) // 3 AS part FROM f WHERE rn = 1)
SELECT doc_id, section, CAST(part AS INTEGER) AS part, string_agg('- ' || line, chr(10) ORDER BY rank, ord, line) AS text FROM o GROUP BY ALL""")
def _(s, d):
    return P.section_parts(P.flow_lines(derive(s, d, _FOUND), derive(s, d, _STANDING)), most=3)


@query("u2_flow_sources", f"""
WITH u AS (SELECT doc_id, section, line, CASE source WHEN 'document' THEN 1 ELSE 2 END AS rank FROM ({_FOUND}) WHERE line <> '' UNION ALL SELECT c_custkey, 'data_flows', unnest(['2-HIGH flow', 'own line']), 3 FROM customer WHERE c_custkey % 3 = 0),
m AS (SELECT min(rank) AS rank FROM u GROUP BY doc_id, section, line) SELECT CASE rank WHEN 1 THEN 'document' WHEN 2 THEN 'graph' ELSE 'section' END AS source, count(*) AS n FROM m GROUP BY 1""")
def _(s, d):
    return P.flow_lines(derive(s, d, _FOUND), derive(s, d, _STANDING)).groupBy("source").agg(F.count("*").alias("n"))
