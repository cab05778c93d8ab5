"""Queries of the support graph, containment, cards and the table ladder."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import schema
from quarry.operators import support_graph as S
from quarry.plans.inputs import derive
from quarry.plans.registry import query

_PARTS = {
    "projects": "SELECT r_name AS project FROM region UNION ALL SELECT 'bare'",
    "layouts": "SELECT r_name AS project, 'apps/' || n_name AS app_root, 'role ' || CAST(n_nationkey % 3 AS STRING) AS role, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey",
    "layers": "SELECT r_name AS project, n_name AS app, c_mktsegment AS layer, 'item ' || CAST(c_custkey % 60 AS STRING) AS item, c_custkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "modules": "SELECT r_name AS project, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'apps/' || n_name WHEN 2 THEN 'x-' || n_name ELSE 'none' END AS parent, s_name AS module, s_suppkey AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "packages": "SELECT r_name AS project, n_name AS app, 'com.' || lower(c_mktsegment) || '.' || CAST(c_custkey % 9 AS STRING) AS package, c_custkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0",
    "flows": "SELECT r_name AS project, CASE WHEN o_custkey % 10 = 0 THEN 'loose' ELSE n_name END AS app, o_orderpriority || ' by ' || CAST(o_custkey % 40 AS STRING) AS flow, o_orderkey AS ord FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "externals": "SELECT r_name AS project, CASE s_suppkey % 3 WHEN 0 THEN 'Mail Server' WHEN 1 THEN 'mail server' ELSE 'Bus ' || CAST(s_suppkey % 7 AS STRING) END AS system FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
}
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_GRAPH_SQL = f"""
{", ".join(f"{k} AS ({sql})" for k, sql in _PARTS.items())},
apps AS (SELECT project, split_part(app_root, '/', 2) AS app, 'application:' || {_SLUG.format("app_root")} AS app_id, role, ord FROM layouts),
facts AS (
  SELECT project, app_id, 'layer' AS part, layer AS label, item, layers.ord FROM layers JOIN apps a USING (project, app)
  UNION ALL SELECT m.project, app_id, 'module-group', 'modules', module, m.ord FROM modules m JOIN apps a ON a.project = m.project AND m.parent LIKE '%' || a.app
  UNION ALL SELECT project, app_id, 'package-group', 'package slices', package, packages.ord FROM packages JOIN apps USING (project, app)
  UNION ALL SELECT project, coalesce(app_id, 'application:' || {_SLUG.format("app")}), 'flow-group', app || ' flows', flow, flows.ord FROM flows LEFT JOIN apps USING (project, app)),
it AS (SELECT project, app_id, part, label, item, min(ord) AS ord FROM facts GROUP BY ALL),
gr AS (SELECT *, CASE part WHEN 'layer' THEN app_id || ':layer:' || {_SLUG.format("label")} ELSE app_id || ':' || replace(part, '-group', '') || 's' END AS id FROM it),
nodes AS (
  SELECT project, 'project:' || {_SLUG.format("project")} AS id, 'project' AS type, project AS name, (SELECT count(DISTINCT app_id) FROM (SELECT project, app_id FROM apps UNION SELECT project, app_id FROM it) z WHERE z.project = p.project) AS n_items, '' AS items FROM (SELECT DISTINCT project FROM projects) p
  UNION ALL SELECT project, app_id, 'application', app, (SELECT count(*) FROM it WHERE it.project = apps.project AND it.app_id = apps.app_id), '' FROM apps
  UNION ALL SELECT project, id, part, label, count(*), string_agg(item, ',' ORDER BY ord, item) FILTER (WHERE rn <= 20) FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY ord, item) AS rn FROM gr) GROUP BY project, id, part, label
  UNION ALL SELECT project, 'external:' || {_SLUG.format("system")}, 'external-system', min(system), 0, '' FROM externals GROUP BY project, {_SLUG.format("system")})"""


def _graph(s, d):  # noqa: ANN001, ANN202
    p = {k: derive(s, d, sql) for k, sql in _PARTS.items()}
    return S.support_graph(S.support_facts(p["layouts"], p["layers"], p["modules"], p["packages"], p["flows"]), p["externals"], p["projects"])


@query("g5_support_nodes", f"WITH {_GRAPH_SQL} SELECT project, id, type, name, CAST(n_items AS BIGINT) AS n_items, items FROM nodes")
def _(s, d):
    return _graph(s, d)[0].select("project", "id", "type", "name", "n_items", F.array_join("items", ",").alias("items"))


@query("g5_support_edges", f"""
WITH {_GRAPH_SQL} SELECT project, 'project:' || {_SLUG.format("project")} AS src, id AS dst, CASE type WHEN 'application' THEN 'contains' ELSE 'communicates-with' END AS type FROM nodes WHERE type IN ('application', 'external-system')
UNION ALL SELECT DISTINCT project, app_id, id, 'contains' FROM gr""")
def _(s, d):
    return _graph(s, d)[1]


#: A containment of regions, nations, customers and orders, with ways back and one more parent of some customers.
_TREE_NODES = """
SELECT 'r' || CAST(r_regionkey AS STRING) AS id, 'application' AS type, r_name AS name, 'x' AS item FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 4 = 0 THEN 'folder' ELSE 'application' END, n_name, n_name FROM nation
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'layer', c_mktsegment, 'made by ' || CAST(c_custkey % 31 AS STRING) FROM customer UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'module-group', o_orderpriority, o_orderstatus || CAST(o_orderkey % 50 AS STRING) FROM orders"""
_TREE_EDGES = """
SELECT 'r' || CAST(n_regionkey AS STRING) AS src, 'n' || CAST(n_nationkey AS STRING) AS dst, 'contains' AS type FROM nation UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING), 'contains' FROM customer
UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING), 'contains' FROM orders UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), 'contains' FROM customer WHERE c_custkey % 20 = 0
UNION ALL SELECT 'r' || CAST(c_nationkey % 5 AS STRING), 'c' || CAST(c_custkey AS STRING), 'contains' FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'r0', 'uses' FROM customer"""
_NEAR_SQL = f"""
t AS ({_TREE_NODES}), e AS (SELECT DISTINCT src, dst FROM ({_TREE_EDGES}) WHERE type = 'contains'), heads AS (SELECT id FROM t WHERE type = 'application'),
w AS (SELECT id, id AS container, 0 AS depth, id AS path FROM heads
  UNION ALL SELECT e.dst, w.container, w.depth + 1, w.path || ' > ' || e.dst FROM w JOIN e ON e.src = w.id WHERE e.dst NOT IN (SELECT id FROM heads) AND NOT contains(' > ' || w.path || ' > ', ' > ' || e.dst || ' > ')),
near AS (SELECT id, container, depth, path FROM w WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, container, path) = 1)"""


@query("j27_nearest_containers", f"WITH RECURSIVE {_NEAR_SQL} SELECT * FROM near")
def _(s, d):
    return S.nearest_containers(derive(s, d, _TREE_NODES), derive(s, d, _TREE_EDGES), "application")


@query("j27_container_cards", f"""
WITH RECURSIVE {_NEAR_SQL}, i AS (SELECT a.name AS app, lower(t.name) AS card, t.item, min(t.id) AS pos FROM t JOIN near USING (id) JOIN t a ON a.id = container WHERE t.type IN ('layer', 'module-group') GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY app, card ORDER BY pos, item) AS rn FROM i)
SELECT app, card, count(*) AS n_items, string_agg(item, ',' ORDER BY rn) FILTER (WHERE rn <= 20) AS items FROM p GROUP BY ALL""")
def _(s, d):
    nodes = derive(s, d, _TREE_NODES).withColumn("items", F.array("item"))
    return S.cards(nodes, derive(s, d, _TREE_EDGES), ["layer", "module-group"]).withColumn("items", F.array_join("items", ","))


_GRAPH_ITEMS = "SELECT n_name AS app, 'Layers' AS card, c_mktsegment AS item, c_custkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'Modules', s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_DOSSIER_ITEMS = "SELECT n_name AS app, 'Layers' AS card, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'tier ' || CAST(c_custkey % 30 AS STRING) END AS item, c_custkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey"
_SUMMARY_ITEMS = "SELECT n_name AS app, 'Flows' AS card, o_orderpriority AS item, o_orderkey AS ord FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'Modules', '', 1 FROM nation"


@query("a36_merged_cards", f"""
WITH u AS (SELECT *, 0 AS rank FROM ({_GRAPH_ITEMS}) UNION ALL SELECT *, 1 FROM ({_DOSSIER_ITEMS}) UNION ALL SELECT *, 2 FROM ({_SUMMARY_ITEMS})),
i AS (SELECT app, card, item, min((rank, ord)) AS pos FROM u WHERE item <> '' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY app, card ORDER BY pos, item) AS rn FROM i)
SELECT app, card, count(*) AS n_items, string_agg(item, ',' ORDER BY rn) FILTER (WHERE rn <= 20) AS items FROM p GROUP BY ALL""")
def _(s, d):
    return S.application_cards([derive(s, d, x) for x in (_GRAPH_ITEMS, _DOSSIER_ITEMS, _SUMMARY_ITEMS)]).withColumn("items", F.array_join("items", ","))


_LADDER = {
    "docs": "SELECT c_custkey AS doc_id, c_name AS title, CASE c_custkey % 9 WHEN 0 THEN 'holds the sales ledger' WHEN 1 THEN 'a user writes notes' WHEN 2 THEN 'big jobs' ELSE 'plain words' END AS text FROM customer",
    "explicit": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 14 = 0 THEN 'declared' ELSE 'own_' || lower(c_mktsegment) END AS table_name FROM customer WHERE c_custkey % 7 = 0",
    "hints": "SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN 'Sales Ledger' WHEN 1 THEN 'notes' ELSE 'unseen ' || n_name END AS hint FROM nation",
    "items": "SELECT c_custkey AS doc_id, CASE c_custkey % 2 WHEN 0 THEN 'dependencies' ELSE 'examples' END AS section, c_custkey AS item_ord, CASE c_custkey % 5 WHEN 0 THEN 'keeps invoices' WHEN 1 THEN 'calls payment' ELSE 'nothing' END AS item FROM customer WHERE c_custkey % 3 = 0",
    "nodes": "SELECT c_custkey AS doc_id, CASE WHEN c_nationkey % 3 = 0 THEN 'Entity' ELSE 'Process' END AS type, CASE c_nationkey % 4 WHEN 0 THEN 'Order Store' WHEN 1 THEN c_mktsegment || ' item' ELSE 'sessions here' END AS name, c_custkey AS ord FROM customer WHERE c_custkey % 4 = 1",
}


_WORDS = "CASE WHEN contains({0}, 'note') THEN 'notes' WHEN contains({0}, 'user') THEN 'users' WHEN contains({0}, 'session') THEN 'sessions' WHEN contains({0}, 'order') THEN 'orders' WHEN contains({0}, 'payment') THEN 'payments' WHEN contains({0}, 'invoice') THEN 'invoices' END"


@query("v1_table_ladder", f"""
WITH {", ".join(f"{k} AS ({sql})" for k, sql in _LADDER.items())},
free AS (SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM explicit)),
hint AS (SELECT doc_id, replace(lower(h.hint), ' ', '_') AS table_name FROM free JOIN hints h ON contains(text, lower(h.hint))),
kw AS (SELECT doc_id, 'notes' AS table_name FROM free WHERE contains(text, 'notes') UNION ALL SELECT doc_id, 'users' FROM free WHERE contains(text, 'user') UNION ALL SELECT doc_id, 'tasks' FROM free WHERE contains(text, 'jobs')),
dep AS (SELECT f.doc_id, {_WORDS.format("item")} AS table_name FROM free f JOIN items i ON i.doc_id = f.doc_id WHERE section = 'dependencies'),
gr AS (SELECT f.doc_id, coalesce({_WORDS.format("lower(name)")}, replace(lower(name), ' ', '_')) AS table_name FROM free f JOIN nodes n ON n.doc_id = f.doc_id WHERE type = 'Entity' OR contains(name, 'Store')),
mn AS (SELECT doc_id, arg_min(t, rank) AS table_name FROM (
    SELECT doc_id, 0 AS rank, {_WORDS.format("item")} AS t FROM items WHERE section = 'examples' UNION ALL SELECT doc_id, 2, {_WORDS.format("item")} FROM items WHERE section = 'dependencies' UNION ALL SELECT doc_id, 3, {_WORDS.format("lower(name)")} FROM nodes
    UNION ALL SELECT doc_id, 4, {_WORDS.format("lower(title)")} FROM docs UNION ALL SELECT doc_id, 5, {_WORDS.format("text")} FROM docs) WHERE t IS NOT NULL AND doc_id IN (SELECT doc_id FROM free) GROUP BY 1),
u AS (SELECT *, 'explicit' AS evidence, 0 AS rank FROM explicit UNION ALL SELECT *, 'keyword', 1 FROM kw UNION ALL SELECT *, 'hint', 2 FROM hint UNION ALL SELECT *, 'dependency', 3 FROM dep UNION ALL SELECT *, 'graph', 4 FROM gr UNION ALL SELECT *, 'main', 5 FROM mn),
k AS (SELECT doc_id, table_name, arg_min(evidence, rank) AS evidence FROM u WHERE table_name IS NOT NULL GROUP BY ALL)
SELECT * FROM k UNION ALL SELECT doc_id, 'domain_record', 'fallback' FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def _(s, d):
    p = {k: derive(s, d, sql) for k, sql in _LADDER.items()}
    return schema.table_ladder(p["docs"], p["explicit"], p["hints"], p["items"], p["nodes"])
