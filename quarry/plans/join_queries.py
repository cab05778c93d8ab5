"""Queries of the linking, set and flow operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import names as N
from quarry.operators import flows
from quarry.operators import linking as L
from quarry.operators import relational as R
from quarry.plans.inputs import EDGES, ENDPOINTS, NODES, STEP_EDGES, STEPS, derive, table
from quarry.plans.registry import query

_PATHS = "SELECT n_nationkey, r_name || '.' || n_name || '.leaf' AS path FROM nation JOIN region ON n_regionkey = r_regionkey"
_ROOTS = "SELECT r_name AS root, 2 AS ord FROM region UNION ALL SELECT r_name || '.' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0"


@query("j7_prefix_join", f"""
SELECT c_custkey, root FROM customer JOIN ({_PATHS}) p ON c_nationkey = n_nationkey JOIN ({_ROOTS}) r ON path = root OR starts_with(path, root || '.')
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ord) = 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    left = table(s, d, "customer").join(derive(s, d, _PATHS), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "path")
    return L.prefix_join(left, derive(s, d, _ROOTS), "path", "root", ".", ["ord"], ["c_custkey"]).select("c_custkey", "root")


_NEEDLES = "SELECT DISTINCT lower(c_mktsegment) AS needle FROM customer UNION SELECT DISTINCT substr(p_name, 1, 3) FROM part"


@query("j8_contains_join", f"""
WITH a AS (SELECT DISTINCT p_name FROM part), b AS ({_NEEDLES})
SELECT p_name, needle FROM a, b WHERE contains(lower(p_name), needle) OR contains(needle, lower(p_name))""")
def _(s, d):
    return L.contains_either(table(s, d, "part").select("p_name").distinct(), derive(s, d, _NEEDLES), "p_name", "needle").select("p_name", "needle")


@query("j9_contains_first", f"""
WITH b AS (SELECT needle, row_number() OVER (ORDER BY needle) AS ord FROM ({_NEEDLES}))
SELECT p_partkey, needle FROM part JOIN b ON contains(lower(p_name), needle) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY ord) = 1""")
def _(s, d):
    names = table(s, d, "part").select("p_name").distinct()
    first = R.first_match(L.contains_pairs(names, derive(s, d, _NEEDLES), "p_name", "needle"), ["p_name"], ["needle"])
    return table(s, d, "part").join(first, "p_name").select("p_partkey", "needle")


@query("j10_round_robin", """
WITH l AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS j, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT c_custkey, s_suppkey FROM l JOIN r ON c_nationkey = s_nationkey AND j = (i + 1) % n""")
def _(s, d):
    left = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    right = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return R.round_robin(left, right, ["c_custkey"], ["s_suppkey"], "nation", 1).select("c_custkey", "s_suppkey")


@query("j11_cross_edges", """
WITH n AS (SELECT n_regionkey, n_nationkey FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 3)
SELECT a.n_regionkey AS region, a.n_nationkey AS src, b.n_nationkey AS dst, 'guards' AS type FROM n a JOIN nation b USING (n_regionkey)""")
def _(s, d):
    from quarry.operators.graph import cross_edges

    n = table(s, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("id"))
    return cross_edges(n, n, "region", "guards", ["id"], 3)


@query("j12_resolve_name", """
WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || 'Service' END AS ref FROM supplier),
n AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS name FROM supplier)
SELECT r.s_suppkey, node FROM r JOIN n ON lower(ref) = lower(name) OR regexp_replace(lower(ref), 'service$', '') = lower(name) OR lower(ref) = regexp_replace(lower(name), 'service$', '')
QUALIFY row_number() OVER (PARTITION BY r.s_suppkey ORDER BY node) = 1""")
def _(s, d):
    t = table(s, d, "supplier")
    refs = t.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("Service"))).alias("ref"))
    nodes = t.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 3 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("name"))
    return L.resolve_name(refs, nodes, "ref", "name", ["node"], ["s_suppkey"]).select("s_suppkey", "node")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= 3))"


@query("j13_token_overlap", f"""
WITH b AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS t FROM benchmark), p AS (SELECT DISTINCT conv_id, t FROM (SELECT conv_id, unnest({_TOKENS.format('text')}) AS t FROM conversations WHERE turn = 0)),
o AS (SELECT item_id, conv_id, 2 * count(*) + CASE WHEN conv_id % 10 = 0 THEN 4 ELSE 0 END AS score FROM b JOIN p USING (t) GROUP BY item_id, conv_id)
SELECT item_id, conv_id, score FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id) <= 2""")
def _(s, d):
    items, talks = table(s, d, "benchmark").select("item_id", "text"), table(s, d, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("said"))
    pairs = L.token_overlap(items, talks, "item_id", "conv_id", "text", "said")
    scored = pairs.withColumn("score", 2 * F.col("overlap") + F.when(F.col("conv_id") % 10 == 0, 4).otherwise(0))
    return R.top_k(scored, ["item_id"], [F.desc("score"), "conv_id"], 2).select("item_id", "conv_id", "score")


ENTRIES = """
SELECT item_id AS entry_id, text AS name, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS trigger,
  upper(substr(split_part(text, ' ', 1), 1, 1)) || substr(split_part(text, ' ', 1), 2) || 'Controller' AS target, 'asked by a user' AS notes FROM benchmark"""
OPERATIONS = """
SELECT upper(substr(w1, 1, 1)) || substr(w1, 2) || 'Service' AS service, role || ' turns' AS service_purpose, w2 AS operation, text AS purpose, CAST(NULL AS STRING) AS input, conv_id * 1000 + turn AS ord
FROM (SELECT *, split_part(coalesce(text, ''), ' ', 1) AS w1, split_part(coalesce(text, ''), ' ', 2) AS w2 FROM conversations) c"""
CALLS = """
SELECT DISTINCT upper(substr(split_part(text, ' ', 1), 1, 1)) || substr(split_part(text, ' ', 1), 2) || 'Controller' AS caller,
  upper(substr(split_part(text, ' ', 4), 1, 1)) || substr(split_part(text, ' ', 4), 2) || 'ServiceImpl' AS callee FROM benchmark"""
IMPLS = """
SELECT DISTINCT upper(substr(w1, 1, 1)) || substr(w1, 2) || 'Service' AS service, upper(substr(w2, 1, 1)) || substr(w2, 2) || 'ServiceImpl' AS impl
FROM (SELECT conv_id, split_part(coalesce(text, ''), ' ', 1) AS w1, split_part(coalesce(text, ''), ' ', 3) AS w2 FROM conversations) c WHERE conv_id % 2 = 0"""


@query("j13_match_services", f"""
WITH e AS (SELECT *, {_TOKENS.format("name || ' ' || trigger || ' ' || target || ' ' || notes")} AS et FROM ({ENTRIES})),
o AS (SELECT *, regexp_replace(service, 'Service$', '') AS stem, {_TOKENS.format("service || ' ' || service_purpose")} AS st, {_TOKENS.format("operation || ' ' || coalesce(purpose, '')")} AS ot FROM ({OPERATIONS})),
ec AS (SELECT entry_id, list(DISTINCT callee) AS callees FROM e JOIN ({CALLS}) c ON caller = target GROUP BY 1), im AS (SELECT service, list(impl) AS impls FROM ({IMPLS}) GROUP BY 1),
p AS (
  SELECT e.entry_id, o.service, operation, ord, 2 * len(list_intersect(et, st)) + 3 * len(list_intersect(et, ot)) + CASE WHEN list_contains(et, lower(stem)) THEN 4 ELSE 0 END
    + CASE WHEN operation <> '' AND contains(lower(trigger), lower(operation)) THEN 5 ELSE 0 END + CASE WHEN stem <> '' AND contains(lower(target), lower(stem)) THEN 3 ELSE 0 END
    + CASE WHEN len(list_filter(coalesce(callees, []), lambda c: contains(o.service, c) OR (stem <> '' AND contains(c, stem)) OR list_contains(coalesce(impls, []), c))) > 0 THEN 8 ELSE 0 END AS score
  FROM e CROSS JOIN o LEFT JOIN ec ON ec.entry_id = e.entry_id LEFT JOIN im ON im.service = o.service)
SELECT entry_id, service, operation, ord, CAST(score AS BIGINT) AS score FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, ord) <= 2""")
def _(s, d):
    return L.match_services(*(derive(s, d, sql) for sql in (ENTRIES, OPERATIONS, CALLS, IMPLS)))


@query("j14_cascade_match", """
WITH o AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'),
n AS (SELECT c_custkey AS c, min(s_suppkey) AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1),
r AS (SELECT c_custkey AS c, -1 AS s FROM customer),
u AS (SELECT *, 1 AS tier FROM o UNION ALL SELECT *, 2 FROM n UNION ALL SELECT *, 3 FROM r)
SELECT c, s, tier FROM u QUALIFY tier = min(tier) OVER (PARTITION BY c)""")
def _(s, d):
    orders, lines, cust, supp = (table(s, d, t) for t in ("orders", "lineitem", "customer", "supplier"))
    one = orders.where("o_orderpriority = '1-URGENT'").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).distinct()
    two = cust.join(supp.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s")), F.col("c_nationkey") == F.col("s_nationkey")).select(F.col("c_custkey").alias("c"), "s")
    three = cust.select(F.col("c_custkey").alias("c"), F.lit(-1).cast("long").alias("s"))
    return R.cascade_match([one, two, three], "c")


@query("j15_coverage", """
SELECT 'customers' AS category, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'parts', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def _(s, d):
    a = R.coverage(table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")), "id", "customers")
    return a.union(R.coverage(table(s, d, "part").select(F.col("p_partkey").alias("id")), table(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id")), "id", "parts"))


@query("j16_supplement", """
WITH b AS (SELECT c_custkey AS target, 'base' AS origin FROM customer WHERE c_custkey % 2 = 0), e AS (SELECT DISTINCT o_custkey AS target, 'extra' AS origin FROM orders)
SELECT * FROM b UNION ALL SELECT * FROM e WHERE target NOT IN (SELECT target FROM b)""")
def _(s, d):
    base = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("target"), F.lit("base").alias("origin"))
    extra = table(s, d, "orders").select(F.col("o_custkey").alias("target"), F.lit("extra").alias("origin")).distinct()
    return flows.supplement(base, extra, "target")


_KINDS = "SELECT DISTINCT lower(c_mktsegment) AS needle FROM customer UNION SELECT DISTINCT lower(p_type) FROM part"


@query("j17_align", f"""
WITH a AS (SELECT DISTINCT p_name AS x FROM part), b AS ({_KINDS}), m AS (SELECT x, needle FROM a, b WHERE contains(lower(x), needle) OR contains(needle, lower(x)))
SELECT 'matched' AS status, x AS name FROM (SELECT DISTINCT x FROM m) UNION ALL SELECT 'doc_only', x FROM a WHERE x NOT IN (SELECT x FROM m) UNION ALL SELECT 'code_only', needle FROM b WHERE needle NOT IN (SELECT needle FROM m)""")
def _(s, d):
    return L.align(table(s, d, "part").select(F.col("p_name").alias("x")).distinct(), derive(s, d, _KINDS), "x", "needle")


_CODE_NAMES = """
SELECT replace(p_name, ' ', '') || CASE p_partkey % 5 WHEN 0 THEN 'Service' WHEN 1 THEN 'Manager' WHEN 2 THEN '.java' ELSE 'Helper' END AS code_name FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 2 WHEN 0 THEN 'Controller' ELSE 'Tool' END FROM supplier UNION ALL SELECT n_name || '.x.y' FROM nation"""
_DOC_NAMES = "SELECT replace(p_name, ' ', '') AS doc_name FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'the ' || n_name || ' page' FROM nation UNION ALL SELECT c_mktsegment FROM customer"


@query("j17_align_components", f"""
WITH a AS (SELECT DISTINCT lower(doc_name) AS x FROM ({_DOC_NAMES})), b AS (SELECT DISTINCT lower(code_name) AS y FROM ({_CODE_NAMES})), m AS (SELECT x, y FROM a, b WHERE contains(y, x) OR contains(x, split_part(y, '.', 1)))
SELECT 'matched' AS status, x AS name FROM (SELECT DISTINCT x FROM m) UNION ALL SELECT 'doc_only', x FROM a WHERE x NOT IN (SELECT x FROM m)
UNION ALL SELECT 'code_only', y FROM b WHERE y NOT IN (SELECT y FROM m) AND regexp_matches(y, '(service|controller|repository|handler|manager)$')""")
def _(s, d):
    return L.align_components(derive(s, d, _DOC_NAMES), derive(s, d, _CODE_NAMES), "doc_name", "code_name")


@query("j20_broken_edges", f"""
WITH p AS (SELECT trace_id, node AS src, lead(node) OVER (PARTITION BY trace_id ORDER BY step_ord) AS dst FROM ({STEPS})), e AS ({STEP_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
SELECT trace_id, src, dst FROM p WHERE dst IS NOT NULL AND (src, dst) NOT IN (SELECT (src, dst) FROM b WHERE dst <> 'error')""")
def _(s, d):
    edges = derive(s, d, STEP_EDGES)
    both = edges.union(edges.select("dst", "src")).distinct().where("dst <> 'error'")
    pairs = R.step_pairs(derive(s, d, STEPS), ["trace_id"], ["step_ord"], "node").select("trace_id", F.col("node").alias("src"), F.col("next_node").alias("dst"))
    return pairs.join(both, ["src", "dst"], "left_anti").select("trace_id", "src", "dst")


@query("j21_missing_nodes", f"SELECT trace_id, node FROM ({STEPS}) WHERE node NOT IN ('view', 'click', 'signup')")
def _(s, d):
    nodes = table(s, d, "events").where("event_type IN ('view', 'click', 'signup')").select(F.col("event_type").alias("id"), F.upper("event_type").alias("name")).distinct()
    return flows.missing_nodes(derive(s, d, STEPS), nodes, "trace_id")


@query("j22_longest_price_key", """
WITH m AS (SELECT DISTINCT p_partkey, lower(p_type) || '-' || lower(p_brand) AS model FROM part)
SELECT p_partkey, CASE WHEN contains(model, 'economy-brand#1') THEN 'economy-brand#1' WHEN contains(model, 'economy') THEN 'economy' WHEN contains(model, 'small') THEN 'small' ELSE 'default' END AS price_key FROM m""")
def _(s, d):
    usage = table(s, d, "part").select("p_partkey", F.concat_ws("-", F.lower("p_type"), F.lower("p_brand")).alias("model"))
    prices = s.sql("SELECT * FROM (VALUES ('economy'), ('economy-brand#1'), ('small'), ('default')) AS t(price_key)")
    return L.longest_key(usage, prices, "model", "price_key", "default").select("p_partkey", "price_key")


@query("j23_merge_evidence", """
WITH c AS (SELECT c_nationkey AS k, min(c_name) AS label, bool_or(c_acctbal < 0) AS flag, list_sort(list(DISTINCT c_mktsegment)) AS items FROM customer WHERE c_nationkey < 18 GROUP BY 1),
p AS (SELECT s_nationkey AS k, min(s_name) AS label, bool_or(s_acctbal < 500) AS flag, list_sort(list(DISTINCT 'S' || CAST(s_suppkey % 3 AS VARCHAR))) AS items FROM supplier GROUP BY 1)
SELECT coalesce(c.k, p.k) AS k, coalesce(c.label, p.label) AS label, coalesce(c.flag, false) OR coalesce(p.flag, false) AS flag, array_to_string(list_sort(list_concat(coalesce(c.items, []), coalesce(p.items, []))), ',') AS items FROM c FULL JOIN p ON c.k = p.k""")
def _(s, d):
    part = lambda df, k, name, flag, item: df.groupBy(F.col(k).alias("k")).agg(F.min(name).alias("label"), F.bool_or(flag).alias("flag"), F.collect_set(item).alias("items"))
    c = part(table(s, d, "customer").where("c_nationkey < 18"), "c_nationkey", "c_name", F.col("c_acctbal") < 0, F.col("c_mktsegment"))
    p = part(table(s, d, "supplier"), "s_nationkey", "s_name", F.col("s_acctbal") < 500, F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string")))
    return R.merge_evidence(c, p, "k", ["label"], ["flag"], ["items"]).withColumn("items", F.array_join(F.sort_array("items"), ","))


@query("j24_known_flow", """
WITH k AS (SELECT * FROM (VALUES (1, 'red'), (2, 'widget'), (3, 'small ring')) t(ord, flow))
SELECT p_partkey, flow FROM part LEFT JOIN k ON contains(p_name, flow) OR contains(flow, p_name) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY ord) = 1""")
def _(s, d):
    known = s.sql("SELECT * FROM (VALUES (1, 'red'), (2, 'widget'), (3, 'small ring')) AS t(ord, flow)")
    names = table(s, d, "part").select("p_name").distinct()
    pairs = L.contains_either(names, known, "p_name", "flow").select("p_name", "flow", "ord")
    return flows.known_flow(table(s, d, "part").select("p_partkey", "p_name"), known, ["p_name"], pairs, ["ord"]).select("p_partkey", "flow")


@query("u1_priority_union", f"""
WITH e AS ({ENDPOINTS}), a AS (SELECT method, regexp_replace(path, '/$', '') AS path, 0 AS r, page_id FROM e WHERE page_id % 3 = 0), b AS (SELECT method, path, 1, page_id FROM e WHERE page_id % 3 = 1), c AS (SELECT 'GET', path, 2, page_id FROM e WHERE page_id % 3 = 2)
SELECT method, path, r AS source_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY method, path ORDER BY r, page_id) = 1""")
def _(s, d):
    e = derive(s, d, ENDPOINTS)
    parts = [e.where(f"page_id % 3 = {k}") for k in range(3)]
    parts[2] = parts[2].withColumn("method", F.lit("GET"))
    return R.priority_union(parts, ["method", "path"], ["page_id"]).select("method", "path", "source_rank")


@query("u2_flow_union", f"""
WITH u AS (SELECT 0 AS r, lower(c_mktsegment) AS flow FROM customer UNION ALL SELECT 1, substr(p_name, 1, 3) FROM part UNION ALL SELECT 2, needle FROM ({_NEEDLES})), f AS (SELECT flow, min(r) AS r FROM u GROUP BY 1)
SELECT r AS source_rank, count(*) AS n FROM f GROUP BY 1""")
def _(s, d):
    parts = [table(s, d, "customer").select(F.lower("c_mktsegment").alias("flow")).distinct(), table(s, d, "part").select(F.substring("p_name", 1, 3).alias("flow")).distinct(), derive(s, d, _NEEDLES).withColumnRenamed("needle", "flow")]
    return R.priority_union(parts, ["flow"], ["flow"]).groupBy("source_rank").agg(F.count("*").alias("n"))


@query("u4_context_nodes", """
WITH u AS (SELECT * FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'customer' AS kind, 0 AS r FROM customer ORDER BY id LIMIT 60)
  UNION ALL SELECT * FROM (SELECT CAST(s_suppkey AS VARCHAR), s_name, 'supplier', 1 FROM supplier ORDER BY 1 LIMIT 40) UNION ALL SELECT * FROM (SELECT CAST(p_partkey AS VARCHAR), p_name, 'part', 2 FROM part ORDER BY 1 LIMIT 120))
SELECT id, name, kind FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY r) = 1""")
def _(s, d):
    from quarry.operators.graph import context_nodes

    part = lambda t, k, n: table(s, d, t).select(F.col(k).cast("string").alias("id"), F.col(n).alias("name"))
    return context_nodes([(part("customer", "c_custkey", "c_name"), "customer", 60), (part("supplier", "s_suppkey", "s_name"), "supplier", 40), (part("part", "p_partkey", "p_name"), "part", 120)])


_ENTRIES = "SELECT event_type AS name, CAST(user_id AS STRING) AS target FROM events"


@query("g8_entrypoints", """
WITH e AS (SELECT DISTINCT event_type || ' ' || CAST(user_id AS VARCHAR) AS name, CAST(user_id AS VARCHAR) AS target, CASE WHEN event_type IN ('view', 'click') THEN 'rest-endpoint' ELSE 'event-handler' END AS kind FROM events)
SELECT 'entry.' || kind || '.' || replace(name, ' ', '-') AS entry_id, kind, name, target, CASE kind WHEN 'rest-endpoint' THEN 'controller' ELSE 'listener' END AS role, CASE kind WHEN 'rest-endpoint' THEN 'api' ELSE 'event' END AS flow_type FROM e""")
def _(s, d):
    e = derive(s, d, _ENTRIES).distinct().withColumn("label", F.concat_ws(" ", "name", "target"))
    rest = e.where("name IN ('view', 'click')").select(F.col("label").alias("name"), "target")
    other = e.where("name NOT IN ('view', 'click')").select(F.col("label").alias("name"), "target")
    return flows.entrypoints([(rest, "rest-endpoint"), (other, "event-handler")])


@query("g9_flow_traces", """
WITH e AS (SELECT c_custkey, c_name FROM customer), s AS (SELECT o_custkey AS c, l_suppkey AS node, count(*) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
k AS (SELECT c, node, row_number() OVER (PARTITION BY c ORDER BY score DESC, CAST(node AS VARCHAR)) AS rn FROM s),
p AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS node FROM orders), q AS (SELECT c, node, row_number() OVER (PARTITION BY c ORDER BY node) AS rn FROM p),
u AS (SELECT c_custkey AS id, c_name AS node, 'controller' AS role, 0 AS part, 1 AS place FROM e UNION ALL SELECT c, CAST(node AS VARCHAR), 'service', 1, rn FROM k WHERE rn <= 2 UNION ALL SELECT c, node, 'repository', 2, rn FROM q WHERE rn <= 3)
SELECT id AS entry_id, row_number() OVER (PARTITION BY id ORDER BY part, place) AS step_ord, role, node FROM u""")
def _(s, d):
    entries = table(s, d, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("name"), F.lit("controller").alias("role"))
    joined = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    services = joined.groupBy(F.col("o_custkey").alias("entry_id"), F.col("l_suppkey").cast("string").alias("node")).agg(F.count("*").alias("score"))
    stores = table(s, d, "orders").select(F.col("o_custkey").alias("entry_id"), F.col("o_orderpriority").alias("node")).distinct().withColumn("score", F.lit(1))
    known = table(s, d, "customer").select(F.col("c_custkey").alias("entry_id"))
    return flows.flow_traces(entries, [(services.join(known, "entry_id", "left_semi"), "service", 2), (stores.join(known, "entry_id", "left_semi"), "repository", 3)])


@query("g10_semantic_flows", f"""
WITH t AS ({STEPS}), a AS (SELECT user_id, trace_id, coalesce(arg_min(node, step_ord) FILTER (WHERE role = 'service'), arg_min(node, step_ord)) AS anchor, string_agg(node, ' -> ' ORDER BY step_ord) AS path, arg_max(node, step_ord) AS outcome, count(*) AS k FROM t GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, anchor ORDER BY trace_id) AS rn FROM a)
SELECT user_id, anchor AS cluster, anchor || ' flow' AS name, CASE WHEN anchor IN ('view', 'click') THEN 'api' ELSE 'event' END AS flow_type, CASE WHEN anchor IN ('view', 'click') THEN 'API consumer' ELSE 'event source' END AS actor, path, outcome, CAST(CASE WHEN user_id % 10 = 0 THEN 0.9 WHEN k > 2 THEN 0.78 ELSE 0.62 END AS DOUBLE) AS confidence FROM c WHERE rn = 1""")
def _(s, d):
    steps = derive(s, d, STEPS)
    kind = F.when(F.col("anchor").isin("view", "click"), "rest-endpoint").otherwise("event-handler")
    return flows.semantic_flows(flows.cluster_traces(steps, "user_id"), steps, "user_id", kind, F.col("user_id") % 10 == 0)


@query("g11_validate_flows", f"""
WITH t AS ({STEPS}), z AS (SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE role = 'helper') AS h, count(DISTINCT node) AS g FROM t GROUP BY 1), p AS (SELECT trace_id, node AS src, lead(node) OVER (PARTITION BY trace_id ORDER BY step_ord) AS dst FROM t), e AS ({STEP_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
SELECT trace_id, 'low_evidence' AS code FROM z WHERE n < 2 UNION ALL SELECT trace_id, 'utility_noise' FROM z WHERE h * 2 > n UNION ALL SELECT trace_id, 'mixed_flow' FROM z WHERE g > 2
UNION ALL SELECT DISTINCT trace_id, 'missing_node' FROM t WHERE node = 'error' UNION ALL SELECT DISTINCT trace_id, 'broken_edge' FROM p WHERE dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.src = p.src AND b.dst = p.dst)""")
def _(s, d):
    steps = derive(s, d, STEPS).withColumn("group_name", F.col("node"))
    nodes = table(s, d, "events").where("event_type <> 'error'").select(F.col("event_type").alias("id"), F.col("event_type").alias("name")).distinct()
    return flows.validate_flows(steps, nodes, derive(s, d, STEP_EDGES), "trace_id")


@query("g12_module_traces", """
WITH f AS (SELECT p_brand, CAST(p_partkey AS VARCHAR) AS trace FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) <= 12)
SELECT * FROM f UNION ALL SELECT DISTINCT p_brand, 'has_promo' FROM part WHERE p_type = 'PROMO' UNION ALL SELECT DISTINCT p_brand, 'has_small' FROM part WHERE p_size < 3""")
def _(s, d):
    return flows.module_traces(table(s, d, "part"), "p_brand", "p_partkey", ["p_size", "p_partkey"], {"has_promo": F.col("p_type") == "PROMO", "has_small": F.col("p_size") < 3})


@query("a24_flows_by_app", f"""
WITH m AS (SELECT p_name, needle FROM (SELECT DISTINCT p_name FROM part) a, ({_NEEDLES}) b WHERE contains(lower(p_name), needle) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY needle) = 1)
SELECT needle AS app, string_agg(DISTINCT p_type || ' -> ' || p_name, ',' ORDER BY p_type || ' -> ' || p_name) AS flows FROM part JOIN m USING (p_name) GROUP BY 1""")
def _(s, d):
    first = R.first_match(L.contains_pairs(table(s, d, "part").select("p_name").distinct(), derive(s, d, _NEEDLES), "p_name", "needle"), ["p_name"], ["needle"])
    rows = table(s, d, "part").join(first, "p_name").select(F.col("needle").alias("app"), F.concat_ws(" -> ", "p_type", "p_name").alias("flow")).distinct()
    return rows.groupBy("app").agg(F.array_join(F.sort_array(F.collect_list("flow")), ",").alias("flows"))


@query("c_names", """
SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, lower(regexp_replace(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g')) AS snake,
  sha256(c_name) AS hash, split_part(c_name, '#', 1) || '...' AS head, 'customers' AS plural, 'customer.' AS package, 'number' AS kind FROM customer""")
def _(s, d):
    c = table(s, d, "customer")
    return c.select(
        "c_custkey", N.slugify("c_name").alias("slug"), N.snake_case("c_name").alias("snake"), N.content_hash("c_name").alias("hash"), N.keep_head("c_name", 8).alias("head"),
        N.pluralize_keyword(F.lower(F.substring("c_name", 1, 8))).alias("plural"), N.package_of(F.concat(F.lower(F.substring("c_name", 1, 8)), F.lit("..x"))).alias("package"), N.sql_type(F.lit("BIGINT (20)")).alias("kind"),
    )


@query("c11_endpoint_family", f"SELECT page_id, '/' || split_part(replace(path, '/api/v1', ''), '/', 2) AS family FROM ({ENDPOINTS})")
def _(s, d):
    return derive(s, d, ENDPOINTS).select("page_id", N.endpoint_family("path").alias("family"))


@query("c16_token_overlap", f"SELECT a.conv_id, a.turn, len(list_intersect({_TOKENS.format('a.text')}, {_TOKENS.format('b.text')})) AS overlap FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def _(s, d):
    c = table(s, d, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("a")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", N.overlap(N.tokens("a"), N.tokens("b")).cast("long").alias("overlap"))


@query("c21_kinds", f"""
SELECT id, CASE WHEN label = 'Customer' THEN 'service' WHEN id LIKE '%7' THEN 'job' END AS kind, CASE label WHEN 'Region' THEN 'scheduler' WHEN 'Nation' THEN 'listener' ELSE 'controller' END AS role, CASE label WHEN 'Region' THEN 'scheduled' WHEN 'Nation' THEN 'event' WHEN 'Supplier' THEN 'batch' ELSE 'api' END AS flow_type, CASE label WHEN 'Region' THEN 'scheduler' WHEN 'Nation' THEN 'event source' WHEN 'Supplier' THEN 'operator/runtime' ELSE 'API consumer' END AS actor FROM ({NODES})""")
def _(s, d):
    n = derive(s, d, NODES)
    kind = N.mapped("label", {"Region": "quartz-job", "Nation": "kafka-listener", "Supplier": "cli-command"}, "rest-endpoint")
    notes = F.when(F.col("label") == "Customer", F.array(F.lit("@Service"))).otherwise(F.array().cast("array<string>"))
    name = F.when(F.endswith("id", F.lit("7")), F.concat("id", F.lit(".job.x"))).otherwise(F.col("id"))
    return n.select("id", N.type_kind(notes, name).alias("kind"), N.step_role(kind).alias("role"), N.flow_type(kind).alias("flow_type"), N.flow_actor(kind).alias("actor"))


@query("f1_exclude_platform", f"SELECT id, name FROM ({NODES}) WHERE label <> 'Region' AND name NOT LIKE 'Customer#0000000%'")
def _(s, d):
    from quarry.operators.graph import exclude_platform

    n = derive(s, d, NODES).where("label <> 'Region'").withColumn("fqn", F.concat(F.lit("x."), F.col("name")))
    return exclude_platform(n, ["fqn"], ["x.Customer#0000000", "java."]).select("id", "name")


@query("f2_contains_any", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token =')")
def _(s, d):
    return table(s, d, "documents").where(L.contains_any(F.col("text"), ["license", "token ="])).select("doc_id")


@query("edges_adjacency", f"SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM ({EDGES}) WHERE src <> dst GROUP BY 1")
def _(s, d):
    from quarry.operators.graph import adjacency

    return adjacency(derive(s, d, EDGES)).withColumn("targets", F.array_join("targets", ","))
