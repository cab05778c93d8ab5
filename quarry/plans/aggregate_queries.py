"""Queries of the aggregation, window, order and run-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import names as N
from quarry.operators import aggregates as A
from quarry.operators import flows, quality, runlog
from quarry.operators import relational as R
from quarry.plans.inputs import EDGES, ENDPOINTS, ISSUES, NODES, SOURCES, STEPS, TYPE_DEPS, derive, table
from quarry.plans.registry import query


@query("a1_package_relations", f"""
SELECT split_part(from_type, '.', 1) AS from_package, split_part(to_type, '.', 1) AS to_package, count(*) AS n
FROM ({TYPE_DEPS}) WHERE split_part(from_type, '.', 1) <> split_part(to_type, '.', 1)
GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 500""")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.package_relations(derive(s, d, TYPE_DEPS))


_FAMILY = "'/' || split_part(replace(path, '/api/v1', ''), '/', 2)"


@query("a2_endpoint_families", f"""
WITH e AS (SELECT *, {_FAMILY} AS family, row_number() OVER (PARTITION BY {_FAMILY} ORDER BY page_id) AS rn FROM ({ENDPOINTS})),
f AS (SELECT family, method || ' ' || path AS x, min(rn) AS o FROM e WHERE rn <= 3 GROUP BY ALL),
g AS (SELECT family, string_agg(x, ';' ORDER BY o) AS samples FROM f GROUP BY family)
SELECT family, count(*) AS n, any_value(samples) AS samples FROM e JOIN g USING (family) GROUP BY family""")
def _(s, d):
    return A.endpoint_families(derive(s, d, ENDPOINTS), "path", "method", "page_id").withColumn("samples", F.array_join("samples", ";"))


@query("a3_kind_counts", "SELECT p_brand AS kind, count(*) AS n FROM part GROUP BY ROLLUP (p_brand)")
def _(s, d):
    return A.kind_counts(table(s, d, "part").withColumnRenamed("p_brand", "kind"), "kind")


@query("a4_package_counts", f"SELECT regexp_extract(name, '^(.+)[.][^.]*$', 1) AS package, count(*) AS n FROM (SELECT from_type AS name FROM ({TYPE_DEPS})) GROUP BY 1")
def _(s, d):
    return A.package_counts(derive(s, d, TYPE_DEPS), "from_type")


@query("a5_label_histogram", "SELECT label, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS label FROM part) GROUP BY 1 ORDER BY n DESC, label LIMIT 30")
def _(s, d):
    return A.label_histogram(table(s, d, "part").select(F.split("p_name", " ").alias("labels")), "labels")


_AST = f"""SELECT split_part(from_type, '.', 1) AS package, to_type AS import, from_type AS type_name FROM ({TYPE_DEPS})"""


@query("a6_package_index", f"""
WITH a AS ({_AST}), i AS (SELECT DISTINCT package, import FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY import) AS rn FROM i),
f AS (SELECT package, string_agg(import, ',' ORDER BY import) AS imports FROM r WHERE rn <= 12 GROUP BY 1)
SELECT package, count(DISTINCT type_name) AS n_files, count(DISTINCT type_name) AS n_types, any_value(imports) AS imports FROM a JOIN f USING (package) GROUP BY package""")
def _(s, d):
    ast = derive(s, d, _AST).select("package", F.col("type_name").alias("file"), "type_name", F.array("import").alias("imports"))
    return A.package_index(ast).withColumn("imports", F.array_join("imports", ","))


@query("a7_annotation_index", """
WITH t AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS annotation FROM part)
SELECT annotation, count(*) AS n, string_agg(p_brand, ',' ORDER BY p_brand) AS types FROM t GROUP BY 1""")
def _(s, d):
    types = table(s, d, "part").select("p_brand", F.split("p_name", " ").alias("annotations"))
    return A.annotation_index(types, "p_brand", "annotations").withColumn("types", F.array_join("types", ","))


@query("a8_lookup", f"SELECT DISTINCT split_part(from_type, '.', 1) AS key, from_type AS value FROM ({TYPE_DEPS})")
def _(s, d):
    return A.lookup(derive(s, d, TYPE_DEPS).withColumn("package", N.package_of("from_type")), "package", "from_type")


@query("a9_index_summary", """
SELECT count(DISTINCT p_brand) AS n_packages, count(DISTINCT p_partkey) AS n_files, count(DISTINCT p_name) AS n_types, CAST(sum(len(string_split(p_name, ' '))) AS BIGINT) AS n_imports,
  count(*) AS n_methods, CAST(2 * count(*) AS BIGINT) AS n_fields, CAST(sum(len(string_split(p_name, ' '))) AS BIGINT) AS n_annotations FROM part""")
def _(s, d):
    words = F.split("p_name", " ")
    return A.index_summary(table(s, d, "part").select(F.col("p_brand").alias("package"), F.col("p_partkey").alias("file"), F.col("p_name").alias("type_name"), words.alias("imports"), F.array("p_type").alias("methods"), F.array("p_type", "p_brand").alias("fields"), words.alias("annotations")))


@query("a10_layer_counts", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE value > 10) AS n_large FROM events GROUP BY 1""")
def _(s, d):
    flags = {"n_view": F.col("event_type") == "view", "n_error": F.col("event_type") == "error", "n_large": F.col("value") > 10}
    return A.flag_counts(table(s, d, "events"), ["user_id"], flags)


_SCOPED = "SELECT n_name, c_custkey, c_mktsegment, o_orderstatus, o_orderpriority FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"


@query("a11_module_dossiers", f"""
SELECT n_name, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
  string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
FROM ({_SCOPED}) GROUP BY 1""")
def _(s, d):
    flags = {"n_final": F.col("o_orderstatus") == "F", "n_open": F.col("o_orderstatus") == "O", "n_urgent": F.col("o_orderpriority") == "1-URGENT"}
    out = A.module_dossiers(derive(s, d, _SCOPED), "n_name", flags, {"segments": F.col("c_mktsegment"), "priorities": F.col("o_orderpriority")})
    return out.withColumns({c: F.array_join(c, ",") for c in ("segments", "priorities")})


@query("a12_observations", f"""
WITH c AS (SELECT n_name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT c_custkey) AS k FROM ({_SCOPED}) GROUP BY 1)
SELECT n_name, 'broad surface' AS observation FROM c WHERE n >= 100 UNION ALL SELECT n_name, 'mostly final' FROM c WHERE 2 * f > n UNION ALL SELECT n_name, 'few customers' FROM c WHERE k < 60""")
def _(s, d):
    counts = derive(s, d, _SCOPED).groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.countDistinct("c_custkey").alias("k"))
    rules = [(F.col("n") >= 100, "broad surface"), (2 * F.col("f") > F.col("n"), "mostly final"), (F.col("k") < 60, "few customers")]
    return A.observations(counts, ["n_name"], rules).drop("ord")


@query("a13_api_surface", f"""
WITH e AS (SELECT {_FAMILY} AS family, page_id FROM ({ENDPOINTS})), c AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE page_id % 10 < 2 OR family = '/es') AS p FROM e GROUP BY 1)
SELECT family, n, p AS n_protected, CASE WHEN p = 0 THEN 'public' WHEN p >= n THEN 'protected' ELSE 'mixed' END AS auth FROM c""")
def _(s, d):
    e = derive(s, d, ENDPOINTS).withColumn("family", N.endpoint_family("path"))
    c = e.groupBy("family").agg(F.count("*").alias("n"), F.count_if((F.col("page_id") % 10 < 2) | (F.col("family") == "/es")).alias("n_protected"))
    return c.withColumn("auth", A.auth_mode(F.col("n_protected"), F.col("n")))


@query("a14_runtime_summary", f"""
WITH f AS (SELECT split_part(file, '/', 2) AS app, CASE WHEN contains(text, 'kafka') OR contains(text, 'Kafka') THEN 'kafka' END AS k, CASE WHEN contains(text, '@PreAuthorize') THEN 'security' END AS s, CASE WHEN contains(text, '@RestController') THEN 'http' END AS h FROM ({SOURCES})),
u AS (SELECT app, k AS x FROM f UNION SELECT app, s FROM f UNION SELECT app, h FROM f)
SELECT app, string_agg(x, ',' ORDER BY x) AS features FROM u GROUP BY app""")
def _(s, d):
    rules = [quality.Rule("kafka", "kafka|Kafka", "kafka"), quality.Rule("security", "@PreAuthorize", "security"), quality.Rule("http", "@RestController", "http")]
    f = derive(s, d, SOURCES).withColumn("app", F.element_at(F.split("file", "/"), 2))
    facts = quality.apply_rules(f, ["app"], F.col("text"), rules)
    found = A.merged_items(facts, ["app"], "output").withColumn("features", F.array_join("items", ",")).drop("items")
    return f.select("app").distinct().join(found, "app", "left")


@query("a15_repo_structure", f"""
WITH p AS (SELECT DISTINCT split_part(file, '/', 2) AS root, split_part(file, '/', 3) AS child FROM ({SOURCES}))
SELECT root, count(child) AS n_children, CASE WHEN count(child) > 1 THEN 'multi-module application' ELSE 'application' END AS role, count(child) > 1 AS multi_module FROM p GROUP BY 1""")
def _(s, d):
    return A.repo_structure(derive(s, d, SOURCES).select(F.regexp_replace("file", "^src/", "").alias("path")), "path")


@query("a16_internal_modules", f"""
SELECT split_part(file, '/', 2) AS app, split_part(file, '/', 3) AS module, count(*) AS n FROM ({SOURCES}) GROUP BY ALL""")
def _(s, d):
    f = derive(s, d, SOURCES).select(F.element_at(F.split("file", "/"), 2).alias("app"), F.regexp_extract("text", r"package ([\w.]+);", 1).alias("package"), F.element_at(F.split("file", "/"), 3).alias("folder"))
    spread = f.groupBy("app").agg(F.countDistinct("package").alias("k"))
    both = A.internal_modules(f.join(spread.where("k > 1"), "app", "left_semi"), "app", "package", "folder")
    return both.unionByName(f.join(spread.where("k = 1"), "app", "left_semi").groupBy("app", F.col("folder").alias("module")).agg(F.count("*").alias("n")))


@query("a17_common_prefix", f"""
WITH p AS (SELECT split_part(file, '/', 2) AS app, string_split(regexp_extract(text, 'package ([a-z0-9.]+);', 1), '.') AS x FROM ({SOURCES})),
m AS (SELECT app, min(x) AS a, max(x) AS b FROM p GROUP BY 1)
SELECT app, CASE WHEN a = b THEN array_to_string(a, '.') ELSE array_to_string(list_slice(a, 1, 3), '.') END AS prefix FROM m""")
def _(s, d):
    f = derive(s, d, SOURCES).select(F.element_at(F.split("file", "/"), 2).alias("app"), F.regexp_extract("text", r"package ([\w.]+);", 1).alias("package"))
    return A.common_prefix(f, ["app"], "package")


@query("a18_validation_summary", f"""
SELECT doc_id, count(*) FILTER (WHERE severity = 'gap') AS n_gap, count(*) FILTER (WHERE severity = 'conflict') AS n_conflict, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'violation') AS n_violation,
  CASE WHEN count(*) FILTER (WHERE severity IN ('violation', 'conflict', 'gap')) > 0 THEN 'draft' WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'ready' ELSE 'validated' END AS status
FROM ({ISSUES}) GROUP BY 1""")
def _(s, d):
    return quality.validation_summary(derive(s, d, ISSUES))


@query("a19_validation_delta", f"""
SELECT code, count(*) AS n, count(DISTINCT doc_id) AS n_targets, any_value(CASE code WHEN 'error' THEN 'fix the failing step' WHEN 'signup' THEN 'complete the section' ELSE 'review' END) AS hint FROM ({ISSUES}) WHERE severity <> 'info' GROUP BY 1""")
def _(s, d):
    hint = N.mapped("code", {"error": "fix the failing step", "signup": "complete the section"}, "review")
    return derive(s, d, ISSUES).where("severity <> 'info'").groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_targets")).withColumn("hint", hint)


_MISSING = """
SELECT 'customers' AS category, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'parts', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"""


@query("a20_verification", f"""
WITH m AS ({_MISSING}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM m),
c AS (SELECT unnest(['customers', 'parts', 'suppliers']) AS category)
SELECT c.category, count(id) AS n, CASE WHEN count(id) > 0 THEN 'warning' ELSE 'ok' END AS status, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FILTER (WHERE rn <= 20), '') AS evidence
FROM c LEFT JOIN r USING (category) GROUP BY 1""")
def _(s, d):
    orders, lines = table(s, d, "orders").select(F.col("o_custkey").alias("id")), table(s, d, "lineitem").select(F.col("l_partkey").alias("id"))
    missing = R.coverage(table(s, d, "customer").select(F.col("c_custkey").alias("id")), orders, "id", "customers").union(R.coverage(table(s, d, "part").select(F.col("p_partkey").alias("id")), lines, "id", "parts"))
    return A.verification(missing, ["customers", "parts", "suppliers"]).withColumn("evidence", F.array_join("evidence", ","))


@query("a20_verification_slices", f"""
WITH c AS (SELECT * FROM (VALUES ('endpoints', 'api'), ('services', 'service'), ('repositories', 'persistence'), ('flows', 'flow'), ('flows', 'service'), ('files', 'structure')) t(category, slice)),
m AS (SELECT CASE severity WHEN 'gap' THEN 'endpoints' WHEN 'warning' THEN 'services' WHEN 'violation' THEN 'flows' ELSE 'layers' END AS category, count(*) AS n FROM ({ISSUES}) GROUP BY 1)
SELECT slice, count(*) AS n_checks, count(*) FILTER (WHERE coalesce(n, 0) > 0) AS n_issues FROM c LEFT JOIN m USING (category) GROUP BY 1""")
def _(s, d):
    category = N.mapped("severity", {"gap": "endpoints", "warning": "services", "violation": "flows"}, "layers")
    missing = derive(s, d, ISSUES).select(category.alias("category"), F.col("event_id").alias("id"))
    checks = A.verification(missing, ["endpoints", "services", "repositories", "flows", "files", "layers", "externals"])
    return A.verification_slices(checks)


@query("a21_cluster_traces", f"""
WITH t AS ({STEPS}), a AS (SELECT user_id, trace_id, coalesce(arg_min(node, step_ord) FILTER (WHERE role = 'service'), arg_min(node, step_ord)) AS anchor FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, anchor ORDER BY trace_id) AS rn FROM a)
SELECT user_id, anchor AS cluster, count(*) AS n_traces, anchor, string_agg(trace_id, ',' ORDER BY trace_id) FILTER (WHERE rn <= 16) AS evidence FROM r GROUP BY ALL""")
def _(s, d):
    return flows.cluster_traces(derive(s, d, STEPS), "user_id").withColumn("evidence", F.array_join("evidence", ","))


@query("a22_layer_graph", f"SELECT c_mktsegment AS layer, n_name AS app, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS items FROM ({_SCOPED}) GROUP BY ALL")
def _(s, d):
    rows = derive(s, d, _SCOPED).select(F.col("c_mktsegment").alias("layer"), F.col("n_name").alias("app"), "o_orderpriority")
    return A.merged_items(rows, ["layer", "app"], "o_orderpriority").withColumn("items", F.array_join("items", ","))


@query("a23_application_layers", """
WITH u AS (SELECT n_regionkey AS app, 'customer' AS layer, c_mktsegment AS item FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT n_regionkey, 'nation', n_name FROM nation UNION SELECT n_regionkey, 'supplier', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT app, layer, count(*) AS n, min(item) AS first_item FROM u GROUP BY ALL""")
def _(s, d):
    nation = table(s, d, "nation")
    part = lambda df, key, layer, item: df.join(nation, F.col(key) == F.col("n_nationkey")).select(F.col("n_regionkey").alias("app"), F.lit(layer).alias("layer"), F.col(item).alias("item"))
    rows = part(table(s, d, "customer"), "c_nationkey", "customer", "c_mktsegment").unionByName(part(table(s, d, "supplier"), "s_nationkey", "supplier", "s_name"))
    rows = rows.unionByName(nation.select(F.col("n_regionkey").alias("app"), F.lit("nation").alias("layer"), F.col("n_name").alias("item"))).distinct()
    return rows.groupBy("app", "layer").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


@query("a25_package_slices", f"SELECT DISTINCT split_part(file, '/', 2) AS app, array_to_string(list_slice(string_split(regexp_extract(text, 'package ([a-z0-9.]+);', 1), '.'), 1, 3), '.') AS slice FROM ({SOURCES})")
def _(s, d):
    f = derive(s, d, SOURCES).select(F.element_at(F.split("file", "/"), 2).alias("app"), F.regexp_extract("text", r"package ([\w.]+);", 1).alias("package"))
    return A.package_slices(f, ["app"], "package", 3)


_USAGE = "SELECT l_orderkey, l_linenumber, lower(p_type) || '-' || lower(p_brand) AS model, CAST(l_quantity AS BIGINT) AS q, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey"
_PRICES = "SELECT * FROM (VALUES ('economy', 1.0), ('economy-brand#1', 2.0), ('small', 3.0), ('default', 0.5)) AS t(price_key, price)"


@query("a26_usage_cost", f"""
WITH u AS (SELECT *, CASE WHEN contains(model, 'economy-brand#1') THEN 2.0 WHEN contains(model, 'economy') THEN 1.0 WHEN contains(model, 'small') THEN 3.0 ELSE 0.5 END AS price FROM ({_USAGE}))
SELECT l_suppkey, CAST(sum(q) AS BIGINT) AS input, CAST(sum(2 * q) AS BIGINT) AS cache_create, CAST(sum(0) AS BIGINT) AS cache_read, CAST(sum(q + 1) AS BIGINT) AS output, CAST(round(sum((q + 2 * q * 2 + (q + 1) * 4) * price) / 1000000, 4) AS DOUBLE) AS cost, count(DISTINCT model) AS n_models
FROM u GROUP BY 1""")
def _(s, d):
    usage = derive(s, d, _USAGE).select("l_orderkey", "l_linenumber", "model", "l_suppkey", F.col("q").alias("input"), (2 * F.col("q")).alias("cache_create"), F.lit(0).cast("long").alias("cache_read"), (F.col("q") + 1).alias("output"))
    p = F.col("price").cast("double")
    prices = s.sql(_PRICES).select("price_key", p.alias("input_price"), (2 * p).alias("cache_create_price"), p.alias("cache_read_price"), (4 * p).alias("output_price"))
    # Prices are looked up once per model, not once per line.
    models = usage.select("model").distinct()
    from quarry.operators.linking import longest_key

    priced = usage.join(longest_key(models, prices, "model", "price_key", "default").drop("price_key"), "model")
    classes = ["input", "cache_create", "cache_read", "output"]
    cost = sum((F.col(c) * F.col(f"{c}_price") for c in classes), F.lit(0.0))
    return priced.groupBy("l_suppkey").agg(*(F.sum(c).alias(c) for c in classes), F.round(F.sum(cost) / 1_000_000, 4).alias("cost"), F.countDistinct("model").alias("n_models"))


@query("a27_run_progress", """
WITH m AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, CAST(greatest(0, least(100, floor(100.0 * (CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END + coalesce(done, 0)) / (3 + coalesce(n, 0)) + 0.5))) AS INTEGER) AS percent
FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def _(s, d):
    runs = table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("stages_done"))
    modules = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("open").alias("status"))
    return runlog.run_progress(runs, modules, "run_id", 3)


@query("a28_task_metrics", """
SELECT count(*) AS n_tasks, round(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') / count(*) FILTER (WHERE o_orderstatus = 'F'), 4) AS drift_rate,
  round(avg(o_orderkey % 7), 4) AS mean_risks, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS done_ratio FROM orders""")
def _(s, d):
    tasks = table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("drift"), (F.col("o_orderkey") % 7).alias("n_risks"))
    return runlog.task_metrics(tasks)


@query("a29_review_dossier", f"""
WITH n AS ({NODES}), e AS ({EDGES}), g AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
t AS (SELECT string_agg(id, ',' ORDER BY k DESC, id) AS focus FROM (SELECT * FROM g ORDER BY k DESC, id LIMIT 5))
SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(DISTINCT label) FROM n) AS n_labels, (SELECT count(*) FROM e) AS n_edges, focus FROM t""")
def _(s, d):
    return runlog.review_dossier(derive(s, d, NODES), derive(s, d, EDGES))


@query("a30_parse_stats", """
SELECT s_nationkey, count(*) AS n_files, CAST(sum(length(s_name)) AS BIGINT) AS n_chars, CAST(sum(s_suppkey % 5) AS BIGINT) AS n_types, string_agg(DISTINCT substr(s_name, 1, 12), ',' ORDER BY substr(s_name, 1, 12)) AS heads FROM supplier GROUP BY 1""")
def _(s, d):
    f = table(s, d, "supplier")
    return f.groupBy("s_nationkey").agg(F.count("*").alias("n_files"), F.sum(F.length("s_name")).cast("long").alias("n_chars"), F.sum(F.col("s_suppkey") % 5).alias("n_types"), F.array_join(F.sort_array(F.collect_set(F.substring("s_name", 1, 12))), ",").alias("heads"))


@query("a31_schema_confidence", """
WITH t AS (SELECT c_nationkey AS k, count(DISTINCT c_mktsegment) AS n, bool_or(c_custkey % 50 = 0) AS a, bool_or(c_custkey % 77 = 0) AS b FROM customer GROUP BY 1)
SELECT k, CASE WHEN n >= 3 AND a AND b THEN 'high' WHEN n >= 2 OR a OR b THEN 'medium' ELSE 'low' END AS confidence FROM t""")
def _(s, d):
    from quarry.operators.schema import schema_confidence

    t = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.countDistinct("c_mktsegment").alias("n"), F.bool_or(F.col("c_custkey") % 50 == 0).alias("a"), F.bool_or(F.col("c_custkey") % 77 == 0).alias("b"))
    return t.select("k", schema_confidence(F.col("n"), F.col("a"), F.col("b")).alias("confidence"))


@query("a32_graph_summary", f"SELECT label, count(DISTINCT id) AS n, min(name) AS first_name, max(name) AS last_name FROM ({NODES}) GROUP BY 1")
def _(s, d):
    return derive(s, d, NODES).groupBy("label").agg(F.countDistinct("id").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("a33_unique_by", f"SELECT method, path, min(page_id) AS page_id FROM ({ENDPOINTS}) GROUP BY ALL")
def _(s, d):
    return R.unique_by(derive(s, d, ENDPOINTS), ["method", "path"], ["page_id"]).select("method", "path", "page_id")


@query("a34_insight_buckets", f"""
SELECT CASE WHEN label = 'Region' THEN 'module' WHEN label = 'Supplier' THEN 'external' WHEN contains(name, '7') THEN 'service' ELSE 'other' END AS role, count(DISTINCT name) AS n, md5(string_agg(DISTINCT name, ',' ORDER BY name)) AS names_md5 FROM ({NODES}) GROUP BY 1""")
def _(s, d):
    rules = [("module", F.col("label") == "Region"), ("external", F.col("label") == "Supplier"), ("service", F.contains("name", F.lit("7")))]
    out = A.insight_buckets(derive(s, d, NODES), "name", "label", rules)
    return out.select("role", "n", F.md5(F.array_join("names", ",")).alias("names_md5"))


@query("a35_top_lists", """
WITH c AS (SELECT c_mktsegment AS kind, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT kind, name, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) <= 12""")
def _(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("kind"), F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    return A.top_lists(c, "kind", "name", "n")


@query("a36_application_cards", f"""
WITH u AS (SELECT DISTINCT n_name AS app, 'Segments' AS card, c_mktsegment AS item FROM ({_SCOPED}) UNION SELECT n_name, 'Priorities', o_orderpriority FROM ({_SCOPED}))
SELECT app, card, string_agg(item, ',' ORDER BY item) AS items FROM u GROUP BY ALL""")
def _(s, d):
    rows = derive(s, d, _SCOPED)
    cards = rows.select("n_name", F.explode(F.array(F.struct(F.lit("Segments").alias("card"), F.col("c_mktsegment").alias("item")), F.struct(F.lit("Priorities").alias("card"), F.col("o_orderpriority").alias("item")))).alias("x"))
    return A.merged_items(cards.select(F.col("n_name").alias("app"), "x.*"), ["app", "card"], "item").withColumn("items", F.array_join("items", ","))


@query("w2_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_user FROM conversations")
def _(s, d):
    c = table(s, d, "conversations").withColumn("u", F.when(F.col("role") == "user", F.col("turn")))
    return R.carry_forward(c, ["conv_id"], ["turn"], "u", "last_user").select("conv_id", "turn", "last_user")


@query("w3_look_ahead", "SELECT conv_id, turn, first_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS answer FROM conversations")
def _(s, d):
    c = table(s, d, "conversations").withColumn("a", F.when(F.col("role") == "assistant", F.col("turn")))
    return R.look_ahead(c, ["conv_id"], ["turn"], "a", 3, "answer").select("conv_id", "turn", "answer")


@query("w4_nearby", "SELECT conv_id, turn, first_value(CASE WHEN length(text) > 200 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near_long FROM conversations")
def _(s, d):
    c = table(s, d, "conversations").withColumn("x", F.when(F.length("text") > 200, F.col("turn")))
    return R.nearby(c, ["conv_id"], ["turn"], "x", 3, "near_long").select("conv_id", "turn", "near_long")


@query("w5_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(s, d):
    return R.latest(table(s, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("w6_top_k", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def _(s, d):
    return R.top_k(table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("w7_node_ids", "SELECT c_custkey, 'customer.' || lower(c_mktsegment) || '.' || CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS VARCHAR) AS id FROM customer")
def _(s, d):
    from quarry.operators.graph import node_ids

    return node_ids(table(s, d, "customer"), ["c_nationkey"], F.lit("customer"), "c_mktsegment", ["c_custkey"]).select("c_custkey", "id")


@query("w8_sequence_ids", """
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') || '-u' || CAST(user_id AS VARCHAR) AS p, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY ts, event_id) AS n FROM e)
SELECT event_id, CASE WHEN n = 1 THEN p ELSE p || '-' || CAST(n AS VARCHAR) END AS seq_id FROM r""")
def _(s, d):
    prefix = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-u"), F.col("user_id").cast("string"))
    return R.sequence_ids(table(s, d, "events"), prefix, ["ts", "event_id"]).select("event_id", "seq_id")


@query("w9_chunks", """
WITH r AS (SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 8) + 1 AS BIGINT) AS chunk FROM documents)
SELECT doc_id, chunk, CAST(chunk AS VARCHAR) || '/' || CAST(max(chunk) OVER (PARTITION BY source) AS VARCHAR) AS chunk_label FROM r""")
def _(s, d):
    return R.chunk(table(s, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 8).select("doc_id", "chunk", "chunk_label")


@query("w10_pack", """
WITH r AS (SELECT doc_id, source, CAST(sum(n_chars + 2) OVER (PARTITION BY source ORDER BY doc_id) - 2 AS BIGINT) AS packed_length FROM documents) SELECT doc_id, source, packed_length FROM r WHERE packed_length <= 20000""")
def _(s, d):
    return R.pack(table(s, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 20000).select("doc_id", "source", "packed_length")


@query("w11_step_pairs", f"""
WITH p AS (SELECT node, lead(node) OVER (PARTITION BY trace_id ORDER BY step_ord) AS next_node FROM ({STEPS})) SELECT node, next_node, count(*) AS n FROM p WHERE next_node IS NOT NULL GROUP BY ALL""")
def _(s, d):
    return R.step_pairs(derive(s, d, STEPS), ["trace_id"], ["step_ord"], "node").groupBy("node", "next_node").agg(F.count("*").alias("n"))


@query("o2_row_cap", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def _(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "o_custkey")


@query("o3_freshness", "SELECT o_custkey, max(o_orderdate) AS last_at FROM orders GROUP BY 1")
def _(s, d):
    return runlog.by_freshness(table(s, d, "orders"), ["o_custkey"], "o_orderdate")


@query("o4_interest", """
WITH c AS (SELECT c_nationkey, c_custkey, length(c_name) % 3 + c_custkey % 11 AS score FROM customer) SELECT c_nationkey, c_custkey, score FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) <= 20""")
def _(s, d):
    c = table(s, d, "customer").select("c_nationkey", "c_custkey", (F.length("c_name") % 3 + F.col("c_custkey") % 11).alias("score"))
    return R.top_k(c, ["c_nationkey"], [F.desc("score"), "c_custkey"], 20)


@query("o5_keyword_slice", """
WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'then') AS INTEGER) + CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'token') AS INTEGER) AS score FROM documents)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 15""")
def _(s, d):
    from quarry.operators.linking import keyword_score

    scored = table(s, d, "documents").select("doc_id", keyword_score(F.col("text"), ["then", "license", "token"]).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(15)


@query("o6_context_slice", """
WITH s AS (SELECT p_brand, p_partkey, CAST(contains(lower(p_name), 'red') AS INTEGER) + CAST(contains(lower(p_name), 'ring') AS INTEGER) + CASE WHEN p_type = 'PROMO' THEN 100 ELSE 0 END AS score FROM part)
SELECT p_brand, p_partkey, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) <= 10""")
def _(s, d):
    from quarry.operators.linking import keyword_score

    score = keyword_score(F.col("p_name"), ["red", "ring"]) + F.when(F.col("p_type") == "PROMO", 100).otherwise(0)
    return R.top_k(table(s, d, "part").select("p_brand", "p_partkey", score.alias("score")).where("score > 0"), ["p_brand"], [F.desc("score"), "p_partkey"], 10)


@query("o7_recent", """
WITH u AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS name, o_orderdate AS seen_at FROM orders UNION ALL SELECT 'e' || CAST(event_id AS VARCHAR), ts FROM events), r AS (SELECT *, row_number() OVER (ORDER BY seen_at DESC, name) AS rn FROM u)
SELECT name, seen_at FROM r WHERE rn <= 10""")
def _(s, d):
    from quarry.sources.corpus import recent

    orders = table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("seen_at"))
    events = table(s, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"), F.col("ts").alias("seen_at"))
    return recent([orders, events], "seen_at", "name").select("name", "seen_at")


@query("f14_stale", """
WITH v AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id FROM documents LEFT JOIN v USING (doc_id) WHERE h IS NULL OR h <> sha256(text)""")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    old = table(s, d, "documents").where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"), F.lit(1).alias("created_at"))
    return runlog.stale(docs, old, ["doc_id"]).select("doc_id")


@query("s14_hash_checkpoint", """
WITH v AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'old' END AS h FROM documents) SELECT doc_id, sha256(text) AS hash FROM documents JOIN v USING (doc_id) WHERE h <> sha256(text)""")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    versions = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("old").alias("hash"), F.lit(1).alias("created_at"))
    return runlog.checkpoint_rows(docs, versions, ["doc_id"]).select("doc_id", "hash")


@query("f9_low_confidence", "SELECT l_suppkey AS target_id, min(l_discount) AS confidence FROM lineitem GROUP BY 1 HAVING min(l_discount) < 0.7 ORDER BY 2, 1 LIMIT 8")
def _(s, d):
    c = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("target_id")).agg(F.min("l_discount").alias("confidence"))
    return runlog.low_confidence(c)


@query("j32_since_last_sync", """
WITH s AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'signup' AND user_id % 4 <> 0 GROUP BY 1),
f AS (SELECT e.user_id, event_id FROM events e JOIN s ON e.user_id = s.user_id WHERE e.ts > s.at),
n AS (SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM s) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5)
SELECT * FROM f UNION ALL SELECT * FROM n""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "ts", "event_type")
    syncs = e.where("event_type = 'signup' AND user_id % 4 <> 0")
    return runlog.since_last_sync(e, syncs, "user_id", "ts", [F.desc("ts"), "event_id"]).select("user_id", "event_id")
