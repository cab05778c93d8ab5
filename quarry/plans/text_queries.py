"""Queries of the text, record, rule, schema and source operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import quality, records, schema
from quarry.operators import text as T
from quarry.plans.inputs import MARKDOWN, SOURCES, derive, table
from quarry.plans.registry import query

#: Lines of the semantic documents with their sections, for oracles.
_LINES = f"""
l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM ({MARKDOWN}))),
m AS (SELECT *, CASE WHEN line LIKE '# %' THEN 1 WHEN line LIKE '## %' THEN 2 ELSE 0 END AS lv FROM l),
q AS (SELECT *, sum(CASE WHEN lv IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec_ord, last_value(CASE WHEN lv IN (1, 2) THEN lv END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS open FROM m),
s AS (SELECT doc_id, sec_ord, max(CASE WHEN lv = 2 THEN trim(substr(line, 4)) END) AS title, trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE lv <> 2), ''), ' ' || chr(10)) AS raw, min(line_no) AS start_line, max(line_no) AS end_line FROM q WHERE open = 2 GROUP BY ALL),
n AS (SELECT *, regexp_replace(lower(title), '[ ]+', '_', 'g') AS name FROM s)"""


@query("p1_sections", f"WITH {_LINES} SELECT doc_id, CAST(sec_ord AS BIGINT) AS sec_ord, title, name, raw, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM n")
def _(s: SparkSession, d: str) -> DataFrame:
    out = T.split_sections(derive(s, d, MARKDOWN))
    return out.select("doc_id", F.col("sec_ord").cast("long").alias("sec_ord"), "title", "name", "raw", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query("p2_headings", f"""
WITH {_LINES}, h AS (SELECT *, CASE WHEN regexp_matches(line, '^#+ ') THEN length(split_part(line, ' ', 1)) ELSE 0 END AS level FROM l), k AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec_ord FROM h)
SELECT doc_id, CAST(sec_ord AS BIGINT) AS sec_ord, CAST(max(level) AS INTEGER) AS level, max(CASE WHEN level > 0 THEN trim(ltrim(line, '#')) END) AS title, trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE level = 0), ''), ' ' || chr(10)) AS content FROM k WHERE sec_ord > 0 GROUP BY ALL""")
def _(s, d):
    return T.split_headings(derive(s, d, MARKDOWN)).select("doc_id", F.col("sec_ord").cast("long").alias("sec_ord"), "level", "title", "content")


@query("p3_context_sections", f"WITH {_LINES} SELECT doc_id, name, raw FROM n WHERE lower(title) IN ('system', 'intent', 'security') AND raw <> ''")
def _(s, d):
    return T.context_sections(derive(s, d, MARKDOWN), ["system", "intent", "security"]).select("doc_id", "name", "raw")


@query("p4_lift_headings", f"SELECT doc_id, md5(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(replace(text, '# Customer', '# System' || chr(10) || '## Customer'), '(^|\\n)#', '\\1##', 'g') ELSE text END, '## data_models', '## data_flows')) AS lifted FROM ({MARKDOWN})")
def _(s, d):
    docs = derive(s, d, MARKDOWN).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "# Customer", "# System\n## Customer")).otherwise(F.col("text")))
    return T.lift_headings(docs, ["system"]).select("doc_id", F.md5("text").alias("lifted"))


_ITEMS = """
b AS (SELECT doc_id, name, sec_ord, raw, list_filter(string_split(raw, chr(10)), lambda x: x LIKE '- %') AS bl FROM n),
i AS (SELECT doc_id, name AS section, sec_ord, CASE WHEN len(bl) > 0 THEN list_transform(bl, lambda x: trim(substr(x, 3))) ELSE list_filter(list_transform(string_split(raw, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') END AS items FROM b),
t AS (SELECT doc_id, section, sec_ord, generate_subscripts(items, 1) - 1 AS item_ord, unnest(items) AS item FROM i)"""


def _items(s: SparkSession, d: str) -> DataFrame:
    sections = T.split_sections(derive(s, d, MARKDOWN)).withColumnRenamed("name", "section")
    return T.section_items(sections, ["doc_id", "section", "sec_ord"])


@query("p5_section_items", f"WITH {_LINES}, {_ITEMS} SELECT doc_id, section, CAST(item_ord AS BIGINT) AS item_ord, item FROM t")
def _(s, d):
    return _items(s, d).select("doc_id", "section", F.col("item_ord").cast("long").alias("item_ord"), "item")


@query("p6_item_lines", f"WITH {_LINES} SELECT doc_id, CAST(sec_ord AS BIGINT) AS sec_ord, row_number() OVER (PARTITION BY doc_id, sec_ord ORDER BY line_no) - 1 AS item_ord, CAST(line_no AS BIGINT) AS line_no FROM q WHERE line LIKE '- %'")
def _(s, d):
    return T.item_lines(derive(s, d, MARKDOWN)).select("doc_id", F.col("sec_ord").cast("long").alias("sec_ord"), F.col("item_ord").cast("long").alias("item_ord"), F.col("line_no").cast("long").alias("line_no"))


@query("p7_system_name", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(regexp_extract(path, '([^/]+)[.]semantic[.]md$', 1), '[_-]+', ' ', 'g') ELSE 'System of ' || regexp_extract(path, '([^/]+)[.]semantic[.]md$', 1) END AS system_name FROM ({MARKDOWN})")
def _(s, d):
    docs = derive(s, d, MARKDOWN)
    return T.system_name(T.split_sections(docs), docs)


@query("p8_doc_title", f"SELECT doc_id, regexp_extract(text, chr(10) || '# ([^\\n]+)', 1) AS title FROM ({MARKDOWN})")
def _(s, d):
    return derive(s, d, MARKDOWN).select("doc_id", T.doc_title(F.col("text")).alias("title"))


@query("p9_apis", f"SELECT doc_id, CAST(o AS BIGINT) AS ord, api FROM (SELECT doc_id, 0 AS o, 'GET /customers/' || CAST(c_nationkey AS VARCHAR) AS api FROM ({MARKDOWN}) JOIN customer ON doc_id = c_custkey UNION ALL SELECT c_custkey, 1, 'POST /orders/' || CAST(c_custkey % 5 AS VARCHAR) || '/' FROM customer)")
def _(s, d):
    return T.extract_apis(derive(s, d, MARKDOWN)).select("doc_id", F.col("ord").cast("long").alias("ord"), "api")


@query("p10_components", "SELECT c_custkey AS doc_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS ord, unnest(['Login Service', 'PaymentGateway', 'OrderService']) AS component FROM customer")
def _(s, d):
    return T.extract_components(derive(s, d, MARKDOWN)).select("doc_id", F.col("ord").cast("long").alias("ord"), "component")


@query("p11_flows", "SELECT c_custkey AS doc_id, CAST(unnest([0, 1]) AS BIGINT) AS ord, unnest(['Data  Flows', 'Payment processing']) AS flow FROM customer")
def _(s, d):
    return T.extract_flows(T.split_headings(derive(s, d, MARKDOWN))).select("doc_id", F.col("ord").cast("long").alias("ord"), "flow")


@query("p12_models", "SELECT c_custkey AS doc_id, CAST(unnest([0, 1]) AS BIGINT) AS ord, unnest(['Payment processing', 'payments']) AS model FROM customer")
def _(s, d):
    return T.extract_models(derive(s, d, MARKDOWN)).select("doc_id", F.col("ord").cast("long").alias("ord"), "model")


_TERMS = "SELECT * FROM (VALUES ('Apache License'), ('MIT License'), ('CC BY'), ('token ='), ('General Public'), ('idiot')) AS t(term)"


@query("p13_tag_terms", f"SELECT doc_id, term FROM documents JOIN ({_TERMS}) ON contains(lower(text), lower(term))")
def _(s, d):
    # A fixed dictionary: its terms are tested in one pass over the text.
    rules = [quality.Rule(t, rf"(?i)\Q{t}\E", "term") for t in ("Apache License", "MIT License", "CC BY", "token =", "General Public", "idiot")]
    return quality.apply_rules(table(s, d, "documents"), ["doc_id"], F.col("text"), rules).select("doc_id", F.col("rule_id").alias("term"))


@query("p13_tag_terms_table", f"SELECT DISTINCT p_partkey, word FROM part JOIN (SELECT DISTINCT lower(c_mktsegment) AS word FROM customer UNION SELECT DISTINCT p_name FROM part) ON contains(lower(p_name), lower(word))")
def _(s, d):
    words = derive(s, d, "SELECT DISTINCT lower(c_mktsegment) AS word FROM customer UNION SELECT DISTINCT p_name FROM part")
    names = table(s, d, "part").select("p_name").distinct()
    tagged = T.tag_terms(names, words, "p_name", "p_name", "word")
    return table(s, d, "part").join(tagged, "p_name").select("p_partkey", "word")


@query("p14_doc_kinds", "SELECT c_custkey AS doc_id, CASE WHEN c_nationkey > 15 THEN 'api-spec' WHEN c_custkey % 5 = 0 THEN 'lld' ELSE 'architecture' END AS kind FROM customer")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_nationkey") > 15, 6).otherwise(2).alias("n_apis"), F.when(F.col("c_nationkey") > 15, 1).otherwise(4).alias("n_components"), F.lit(2).alias("n_flows"), (F.col("c_custkey") % 5 == 0).alias("has_detail"))
    return T.classify_docs(c).select("doc_id", "kind")


@query("p16_annotation_endpoints", f"SELECT file, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN p_size % 2 = 0 THEN '/parts/' || CAST(p_size AS VARCHAR) ELSE '/api/parts' END AS path FROM ({SOURCES}) f JOIN part p ON f.p_partkey = p.p_partkey")
def _(s, d):
    return T.annotation_endpoints(derive(s, d, SOURCES)).select("file", "method", "path")


@query("p17_endpoint_scan", f"""
WITH f AS (SELECT file, p_size, 'Part' || CAST(f.p_partkey AS VARCHAR) || CASE WHEN p_size % 3 = 0 THEN 'Service' ELSE 'Controller' END AS class_name FROM ({SOURCES}) f JOIN part p ON f.p_partkey = p.p_partkey)
SELECT file, 'REST' AS kind, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN p_size % 2 = 0 THEN '/parts/' || CAST(p_size AS VARCHAR) ELSE '/api/parts' END AS path, class_name, 'load' || CAST(p_size AS VARCHAR) AS method_name FROM f
UNION ALL SELECT file, 'Event', 'KafkaListener', 'parts', class_name, 'onPart' FROM f WHERE p_size % 5 = 0""")
def _(s, d):
    return T.scan_endpoints(derive(s, d, SOURCES)).select("file", "kind", "method", "path", "class_name", "method_name")


@query("p18_doc_endpoints", "SELECT min(c_custkey) AS doc_id, 'POST' AS method, '/orders/' || CAST(c_custkey % 5 AS VARCHAR) AS path_key, 'new order' AS description FROM customer GROUP BY c_custkey % 5")
def _(s, d):
    return T.doc_endpoints(derive(s, d, MARKDOWN)).select("doc_id", "method", "path_key", "description")


@query("p19_declared_endpoints", "SELECT c_custkey AS doc_id, 'REST' AS kind, 'GET' AS method, '/customers/' || CAST(c_nationkey AS VARCHAR) AS path, 'list of customers' AS description FROM customer UNION ALL SELECT c_custkey, 'Event', NULL, lower(c_mktsegment) || '.changed', '' FROM customer")
def _(s, d):
    return T.declared_endpoints(T.split_sections(derive(s, d, MARKDOWN))).drop("ord")


@query("p20_annotation_flags", f"SELECT file, (CASE WHEN contains(text, '@Service') THEN 'Service,' ELSE '' END) || (CASE WHEN contains(text, '@RestController') THEN 'RestController,' ELSE '' END) || (CASE WHEN contains(text, '@KafkaListener') THEN 'KafkaListener,' ELSE '' END) AS annotations FROM ({SOURCES})")
def _(s, d):
    out = T.annotation_flags(derive(s, d, SOURCES), ["Service", "RestController", "KafkaListener"])
    return out.select("file", F.concat_ws("", F.transform("annotations", lambda a: F.concat(a, F.lit(",")))).alias("annotations"))


@query("p21_hints", f"""
WITH f AS ({SOURCES}) SELECT file, '@Column' AS hint FROM f UNION ALL SELECT file, '@PreAuthorize' FROM f WHERE contains(text, '@PreAuthorize') UNION ALL SELECT file, 'authz/authn' FROM f WHERE contains(text, 'hasRole') UNION ALL SELECT file, '@KafkaListener' FROM f WHERE contains(text, '@KafkaListener')""")
def _(s, d):
    f = derive(s, d, SOURCES)
    parts = [quality.hints(f, ["file"], "text", k) for k in ("persistence", "security", "integration")]
    return parts[0].union(parts[1]).union(parts[2])


_PATHS = f"SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'src/WebSocket/' WHEN 1 THEN 'src/redis/' WHEN 2 THEN 'src/email/' WHEN 3 THEN 'src/minio/' ELSE 'src/x/' END || CAST(p_partkey AS STRING) AS path, CASE WHEN p_partkey % 4 = 0 THEN ' via Redis' ELSE '' END AS more FROM ({SOURCES}) f"


@query("p23_path_hints", f"""
WITH f AS ({_PATHS}) SELECT file, '@KafkaListener' AS hint FROM f WHERE contains(text, '@KafkaListener') UNION SELECT file, 'WebSocket' FROM f WHERE contains(path, 'WebSocket') UNION SELECT file, 'Redis' FROM f WHERE contains(path, 'redis') OR more <> ''
UNION SELECT file, 'Mail' FROM f WHERE contains(path, 'mail') UNION SELECT file, 'Object storage' FROM f WHERE contains(path, 'minio')""")
def _(s, d):
    f = derive(s, d, _PATHS).withColumn("said", F.concat("text", "more"))
    return quality.hints(f, ["file"], "said", "integration", "path")


@query("p24_source_facts", f"SELECT file, regexp_extract(text, 'package ([a-z0-9.]+);', 1) AS package, 'class' AS type_kind, regexp_extract(text, 'class ([A-Za-z0-9]+)', 1) AS type_name, 'java.util.List,com.shop.common.Money' AS imports, regexp_extract(text, '(load[0-9]+)', 1) || CASE WHEN contains(text, 'onPart') THEN ',onPart' ELSE '' END AS methods, 'OrderRepository' AS injected FROM ({SOURCES})")
def _(s, d):
    out = T.source_facts(derive(s, d, SOURCES))
    return out.withColumns({c: F.array_join(c, ",") for c in ("imports", "methods", "injected")})


_DDL = """
SELECT 'ddl/' || CAST(s_suppkey AS STRING) || '.sql' AS file, s_suppkey, 'CREATE TABLE IF NOT EXISTS t' || CAST(s_suppkey AS STRING) || ' (' || chr(10) || '  id UUID PRIMARY KEY,' || chr(10) || '  price NUMERIC(10, 2) NOT NULL,' || chr(10)
  || '  user_id BIGINT REFERENCES users(id),' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '  FOREIGN KEY (note_id) REFERENCES notes(id),' || chr(10) ELSE '' END || '  "Name" VARCHAR(20)' || chr(10) || ');' || chr(10) || 'INSERT INTO x VALUES (1);' || chr(10) AS text
FROM supplier"""


@query("p25_ddl_columns", """
SELECT 't' || CAST(s_suppkey AS VARCHAR) AS table_name, c AS column_name, t AS type, u AS nullable FROM supplier, (VALUES ('id', 'uuid', true), ('price', 'number', false), ('user_id', 'number', true), ('name', 'string', true)) v(c, t, u)""")
def _(s, d):
    return schema.ddl_columns(schema.ddl_definitions(derive(s, d, _DDL))).select("table_name", "column_name", "type", "nullable")


@query("p25_ddl_keys", """
SELECT 't' || CAST(s_suppkey AS VARCHAR) AS table_name, 'id' AS column_name, CAST(NULL AS VARCHAR) AS target_table FROM supplier
UNION ALL SELECT 't' || CAST(s_suppkey AS VARCHAR), 'user_id', 'users' FROM supplier UNION ALL SELECT 't' || CAST(s_suppkey AS VARCHAR), 'note_id', 'notes' FROM supplier WHERE s_suppkey % 2 = 0""")
def _(s, d):
    rows = schema.ddl_definitions(derive(s, d, _DDL))
    keys = schema.ddl_keys(rows).select("table_name", "column_name", F.lit(None).cast("string").alias("target_table"))
    return keys.union(schema.ddl_references(rows).select("table_name", "column_name", "target_table"))


@query("p26_entity_fields", f"""
SELECT file, 'orders' AS field, 'OrderRepository' AS type, CAST(NULL AS VARCHAR) AS column_name, true AS nullable FROM ({SOURCES})
UNION ALL SELECT file, 'title', 'String', regexp_extract(text, 'name = "([^"]+)"', 1), false FROM ({SOURCES})""")
def _(s, d):
    return T.entity_fields(derive(s, d, SOURCES)).select("file", "field", "type", "column_name", "nullable")


_SCHEMA_ITEMS = "SELECT s_suppkey AS doc_id, 'table supplier_notes | pk: id | columns: id:uuid, body:text, user_id | relationships: supplier_notes.user_id -> users.id (N:1) | source: x' AS item FROM supplier"


@query("p27_schema_items", "SELECT s_suppkey AS doc_id, 'supplier_notes' AS table_name, 'id' AS primary_key, 'id:uuid,body:text,user_id:' AS columns, 'supplier_notes.user_id>users.id N:1' AS link FROM supplier")
def _(s, d):
    parsed = schema.parse_schema_items(derive(s, d, _SCHEMA_ITEMS), ["doc_id"])
    links = schema.schema_links(parsed, ["doc_id"]).select("doc_id", F.format_string("%s.%s>%s.%s %s", "from_table", "from_column", "to_table", "to_column", "cardinality").alias("link"))
    columns = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), F.coalesce(c["type"], F.lit("")))), ",")
    return parsed.select("doc_id", "table_name", F.array_join("primary_key", ",").alias("primary_key"), columns.alias("columns")).join(links, "doc_id")


@query("p28_grep", f"SELECT DISTINCT regexp_extract(text, '@GetMapping[(]\"([^\"]+)\"', 1) AS value FROM ({SOURCES}) WHERE contains(text, '@GetMapping')")
def _(s, d):
    return T.grep_values(derive(s, d, SOURCES), r'@GetMapping\("([^"]+)"')


@query("p28_owners", f"SELECT DISTINCT regexp_extract(file, '([^/]+)[.]java$', 1) AS owner FROM ({SOURCES}) WHERE contains(text, '@KafkaListener')")
def _(s, d):
    return T.grep_owners(derive(s, d, SOURCES), "@KafkaListener")


@query("p30_effects", f"SELECT file, unnest(['persists state', 'publishes event']) AS effect FROM ({SOURCES})")
def _(s, d):
    return T.operation_effects(derive(s, d, SOURCES), ["file"], "text")


_TALK = "SELECT conv_id, turn, text FROM conversations WHERE turn = 0"


@query("p31_flow_steps", f"""
WITH p AS (SELECT conv_id, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[.;\\n]+'), lambda x: trim(x)), lambda x: x <> '')) AS a FROM ({_TALK})), t AS (SELECT conv_id, unnest(a) AS step FROM p)
SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(step), 'auth|permission|role|token|login')) AS n_security FROM t GROUP BY 1""")
def _(s, d):
    steps = T.flow_steps(derive(s, d, _TALK), ["conv_id"])
    return steps.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "security").alias("n_security"))


_REPORTS = """
SELECT o_orderkey, '# Summary' || chr(10) || 'Order done.' || chr(10) || '# Changed files' || chr(10) || '- a/' || CAST(o_custkey AS STRING) || '.java # touched' || chr(10) || '- b.java' || chr(10) || '# Risks' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN '- slow' || chr(10) || '- late' || chr(10) ELSE '' END
  || '# Semantic drift' || chr(10) || CASE WHEN o_orderpriority = '1-URGENT' THEN 'rules  changed' || chr(10) || 'for ' || o_orderstatus ELSE 'None' END AS text
FROM orders"""


@query("p33_report_metrics", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS n_risks, 'a/' || CAST(o_custkey AS VARCHAR) || '.java,b.java' AS files, o_orderpriority = '1-URGENT' AS has_drift, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rules changed for ' || o_orderstatus END AS drift FROM orders")
def _(s, d):
    r = derive(s, d, _REPORTS)
    m = T.report_metrics(r.withColumn("t", F.col("text")), ["o_orderkey", "t"])
    m = m.select("o_orderkey", "n_risks", F.array_join("changed_files", ",").alias("files"), F.col("t").alias("text"))
    return T.drift(m, ["o_orderkey", "n_risks", "files"])


@query("p35_json_events", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_id % 3 <> 2 AS parsed FROM events")
def _(s, d):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("see:\n```json\n"), F.col("props"), F.lit("\n``` end"))).otherwise(F.concat(F.lit("k is "), F.regexp_extract("props", "([0-9]+)", 1)))
    e = table(s, d, "events").select("event_id", wrapped.alias("text"))
    parsed = records.parse_first(F.col("text"), "struct<k:bigint>")
    return e.select("event_id", F.coalesce(parsed["k"], F.regexp_extract("text", "([0-9]+)", 1).cast("long")).alias("k"), parsed.isNotNull().alias("parsed"))


@query("p36_issues", "SELECT event_id, CASE event_type WHEN 'error' THEN 'violation' ELSE 'info' END AS severity, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'issue' END AS code, '' AS message FROM events")
def _(s, d):
    code = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"code":"'), F.col("event_type"), F.lit('"'))).otherwise(F.lit(""))
    j = F.concat(F.lit('[{"severity":"'), F.when(F.col("event_type") == "error", "Violation").otherwise("odd"), F.lit('"'), code, F.lit("}]"))
    return records.normalize_issues(table(s, d, "events").select("event_id", j.alias("j")), "j", ["event_id"]).select("event_id", "severity", "code", "message")


@query("p38_candidates", "SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS target_id, event_type AS summary, CAST(CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS confidence, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n_evidence FROM events WHERE event_id % 7 <> 0")
def _(s, d):
    body = F.concat(
        F.lit('{"targetId":" u'), F.col("user_id").cast("string"), F.lit('","summary":"'), F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("event_type")), F.lit('"'),
        F.when(F.col("event_id") % 2 == 0, "").otherwise(',"confidence":0.25'), F.when(F.col("event_id") % 3 == 0, ',"evidence":[{"ref":"a","detail":"b"},{"ref":"a"}]').otherwise(""), F.lit("}"),
    )
    j = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.concat(F.lit('{"candidates":['), body, F.lit("]}")))
    out = records.parse_candidates(table(s, d, "events").select("event_id", j.alias("j")), "j", ["event_id"])
    return out.select("event_id", "target_id", "summary", "confidence", F.size("evidence").alias("n_evidence"))


@query("p41_quota_errors", "SELECT user_id, arg_min('Rate limit ' || CAST(event_id AS VARCHAR), event_id) AS message FROM events WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    lines = table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("Rate limit "), F.col("event_id").cast("string"))).otherwise("fine").alias("line"))
    return records.quota_errors(lines, "user_id", "event_id", "line")


@query("p42_operation_groups", "SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 'create' WHEN p_size % 3 = 1 THEN 'read' ELSE 'other' END AS operation_group, string_agg(DISTINCT CASE WHEN p_size % 3 = 0 THEN 'add' WHEN p_size % 3 = 1 THEN 'load' ELSE 'run' END || CAST(p_size AS VARCHAR), ',' ORDER BY CASE WHEN p_size % 3 = 0 THEN 'add' WHEN p_size % 3 = 1 THEN 'load' ELSE 'run' END || CAST(p_size AS VARCHAR)) AS methods FROM part GROUP BY ALL")
def _(s, d):
    verb = F.when(F.col("p_size") % 3 == 0, "add").when(F.col("p_size") % 3 == 1, "load").otherwise("run")
    m = table(s, d, "part").select("p_brand", F.concat(verb, F.col("p_size").cast("string")).alias("method"))
    return T.operation_groups(m, ["p_brand"]).withColumn("methods", F.array_join("methods", ","))


@query("s8_html_to_text", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), '(?i)<t[hd][^>]*>', ' | ', 'g'), '(?i)<tr[^>]*>|<br\s*/?>|</p>|</li>|</h[1-6]>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') AS t FROM a),
c AS (SELECT page_id, replace(replace(regexp_replace(regexp_replace(t, '&#[0-9]+;', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '&lt;', '<'), '&gt;', '>') AS t FROM b)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM c""")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5"))


@query("s10_markdown", "SELECT doc_id, md5('# doc ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || CASE WHEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN '_No text extracted._' ELSE regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') END || chr(10)) AS md FROM documents")
def _(s, d):
    title = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(s, d, "documents").select("doc_id", F.md5(T.normalize_markdown(F.col("text"), title)).alias("md"))


@query("r2_section_issues", f"""
WITH {_LINES}, w AS (SELECT doc_id, unnest(['system', 'intent', 'context', 'interfaces', 'data_flows', 'processes', 'rules', 'security']) AS name FROM ({MARKDOWN}))
SELECT doc_id, 'gap' AS severity, 'missing_section' AS code, '#' || name AS source_ref FROM w WHERE (doc_id, name) NOT IN (SELECT (doc_id, name) FROM n)
UNION ALL SELECT doc_id, 'gap', 'empty_section', '#' || name FROM n WHERE raw = '' AND name IN ('system', 'intent', 'rules', 'security')""")
def _(s, d):
    docs = derive(s, d, MARKDOWN)
    return quality.section_issues(docs.select("doc_id"), T.split_sections(docs))


@query("j29_contradictions", "SELECT c_custkey AS doc_id, 'ship ' || lower(c_mktsegment) AS core FROM customer WHERE c_custkey % 3 = 0")
def _(s, d):
    return quality.contradictions(_items(s, d).where("section = 'rules'"))


@query("r4_security_issues", "SELECT c_custkey AS doc_id, 'violation' AS severity, 'security_missing_authentication' AS code FROM customer WHERE c_custkey % 4 <> 0")
def _(s, d):
    return quality.security_issues(T.split_sections(derive(s, d, MARKDOWN)).where("name = 'security'"), "doc_id", "raw")


@query("r5_policy_issues", "SELECT c_custkey AS doc_id, 'violation' AS severity, 'security_policy_violation' AS code, 'token auth' AS requirement FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'violation', 'security_policy_violation', 'encryption' FROM customer")
def _(s, d):
    policy = "require: token auth\n- note\nMust: encryption\nviolation: pages login"
    return quality.policy_issues(T.split_sections(derive(s, d, MARKDOWN)).where("name = 'security'"), "doc_id", "raw", policy)


@query("r6_unreferenced", "SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS item_ord, 'Postgres database' AS item, 'postgres' AS first_word FROM customer")
def _(s, d):
    out = quality.unreferenced(_items(s, d), T.split_sections(derive(s, d, MARKDOWN)))
    return out.select("doc_id", F.col("item_ord").cast("long").alias("item_ord"), "item", "first_word")


@query("r8_quality_issues", "SELECT c_custkey AS doc_id, unnest(['gap', 'warning']) AS severity, unnest(['missing_processes', 'missing_database_schema']) AS code FROM customer")
def _(s, d):
    docs = derive(s, d, MARKDOWN)
    i = _items(s, d).groupBy("doc_id").agg(*(F.count_if(F.col("section") == n).alias(c) for n, c in (("interfaces", "n_interfaces"), ("dependencies", "n_dependencies"), ("processes", "n_processes"), ("security", "n_security"), ("data_flows", "n_flows"), ("modules", "n_modules"))), F.lit(0).alias("n_tables"))
    return quality.quality_issues(docs, i, "doc_id", "text")


@query("r9_diagnostics", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'warning' ELSE 'info' END AS diagnostic, coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS INTEGER) END, 1) AS line FROM events")
def _(s, d):
    from quarry.plans.inputs import ISSUES

    i = derive(s, d, ISSUES).withColumn("source_line", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("int")))
    return quality.diagnostics(i).select("event_id", "diagnostic", "line")


@query("r10_service_smells", f"SELECT file, 'throws exceptions' AS smell, 'info' AS severity FROM ({SOURCES}) WHERE contains(text, 'KafkaListener')")
def _(s, d):
    f = derive(s, d, SOURCES).withColumn("text", F.when(F.contains("text", F.lit("KafkaListener")), F.concat("text", F.lit("throw new OrderException();"))).otherwise(F.col("text")))
    return quality.service_smells(f, "file", "text")


_COLUMNS = """
SELECT 'customer' AS table_name, 'nation_id' AS column_name, c_custkey AS k FROM customer UNION ALL SELECT 'orders', 'customer_id', o_orderkey FROM orders UNION ALL SELECT 'nations', 'region_id', n_nationkey FROM nation UNION ALL SELECT 'orders', 'parent_id', o_orderkey FROM orders UNION ALL SELECT 'customer', 'customer_id', c_custkey FROM customer"""


@query("j18_infer_fks", """
SELECT * FROM (VALUES ('customer', 'nation_id', 'nations'), ('orders', 'customer_id', 'customer'), ('nations', 'region_id', 'regions'), ('orders', 'parent_id', 'orders')) t(from_table, from_column, to_table) WHERE (SELECT count(*) FROM orders) > 0""")
def _(s, d):
    columns = derive(s, d, _COLUMNS).select("table_name", "column_name").distinct()
    tables = columns.select("table_name").union(table(s, d, "region").select(F.lit("regions"))).distinct()
    return schema.infer_fks(columns, tables)


@query("v2_seed_columns", """
WITH t AS (SELECT DISTINCT lower(p_name) || CASE WHEN p_size % 3 = 0 THEN '_notes' WHEN p_size % 3 = 1 THEN '_users' ELSE '' END AS table_name FROM part)
SELECT table_name, unnest(CASE WHEN table_name LIKE '%_notes' THEN ['id', 'title', 'content', 'status', 'owner_id', 'created_at', 'updated_at'] WHEN table_name LIKE '%_users' THEN ['id', 'email', 'display_name', 'role', 'status', 'created_at', 'updated_at'] ELSE ['id', 'name', 'status', 'created_at', 'updated_at'] END) AS column_name FROM t""")
def _(s, d):
    t = table(s, d, "part").select(F.concat(F.lower("p_name"), F.when(F.col("p_size") % 3 == 0, "_notes").when(F.col("p_size") % 3 == 1, "_users").otherwise("")).alias("table_name")).distinct()
    return schema.seed_columns(t).select("table_name", "column_name")


@query("v3_table_from_text", "SELECT doc_id, CASE WHEN contains(lower(text), 'note') THEN 'notes' WHEN contains(lower(text), 'user') THEN 'users' WHEN contains(lower(text), 'order') THEN 'orders' END AS table_name FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A Note' WHEN 1 THEN 'user of' WHEN 2 THEN 'Orders' ELSE 'zzz' END AS text FROM documents)")
def _(s, d):
    k = F.col("doc_id") % 4
    return table(s, d, "documents").select("doc_id", schema.table_from_text(F.when(k == 0, "A Note").when(k == 1, "user of").when(k == 2, "Orders").otherwise("zzz")).alias("table_name"))


@query("v1_infer_tables", """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'declared' WHEN c_custkey % 3 = 1 THEN 'orders' ELSE 'records' END AS table_name FROM customer""")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 == 1, "all orders").otherwise("zz").alias("text"))
    explicit = c.where("doc_id % 3 = 0").select("doc_id", F.lit("declared").alias("table_name"))
    return schema.infer_tables(explicit, c.where("doc_id % 3 = 0").select("doc_id", F.lit("hinted").alias("table_name")), c)


@query("v5_schema_summary", "SELECT c_nationkey, format('{} tables, {} columns', count(DISTINCT c_mktsegment), count(*)) AS summary FROM customer GROUP BY 1")
def _(s, d):
    return schema.schema_summary(table(s, d, "customer").select("c_nationkey", F.col("c_mktsegment").alias("table_name")), ["c_nationkey"]).select("c_nationkey", "summary")
