"""Queries of the predicates and of the remaining projections and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import names as N
from quarry.operators import predicates as P
from quarry.operators import quality, records, schema
from quarry.operators import text as T
from quarry.plans.inputs import MARKDOWN, NODES, SOURCES, derive, table
from quarry.plans.registry import query
from quarry.plans.stream_queries import _folder
from quarry.sources import corpus


@query("f3_complex_docs", f"SELECT doc_id, contains(lower(text), 'gateway') AND doc_id % 2 = 0 AS complex FROM ({MARKDOWN})")
def _(s: SparkSession, d: str) -> DataFrame:
    counts = {c: F.when(F.col("doc_id") % 2 == 0, 9).otherwise(0) for c in quality.COMPLEX_LIMITS}
    return derive(s, d, MARKDOWN).withColumns(counts).select("doc_id", quality.is_complex(F.col("text")).alias("complex"))


@query("f4_entity_like", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN false WHEN p_size % 4 = 1 THEN true WHEN p_type = 'PROMO' THEN true ELSE false END AS entity FROM part")
def _(s, d):
    k = F.col("p_size") % 4
    path = F.when(k == 0, "src/repository/X.java").otherwise("src/x/X.java")
    notes = F.when(k == 1, F.array(F.lit("Entity"))).otherwise(F.array().cast("array<string>"))
    hints = F.when(F.col("p_type") == "PROMO", F.array(F.lit("@Column"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "part").select("p_partkey", P.is_entity_like(path, F.lit("a.b"), notes, F.lit("component"), hints).alias("entity"))


@query("f5_http_contracts", "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0")
def _(s, d):
    p = table(s, d, "part")
    package = F.when(F.col("p_size") % 2 == 0, "com.shop.api").otherwise("com.shop.web")
    types = F.array(F.when(F.col("p_partkey") % 3 == 0, "PartApi").otherwise("ApiPart"))
    return p.where(P.is_http_contract(package, F.lit("x"), types)).select("p_partkey")


@query("f6_in_scope", f"SELECT file FROM ({SOURCES}) WHERE file LIKE 'src/brand1/%'")
def _(s, d):
    return derive(s, d, SOURCES).where(P.in_scope(F.col("file"), F.lit("src/brand1"))).select("file")


@query("f7_scope_items", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'warm' WHEN contains(p_name, 'blue') THEN 'cold' ELSE 'any' END AS app FROM part")
def _(s, d):
    return P.scope_items(table(s, d, "part"), "p_name", [("warm", "red"), ("cold", "blue")], "any").select("p_partkey", "app")


@query("f8_topics", "SELECT c_custkey, c_custkey % 2 = 0 AS is_bug_fix, c_custkey % 2 = 1 AS is_db, false AS is_test FROM customer")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "Fix it").otherwise("Add a tábla").alias("text"))
    return P.topics(c, ["c_custkey"], "text").select("c_custkey", "is_bug_fix", "is_db", "is_test")


@query("f11_completeness", "SELECT event_id, 'missing model' AS issue FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'missing evidence' FROM events")
def _(s, d):
    from quarry.operators.records import EVIDENCE

    c = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "").otherwise("m").alias("model"), F.lit(0.5).alias("confidence"), F.array().cast(EVIDENCE).alias("evidence"), F.lit("t").alias("target_id"))
    return records.candidate_issues(c, ["event_id"])


@query("f12_class_index", "SELECT p_partkey, 'Service' AS annotations, p_name AS methods FROM part WHERE p_size % 3 = 0")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.array(F.when(F.col("p_size") % 3 == 0, "Service").otherwise("Bean")).alias("annotations"), F.array("p_name").alias("methods"))
    return P.class_index(p, ["p_partkey"], "annotations", "methods", ["Service", "Controller"]).withColumns({c: F.array_join(c, ",") for c in ("annotations", "methods")})


@query("f13_artifact_files", "SELECT p_partkey, 'a.json' AS names FROM part")
def _(s, d):
    v = table(s, d, "part").select("p_partkey", F.create_map(F.lit("graph"), F.lit("a.json"), F.lit("doc"), F.lit("a.md")).alias("files"))
    return corpus.artifact_files(v, "files", {"json": r"\.json$", "text": r"\.md$"}, "json").select("p_partkey", F.array_join(F.map_values("files"), ",").alias("names"))


@query("j28_triage", "SELECT user_id, event_type AS record, count(*) AS n FROM events WHERE value > 10 GROUP BY ALL")
def _(s, d):
    runs = table(s, d, "events").select("user_id", F.when(F.col("value") > 10, "triage").otherwise("scan").alias("kind"), F.array("event_type").alias("records"))
    return P.triage(runs, ["user_id"], "kind", "triage", "records").groupBy("user_id", "record").agg(F.count("*").alias("n"))


@query("j31_attach_review", "SELECT c_custkey, o_orderkey AS reviewed FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(s, d):
    reviews = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return P.attach_review(table(s, d, "customer").select("c_custkey"), reviews, "c_custkey").select("c_custkey", F.col("review.o_orderkey").alias("reviewed"))


@query("p15_config_keywords", f"SELECT DISTINCT file, unnest(list_filter(['kafka', 'shop', 'redis'], lambda w: contains(lower(text), w))) AS keyword FROM ({SOURCES})")
def _(s, d):
    rules = [quality.Rule(w, f"(?i){w}", "keyword") for w in ("kafka", "shop", "redis")]
    f = derive(s, d, SOURCES)
    return quality.apply_rules(f, ["file"], F.col("text"), rules).select("file", F.col("rule_id").alias("keyword"))


@query("p29_schedules", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '0 0 * * *' ELSE 'scheduled' END AS schedule FROM part WHERE p_size % 3 = 0")
def _(s, d):
    text = F.when(F.col("p_size") % 3 != 0, "class A").when(F.col("p_size") % 2 == 0, '@Scheduled(cron = "0 0 * * *")').otherwise("@Scheduled(fixedRate = 5)")
    return T.schedules(table(s, d, "part").select("p_partkey", text.alias("text")), "p_partkey")


@query("p32_flow_scenarios", """
WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS o FROM part WHERE p_size % 2 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY o) AS ord FROM f)
SELECT p_brand, CAST(ord AS BIGINT) AS ord, p_name AS summary FROM r WHERE ord <= 6 UNION ALL SELECT DISTINCT p_brand, 1, 'no scenario' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM f)""")
def _(s, d):
    t = table(s, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("text"))
    return T.flow_scenarios(t, "p_brand", ["p_partkey"]).select("p_brand", F.col("ord").cast("long").alias("ord"), "summary")


@query("p37_schema_json", "SELECT s_suppkey, 't' || CAST(s_suppkey AS VARCHAR) AS table_name, 'id' AS primary_key, unnest(['a', 'b']) AS column_name, unnest(['uuid', 'string']) AS type FROM supplier")
def _(s, d):
    j = F.concat(F.lit('{"tables":[{"name":"t'), F.col("s_suppkey").cast("string"), F.lit('","columns":[{"name":"a","type":"uuid"},{"name":"b"}]}]}'))
    out = records.normalize_schema_json(table(s, d, "supplier").select("s_suppkey", j.alias("j")), "j", ["s_suppkey"])
    return out.select("s_suppkey", "table_name", F.array_join("primary_key", ",").alias("primary_key"), "column_name", "type")


@query("p39_agent_records", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END AS record_id, CASE WHEN event_id % 3 = 0 THEN 'unparsed answer' ELSE 's' END AS summary FROM events")
def _(s, d):
    key = F.when(F.col("event_id") % 3 == 1, "items").otherwise("findings")
    j = F.when(F.col("event_id") % 3 == 0, F.lit("{oops")).otherwise(F.concat(F.lit('{"'), key, F.lit('":[{"id":"'), F.col("event_type"), F.lit('","summary":"s"}]}')))
    return records.parse_agent_records(table(s, d, "events").select("event_id", j.alias("j")), "j", ["event_id"]).select("event_id", "record_id", "summary")


@query("p40_stream_text", "SELECT conv_id, turn, 'say' || chr(10) || '[tool] grep' AS text FROM conversations WHERE role = 'assistant'")
def _(s, d):
    j = F.concat(F.lit('{"type":"'), F.col("role"), F.lit('","message":{"content":[{"type":"text","text":"say"},{"type":"tool_use","name":"grep"}]}}'))
    return records.stream_text(table(s, d, "conversations").select("conv_id", "turn", j.alias("j")), "j", ["conv_id", "turn"])


@query("p43_repositories", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'jpa' ELSE 'jdbc' END AS style, CASE WHEN p_size % 2 = 0 THEN 'Part' END AS entity FROM part")
def _(s, d):
    text = F.when(F.col("p_size") % 2 == 0, "interface R extends JpaRepository<Part, Long> { }").otherwise("class R { JdbcTemplate t; PartMapper m; }")
    f = table(s, d, "part").select(F.concat(F.lit("x/P"), F.col("p_partkey").cast("string"), F.lit("Repository.java")).alias("file"), text.alias("text"))
    return T.repository_catalog(f).select(F.regexp_extract("file", r"P(\d+)R", 1).cast("long").alias("p_partkey"), "style", "entity")


@query("p44_mappers", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'row' ELSE 'dto' END AS mapper_kind FROM part")
def _(s, d):
    text = F.when(F.col("p_size") % 2 == 0, "class M implements RowMapper<X> { }").otherwise("class M { }")
    f = table(s, d, "part").select(F.concat(F.lit("x/P"), F.col("p_partkey").cast("string"), F.lit("Mapper.java")).alias("file"), text.alias("text"))
    return T.mapper_catalog(f).select(F.regexp_extract("file", r"P(\d+)M", 1).cast("long").alias("p_partkey"), "mapper_kind")


@query("r7_layering", "SELECT c_custkey AS doc_id, 'warning' AS severity, 'service_layer_contains_local_dtos' AS code FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'warning', 'event_contracts_split_across_layers' FROM customer WHERE c_custkey % 3 = 1")
def _(s, d):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "- SERVICE: local DTOs").when(k == 1, "- EVENTS: types\n- SERVICE: events").otherwise("- fine")
    return quality.layering_issues(table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")), "doc_id", "text")


@query("r1_rule_table", "SELECT p_partkey, needle AS rule_id FROM part JOIN (SELECT DISTINCT substr(p_name, 1, 3) AS needle FROM part) ON contains(p_name, needle)")
def _(s, d):
    p = table(s, d, "part")
    rules = p.select(F.substring("p_name", 1, 3).alias("needle")).distinct().select("needle", F.col("needle").alias("rule_id"), F.lit("hit").alias("output"))
    hits = quality.apply_rule_table(p.select("p_name").distinct().withColumn("text", F.col("p_name")), ["p_name"], "text", rules)
    return p.join(hits, "p_name").select("p_partkey", "rule_id")


@query("v4_relationships", "SELECT * FROM (VALUES ('orders', 'customer_id', 'customer', 'inferred'), ('orders', 'note_id', 'notes', 'declared')) t(from_table, from_column, to_table, origin) WHERE (SELECT count(*) FROM orders) > 0")
def _(s, d):
    columns = table(s, d, "orders").select(F.lit("orders").alias("table_name"), F.lit("customer_id").alias("column_name")).distinct()
    tables = columns.select("table_name").union(table(s, d, "customer").select(F.lit("customer")).distinct())
    declared = columns.select(F.lit("orders").alias("from_table"), F.explode(F.array(F.lit("customer_id"), F.lit("note_id"))).alias("from_column"))
    declared = declared.withColumns({"to_table": F.when(F.col("from_column") == "note_id", "notes").otherwise("customer"), "to_column": F.lit("id")})
    return schema.relationships(columns, tables, declared).select("from_table", "from_column", "to_table", "origin")


@query("v6_fallback_tables", "SELECT lower(c_mktsegment) AS table_name, unnest(['id', 'name', 'created_at']) AS column_name FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def _(s, d):
    names = table(s, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("Repository.java")).alias("name")).distinct()
    return schema.fallback_tables(names).select("table_name", "column_name")


@query("s2_top_level", f"SELECT DISTINCT split_part(substr(file, 5), '/', 1) AS name, true AS is_dir FROM ({SOURCES})")
def _(s, d):
    return corpus.top_level(derive(s, d, SOURCES).select(F.substring("file", 5, 200).alias("rel")))


@query("s3_markdown_folder", "SELECT CAST(n_nationkey % 5 AS VARCHAR) || '.md' AS kind, count(*) AS n FROM nation GROUP BY 1")
def _(s, d):
    folder = _folder(s)
    rows = table(s, d, "nation").select((F.col("n_nationkey") % 5).cast("string").alias("k"), F.concat(F.lit("# "), "n_name").alias("value"))
    rows.repartition(1).write.partitionBy("k").text(f"{folder}/md")
    # Part files of the writer stand for imported documents, one line each.
    files = s.read.text(f"{folder}/md", recursiveFileLookup=True).select(F.regexp_extract("_metadata.file_path", r"k=(\d)", 1).alias("k"), "value")
    return files.groupBy(F.concat("k", F.lit(".md")).alias("kind")).agg(F.count("*").alias("n"))


@query("s4_artifact_json", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _(s, d):
    folder = _folder(s)
    table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.json(f"{folder}/json")
    missing = corpus.read_artifact(s, f"{folder}/none", "id int, name string")
    return s.read.schema("id int, name string").json(f"{folder}/json").union(missing)


@query("s9_storage_to_text", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'kept body' ELSE 'view' END AS origin FROM pages")
def _(s, d):
    view = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("html"))
    storage = F.lit('<ac:structured-macro name="x"><ac:parameter>gone</ac:parameter><ac:rich-text-body><p>kept  body</p></ac:rich-text-body></ac:structured-macro>')
    out = table(s, d, "pages").select("page_id", T.storage_to_text(view, storage).alias("text"))
    return out.select("page_id", F.when(F.col("text") == "kept body", F.col("text")).otherwise("view").alias("origin"))


@query("c2_artifact_names", f"SELECT id, replace(replace(name, '#', '-'), ' ', '-') AS artifact FROM ({NODES})")
def _(s, d):
    return derive(s, d, NODES).select("id", N.artifact_name("name").alias("artifact"))


@query("c5_humanized", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title, upper(substr(p_brand, 1, 1)) || substr(p_brand, 2) AS brand FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", N.humanize("p_name").alias("title"), N.humanize("p_brand").alias("brand"))


@query("c19_version_ids", "SELECT event_id, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H-%M-%S-%g') || 'Z' AS version_id FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", N.version_id("ts").alias("version_id"))
