"""Queries of the scalar functions that no other query proves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import names as N
from quarry.functions import roles as P
from quarry.plans.inputs import SOURCES, derive, table
from quarry.plans.registry import query


def _case(x: str, rules: P.Rules, default: str | None = None) -> str:
    """The oracle's form of an ordered rule table."""
    tests = " ".join(f"WHEN regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{t}'" for t, p in rules if p)
    last = next((t for t, p in rules if not p), default)
    return f"CASE {tests} ELSE {'NULL' if last is None else chr(39) + last + chr(39)} END"


@query("c6_normalized_text", r"SELECT doc_id, trim(regexp_replace(lower(text), '[\t\n\v\f\r ]+', ' ', 'g'), ' ') AS normal FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", N.normalize_text("text").alias("normal"))


@query("c20_artifact_kinds", f"""
SELECT p_partkey, CASE WHEN contains(text, '@RestController') THEN 'controller' WHEN contains(text, '@Service') OR ends_with(file, 'Service.java') THEN 'service'
  WHEN contains(text, '@PreAuthorize') THEN 'security' WHEN contains(text, '@KafkaListener') THEN 'listener' ELSE 'component' END AS kind FROM ({SOURCES})""")
def _(s, d):
    return derive(s, d, SOURCES).select("p_partkey", N.artifact_kind("text", "file").alias("kind"))


@query("c22_node_types", f"""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Service' ELSE 'Controller' END AS node_type, CASE p_size % 4 WHEN 0 THEN 'SecurityComponent' WHEN 1 THEN 'WebSocketComponent' WHEN 2 THEN 'JavaType' ELSE 'Job' END AS other FROM part""")
def _(s, d):
    kinds = derive(s, d, SOURCES).join(table(s, d, "part").select("p_partkey", "p_size"), "p_partkey")
    other = N.mapped((F.col("p_size") % 4).cast("string"), {"0": "security", "1": "websocket", "2": "component"}, "job")
    return kinds.select("p_partkey", P.node_type(N.artifact_kind("text", "file")).alias("node_type"), P.node_type(other).alias("other"))


_PLACES = "SELECT p_partkey, p_size, 'com.shop.' || lower(replace(p_brand, '#', '')) || CASE p_size % 5 WHEN 0 THEN '.service' WHEN 1 THEN '.web' WHEN 2 THEN '.jobs' WHEN 3 THEN '.security' ELSE '' END AS package, CASE p_size % 3 WHEN 0 THEN 'src/jobs/Part.java' WHEN 1 THEN 'src/listeners/Part.java' ELSE 'src/main/Part.java' END AS file FROM part"


@query("c23_package_families", f"""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'service' WHEN 1 THEN 'web' WHEN 3 THEN 'security' ELSE CASE p_size % 3 WHEN 0 THEN 'jobs' WHEN 1 THEN 'listeners' ELSE 'other' END END AS family,
  CASE p_size % 5 WHEN 0 THEN 'service' WHEN 1 THEN 'web' WHEN 3 THEN 'security' ELSE CASE WHEN p_size % 3 = 1 THEN 'listener' WHEN p_size % 5 = 2 OR p_size % 3 = 0 THEN 'job' END END AS layer FROM ({_PLACES})""")
def _(s, d):
    return derive(s, d, _PLACES).select("p_partkey", P.package_family("package", "file").alias("family"), P.layer_hint("package", "file").alias("layer"))


_NAMES = """SELECT c_custkey, c_nationkey, CASE c_nationkey % 7 WHEN 0 THEN 'OrderRepository' WHEN 1 THEN 'OrderMapper' WHEN 2 THEN 'AccessGuard' WHEN 3 THEN 'OrderPublisher' WHEN 4 THEN 'BankClient' WHEN 5 THEN 'OrderService' ELSE 'Order' END AS name FROM customer"""


@query("c25_collaborator_roles", f"""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'controller' ELSE CASE c_nationkey % 7 WHEN 0 THEN 'repository' WHEN 1 THEN 'mapper' WHEN 2 THEN 'validator' WHEN 3 THEN 'event-publisher'
  ELSE CASE WHEN c_custkey % 3 = 0 THEN 'event-publisher' WHEN c_nationkey % 7 = 4 THEN 'external-client' WHEN c_nationkey % 7 = 5 THEN 'service' ELSE 'helper' END END END AS role FROM ({_NAMES})""")
def _(s, d):
    kind = F.when(F.col("c_custkey") % 4 == 0, "controller").when(F.col("c_custkey") % 4 == 1, "component")
    return derive(s, d, _NAMES).select("c_custkey", N.collaborator_role("name", kind, F.col("c_custkey") % 3 == 0).alias("role"))


_LABELS = """SELECT c_custkey, c_name || CASE c_nationkey % 8 WHEN 0 THEN 'Status' WHEN 1 THEN 'oauth userinfo' WHEN 2 THEN 'Client' WHEN 3 THEN 'mail s3' WHEN 4 THEN 'security.yml' WHEN 5 THEN 'commonUtil' WHEN 6 THEN 'kafka' ELSE '' END AS label FROM customer"""


@query("c26_purposes", f"""
SELECT c_custkey, {_case("label", P.ENUM_PURPOSES)} AS enum_purpose, {_case("label", P.CLIENT_PURPOSES)} AS client_purpose, {_case("label", P.CONFIG_FILE_PURPOSES)} AS file_purpose,
  {_case("label", P.CONFIG_TYPE_PURPOSES)} AS type_purpose, {_case("label", P.MODULE_ROLES)} AS module_role FROM ({_LABELS})""")
def _(s, d):
    tables = {"enum_purpose": P.ENUM_PURPOSES, "client_purpose": P.CLIENT_PURPOSES, "file_purpose": P.CONFIG_FILE_PURPOSES, "type_purpose": P.CONFIG_TYPE_PURPOSES, "module_role": P.MODULE_ROLES}
    return derive(s, d, _LABELS).select("c_custkey", *(P.described("label", rules).alias(name) for name, rules in tables.items()))


@query("c26_module_purposes", f"""
SELECT c_custkey, CASE c_nationkey % 7 WHEN 0 THEN 'handle order persistence operations' WHEN 6 THEN 'handle order persistence operations' WHEN 4 THEN 'keep bank contacts' ELSE 'handle ' || CASE c_nationkey % 7 WHEN 1 THEN 'order mapper' WHEN 2 THEN 'access guard' WHEN 3 THEN 'order publisher' ELSE 'order service' END || ' persistence operations' END AS repository,
  CASE c_nationkey % 4 WHEN 0 THEN 'persistence adapters and database queries' WHEN 1 THEN 'HTTP/web ingress handling' WHEN 2 THEN 'database migration scripts' ELSE 'application-internal component bucket' END AS inner_module FROM ({_NAMES})""")
def _(s, d):
    part = N.mapped((F.col("c_nationkey") % 4).cast("string"), {"0": "Repo", "1": " Web ", "2": "db/migration"}, "misc")
    return derive(s, d, _NAMES).select("c_custkey", P.repository_purpose("name", [("keep bank contacts", "bank")]).alias("repository"), P.inner_module_purpose(part).alias("inner_module"))


@query("c27_external_dependencies", f"""SELECT c_custkey, {_case("trim(label)", P.EXTERNAL_SYSTEMS)} AS dependency FROM ({_LABELS})""")
def _(s, d):
    return derive(s, d, _LABELS).select("c_custkey", P.external_dependency("label").alias("dependency"))


@query("c28_titles_and_generics", """
SELECT p_partkey, p_name AS service, 'List' AS plain, lower(substr(p_type, 1, 1)) || substr(p_type, 2) AS camel FROM part""")
def _(s, d):
    p = table(s, d, "part")
    return p.select(
        "p_partkey", N.service_from_title(F.concat("p_name", F.lit(" With "), "p_brand")).alias("service"), N.strip_generic(F.concat(F.lit("List<Map<"), "p_type", F.lit(">> "))).alias("plain"), N.lower_camel("p_type").alias("camel")
    )


@query("c7_cut_names", """
SELECT c_custkey, '...' || right(c_name, 4) AS tail, lower(c_mktsegment) || '/' || c_name AS rel, replace(lower(c_name), '#', '-') AS safe,
  CASE c_nationkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'collection' WHEN 2 THEN 'timestamp' ELSE 'customer' END AS java_type, CASE c_nationkey % 3 WHEN 0 THEN 'kafka-listener' WHEN 1 THEN 'jms-listener' ELSE 'event-handler' END AS listener FROM customer""")
def _(s, d):
    c, k = table(s, d, "customer"), F.col("c_nationkey")
    return c.select(
        "c_custkey", N.keep_tail("c_name", 4).alias("tail"), N.relative_path(F.concat(F.lit("root\\docs/"), F.lower("c_mktsegment"), F.lit("\\"), "c_name"), "root/docs").alias("rel"), N.sanitize_name("c_name").alias("safe"),
        N.java_type(N.mapped((k % 4).cast("string"), {"0": "BigDecimal", "1": "List<String>", "2": "LocalDate"}, "Customer")).alias("java_type"),
        N.listener_kind(N.mapped((k % 3).cast("string"), {"0": "@KafkaListener", "1": "JmsTemplate"}, "@EventListener")).alias("listener"),
    )


@query("c9_simple_names", """
SELECT p_partkey, 'Part' || CAST(p_partkey AS VARCHAR) AS simple, p_name || '.java' AS base,
  CASE p_size % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'uuid' WHEN 3 THEN 'json' WHEN 4 THEN 'string' END AS column_type FROM part""")
def _(s, d):
    p, key = table(s, d, "part"), F.col("p_partkey").cast("string")
    kind = N.mapped((F.col("p_size") % 6).cast("string"), {"0": "NUMERIC(10, 2)", "1": "TIMESTAMPTZ", "2": "owner_id", "3": "JSONB", "4": "VARCHAR (20)"}, "geometry")
    return p.select(
        "p_partkey", N.simple_name(F.concat(F.lit(" com.shop."), F.lower("p_type"), F.lit(".Part"), key)).alias("simple"), N.base_name(F.concat(F.lit("src\\"), "p_brand", F.lit("/"), "p_name", F.lit(".java"))).alias("base"),
        N.column_type(kind).alias("column_type"),
    )
