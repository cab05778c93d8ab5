"""What a validation run leaves to do, and what an application needs to run, as rows of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import base_name, mapped
from quarry.operators.relational import top_k

#: Hint of each issue code, and the hint of a document without tables, warnings and violations.
HINTS = {
    "missing_section": "Add the missing semantic section explicitly so the MCP validator can anchor the expectation.",
    "missing_modules": "Add explicit module boundaries when the slice is layered or enterprise-like.",
    "missing_database_schema": "Describe tables, keys, and relationships in the semantic source so DB schema inference has stable anchors.",
    "security_missing_authentication": "Make authentication explicit in the security section and in the affected flows.",
    "security_missing_authorization": "Make authorization, ownership, and write access rules explicit.",
    "dependency_unreferenced": "Reference dependencies from the processes or interfaces that actually use them.",
}
NO_SCHEMA = "No database schema was inferred; consider adding explicit persistence terminology if storage should be modeled."
LAYERS_MOST = 12


def graph_signals(docs: DataFrame, nodes: DataFrame, edges: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_nodes, n_edges, n_tables) of each document's graph."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    out = docs.select(key).distinct()
    for df, name in ((nodes, "n_nodes"), (edges, "n_edges"), (tables, "n_tables")):
        out = out.join(count(df, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def validation_delta(docs: DataFrame, issues: DataFrame, nodes: DataFrame, edges: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part, value), each once: missing sections, schema gaps, persistence signals, review targets, hints and layers.

    docs(key), issues(key, severity, code, message, source_ref, source_line), nodes(key, type, ord), edges(key), tables(key).
    Layers are the first twelve node types. A document without issues may have a hint still: that it has no tables."""
    code, message = F.coalesce("code", F.lit("issue")), F.col("message")
    section = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(message, F.lit("")), r'(?i)^Required section\s+"?', ""), r'(?i)"?\s+is missing\.?$', ""))
    found = {
        "missing_section": F.when(code == "missing_section", section),
        "schema_gap": F.when(code == "missing_database_schema", F.coalesce(message, F.lit("Database schema inference gap"))),
        "persistence_signal": F.when(code.isin("dependency_unreferenced", "missing_database_schema"), F.coalesce(message, code)),
        "review_target": F.coalesce("source_ref", F.col("source_line").cast("string"), "code", F.lit("unknown")),
        "hint": mapped(code, HINTS),
    }
    rows = issues.select(key, F.inline(F.array(*(F.struct(F.lit(p).alias("part"), v.alias("value")) for p, v in found.items()))))
    loud = issues.where("severity IN ('warning', 'violation')").select(key).distinct()
    quiet = graph_signals(docs, nodes, edges, tables, key).where("n_tables = 0").join(loud, key, "left_anti").select(key, F.lit("hint").alias("part"), F.lit(NO_SCHEMA).alias("value"))
    kinds = nodes.where("type <> ''").groupBy(key, F.col("type").alias("value")).agg(F.min("ord").alias("at"))
    layers = top_k(kinds, [key], ["at", "value"], LAYERS_MOST).select(key, F.lit("layer").alias("part"), "value")
    return rows.where("value <> ''").union(quiet).union(layers).distinct()


#: Runtime features by the text of configuration and build files; external systems by a file's name or text.
CONFIG_FEATURES = [
    ("Flyway incremental database migrations", r"(?i)spring:\s*[\s\S]*flyway:"), ("Actuator runtime endpoints", "(?i)management:|actuator"),
    ("Datasource bootstrap configuration", r"(?i)spring:\s*[\s\S]*datasource:"), ("Redis runtime configuration", r"(?i)spring:\s*[\s\S]*redis:"),
]
BUILD_FEATURES = [("Actuator runtime endpoints", "(?i)spring-boot-starter-actuator"), ("Flyway incremental database migrations", "(?i)flyway-core|flyway-database-postgresql")]
CONFIG_SYSTEMS = [
    ("Mail service", "mail", r"spring:\s*[\s\S]*mail:|javamailsender|smtp|from-address"), ("MinIO / object storage", "minio", "minio|s3|bucket|endpoint:"), ("Redis", None, r"spring:\s*[\s\S]*redis:|redis:|lettuce|jedis"),
    ("External auth providers", "security", "oauth|oidc|turnstile|issuer|jwks|auth-provider|google|facebook|apple"), ("WebSocket", None, "websocket|sockjs|stomp"), ("Message broker / event stream", None, "kafka|rabbitmq|amqp|mqtt|nsq"),
]
ENTRY_FEATURE, SCAN_FEATURE = "Spring Boot application entry point", "Configuration properties scanning"


def runtime_summary(types: DataFrame, configs: DataFrame, builds: DataFrame) -> DataFrame:
    """(project, part, value), each once: entry_point and bootstrap (of the first application class), feature, config, bean,
    security and external.

    types(project, file, package, type_name, annotations, methods, method_annotations, ord), lists as arrays; only types of
    the application module count. configs(project, file, text) are its resources, builds(project, file, text) its builds."""
    on = lambda column, words: F.coalesce(F.exists(column, lambda a: a.rlike(f"(?i){words}")), F.lit(False))
    text = F.coalesce("text", F.lit(""))
    rows = lambda df, found: df.select("project", F.inline(F.array(*(F.struct(F.lit(p).alias("part"), v.alias("value")) for p, v in found))))
    app = types.where(F.coalesce(F.col("file").rlike("(?i)/app/"), F.lit(False)) | F.coalesce(F.col("package").rlike(r"(?i)\.app(\.|$)"), F.lit(False)))
    boots = on("annotations", "SpringBootApplication") & F.coalesce(F.array_contains("methods", "main"), F.lit(False))
    first = app.where(boots).groupBy("project").agg(F.min_by("type_name", "ord").alias("boot"))
    guarded = on("annotations", "Configuration") & (F.col("file").rlike("(?i)security") | F.col("type_name").rlike("(?i)security"))
    own = rows(app, [("feature", F.when(on("annotations", "ConfigurationPropertiesScan"), SCAN_FEATURE)), ("security", F.when(guarded, F.col("type_name"))), ("bean", F.when(on("method_annotations", "Bean"), F.col("type_name")))])
    entry = rows(first, [("entry_point", F.concat(F.col("boot"), F.lit(".main"))), ("bootstrap", F.col("boot")), ("feature", F.lit(ENTRY_FEATURE))])
    name, low = base_name("file"), F.lower(text)
    has = lambda word: F.contains(F.lower(name), F.lit(word)) if word else F.lit(False)
    config: list[tuple[str, Column]] = [("config", name), ("security", F.when(has("security") | text.rlike("(?i)jwt|turnstile|issuer"), name))]
    config += [("feature", F.when(text.rlike(p), f)) for f, p in CONFIG_FEATURES] + [("external", F.when(has(w) | low.rlike(p), s)) for s, w, p in CONFIG_SYSTEMS]
    read = rows(configs.where(F.col("file").rlike("(?i)/app/src/main/resources/")), config)
    built = rows(builds.where(F.col("file").rlike(r"(?i)/app/pom\.xml$")), [("feature", F.when(text.rlike(p), f)) for f, p in BUILD_FEATURES])
    return reduce(DataFrame.union, [own, entry, read, built]).where("value IS NOT NULL").distinct()
