"""What belongs to an application: its contracts, layers, flows and parse counts, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import simple_name
from quarry.operators.aggregates import auth_mode
from quarry.operators.linking import contains_pairs
from quarry.operators.relational import ranks, top_k

_REQUIREMENT = r'@SecurityRequirement\s*\(\s*name\s*=\s*"([^"]+)"'
_TAG = r'@Tag\s*\(\s*name\s*=\s*"([^"]+)"'
#: Who may call, by words of a contract in lower case; what its text says about checks and descriptions.
PERMISSIONS = [
    ("owner access", r"\bowner\b|tulajdonos"), ("admin access", r"\badmin\b|jogosultság szükséges|organizer admin"), ("moderator access", r"\bmoderator\b"),
    ("authenticated user", r"\bauthenticated\b|bejelentkez"), ("public access", r"\bpublic\b|nyilvános|permitall"),
]
VALIDATED = r"(?i)@Validated\b|@Valid\b|jakarta\.validation"
DESCRIBED = r"(?i)io\.swagger|@Operation\b|@Tag\b|@ApiResponse\b"
SWAGGER = r"(?i)io\.swagger|swagger-ui|OpenAPI"
GENERATED = r"(?i)openapi generator|org\.openapitools\.codegen"
CONTRACT_FILE = r"openapi\.yaml$|event-api\.yaml$"


def _gathered(rows: DataFrame, keys: list[str], order: str, value: str, k: int, name: str) -> DataFrame:
    """The k first values of each key as an array, in order."""
    few = F.array_sort(F.collect_list(F.struct(order, value)))
    return top_k(rows, keys, [order, value], k).groupBy(*keys).agg(F.transform(few, lambda x: x[value]).alias(name))


def api_surface(contracts: DataFrame, endpoints: DataFrame, enums: DataFrame, samples: int = 4, dtos: int = 12, enum_names: int = 8) -> DataFrame:
    """One row per contract: family, endpoints, who may call, and the types that it takes and gives.

    contracts(project, file, type_name, imports, text), imports an array; endpoints(project, type_name, method, path, ord);
    enums(project, name). Contracts without text are left out. A family is the tag, else the type without its `Api`, else
    `API`; endpoints join it by their type. Imported names are enums where `enums` has them, else transfer types where
    their package says so; the k first of each are given, each name once."""
    found = F.regexp_extract_all("text", F.lit(_REQUIREMENT), 1)
    named = F.coalesce(F.nullif(F.trim(F.regexp_extract("text", _TAG, 1)), F.lit("")), F.regexp_replace("type_name", "Api$", ""), F.lit("API"))
    hints = F.filter(F.array(*(F.when(F.lower("text").rlike(p), h) for h, p in PERMISSIONS)), lambda x: x.isNotNull())
    base = contracts.where("text <> ''").select(
        "project", "file", "imports", named.alias("family"), F.size(found).alias("n_protected"), F.array_distinct(found).alias("schemes"), hints.alias("permissions"),
        F.col("text").rlike(VALIDATED).alias("validated"), F.col("text").rlike(DESCRIBED).alias("described"),
    )
    calls = endpoints.select("project", F.regexp_replace(F.coalesce("type_name", F.lit("")), "Api$", "").alias("family"), F.concat_ws(" ", "method", "path").alias("call"), "ord")
    counts = calls.groupBy("project", "family").agg(F.count("*").alias("n"))
    first = _gathered(calls, ["project", "family"], "ord", "call", samples, "samples").withColumn("samples", F.array_distinct("samples"))
    used = base.select("project", "file", F.posexplode("imports").alias("at", "import")).withColumn("name", simple_name("import"))
    known = enums.select("project", "name", F.lit("enum").alias("part")).distinct()
    role = F.coalesce("part", F.when(F.col("import").rlike(r"(?i)\.dto\."), "dto"))
    roles = used.join(known, ["project", "name"], "left").withColumn("part", role).where("part IS NOT NULL").groupBy("project", "file", "part", "name").agg(F.min("at").alias("at"))
    none = F.array().cast("array<string>")
    out = base.drop("imports").join(counts, ["project", "family"], "left").join(first, ["project", "family"], "left")
    for part, k, name in (("dto", dtos, "dto_types"), ("enum", enum_names, "enum_types")):
        out = out.join(_gathered(roles.where(F.col("part") == part), ["project", "file"], "at", "name", k, name), ["project", "file"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    mode = F.when((n == 0) & (F.col("n_protected") > 0), "mixed").otherwise(auth_mode(F.col("n_protected"), n))
    lists = [F.coalesce(c, none).alias(c) for c in ("samples", "schemes", "permissions", "dto_types", "enum_types")]
    return out.select("project", "file", "family", n.alias("n_endpoints"), "n_protected", mode.alias("auth"), *lists, "validated", "described")


def api_flags(contracts: DataFrame, files: DataFrame) -> DataFrame:
    """(project, contract_source, swagger, generated, validated) of each project that has a file. contracts as above;
    files(project, file) are all files, descriptions included."""
    text = F.coalesce("text", F.lit(""))
    said = contracts.select("project", F.col("file").rlike("OpenApiConfig").alias("config"), F.lit(False).alias("described"), (text != "").alias("contract"), text.rlike(SWAGGER).alias("swagger"), text.rlike(GENERATED).alias("generated"), text.rlike(VALIDATED).alias("validated"))
    no = F.lit(False)
    seen = files.select("project", F.col("file").rlike("(?i)OpenApiConfig").alias("config"), F.col("file").rlike(CONTRACT_FILE).alias("described"), no.alias("contract"), no.alias("swagger"), no.alias("generated"), no.alias("validated"))
    flags = said.unionByName(seen).groupBy("project").agg(*(F.coalesce(F.bool_or(c), no).alias(c) for c in ("config", "described", "contract", "swagger", "generated", "validated")))
    source = F.when(F.col("described") | F.col("generated"), "openapi-generated").when(F.col("contract"), "java-contracts").otherwise("unknown")
    return flags.select("project", source.alias("contract_source"), (F.col("swagger") | F.col("config")).alias("swagger"), "generated", "validated")


#: What each layer of an application gathers, and the type kinds that belong to it.
LAYER_SOURCES = {
    "api": ["family", "controller type"],
    "app": ["entry point", "runtime feature", "configuration type"],
    "common": ["cross-cutting", "event", "component type"],
    "persistence": ["repository", "entity", "repository type", "domain type"],
    "service": ["service", "client", "job", "listener", "service type", "listener type", "job type"],
    "web": ["validation boundary", "exception handler", "web configuration"],
    "security": ["security component", "security detail", "security configuration"],
    "notification": ["listener", "external system", "listener type"],
}
#: Words of items that a notification application keeps.
NOTIFIED = ["notification", "redis", "ws", "websocket"]


def application_layers(items: DataFrame, types: DataFrame, applications: DataFrame) -> DataFrame:
    """(project, app, layer, item), each once. items(project, source, item) by the sources of LAYER_SOURCES; types(project,
    kind, name) by annotation; applications(project, app).

    A notification application keeps items that speak of it, a backend those that do not speak of notification. The
    common layer is that of backends, whole; the notification layer that of notification applications. Items are made
    distinct before they meet the applications of their project."""
    of = {}
    for layer, sources in LAYER_SOURCES.items():
        for s in sources:
            of.setdefault(s, []).append(layer)
    layers = F.create_map(*(x for s, ls in of.items() for x in (F.lit(s), F.array(*map(F.lit, ls)))))
    rows = items.select("project", "source", "item").union(types.select("project", F.concat_ws(" ", "kind", F.lit("type")), "name"))
    each = rows.where("item IS NOT NULL").select("project", F.explode(F.try_element_at(layers, F.col("source"))).alias("layer"), "item").distinct()
    low, app = F.lower("item"), F.lower("app")
    notified, backend = F.contains(app, F.lit("notification")), F.contains(app, F.lit("backend"))
    speaks = reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in NOTIFIED))
    scoped = F.when(notified, speaks).when(backend, ~F.contains(low, F.lit("notification"))).otherwise(F.lit(True))
    keep = F.when(F.col("layer") == "common", backend).when(F.col("layer") == "notification", notified & scoped).otherwise(scoped)
    return each.join(applications.select("project", "app").distinct(), "project").where(keep).select("project", "app", "layer", "item")


def flows_by_app(flows: DataFrame, applications: DataFrame, keywords: list[tuple[str, str]] | None = None, fallback: str = "application") -> DataFrame:
    """(project, app, flow_id, label) of each flow, label `trigger -> name`. flows(project, flow_id, summary, name, trigger),
    applications(project, app, ord).

    The application is the first of the project that the summary names, else that of the first keyword in it; else the
    same for the name; else the fallback. Lists per application are left to the reader: a list may hold most flows."""
    texts = flows.select("project", "flow_id", F.posexplode(F.array("summary", "name")).alias("at", "text"))
    first = applications.groupBy("project", "app").agg(F.min("ord").alias("ord"))
    met = contains_pairs(texts.where("text <> ''").select("project", "text").distinct(), first, "text", "app", within=("project",))
    named = met.groupBy("project", "text").agg(F.min_by("app", F.struct("ord", "app")).alias("app"))
    word = F.coalesce(*(F.when(F.contains(F.lower("text"), F.lit(w)), a) for w, a in keywords or []), F.lit(None).cast("string"))
    told = texts.join(named, ["project", "text"], "left").select("project", "flow_id", "at", F.coalesce("app", word).alias("app"))
    chosen = told.groupBy("project", "flow_id").agg(F.min_by("app", F.when(F.col("app").isNotNull(), F.col("at"))).alias("app"))
    label = F.concat(F.coalesce("trigger", F.lit("")), F.lit(" -> "), F.coalesce("name", F.lit("")))
    return flows.select("project", "flow_id", label.alias("label")).join(chosen, ["project", "flow_id"]).select("project", F.coalesce("app", F.lit(fallback)).alias("app"), "flow_id", "label")


COUNTERS = ["nodes", "named_nodes", "types", "fields", "methods"]


def parse_totals(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files and the sums of the five counters of each key; missing counters are zero."""
    return files.groupBy(*keys).agg(F.count("*").alias("files"), *(F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c) for c in COUNTERS))


def parse_names(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, name), each once, of packages, imports and types. files(keys, package, imports, type_names)."""
    rows = lambda part, values: files.select(*keys, F.lit(part).alias("part"), F.explode(values).alias("name"))
    return rows("package", F.array("package")).union(rows("import", "imports")).union(rows("type", "type_names")).where("name <> ''").distinct()


def class_members(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member), each once: the members of classes of any size."""
    return df.select(key, member).where(F.col(key).isNotNull() & F.col(member).isNotNull()).distinct()


def class_cards(members: DataFrame, key: str, member: str, most: int = 16) -> DataFrame:
    """(key, n, first) of classes: their size and their `most` first members; no longer list is built."""
    counts = members.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(top_k(members, [key], [member], most).groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("first")), key)


#: Sources of the lines of a section, the first of equal lines wins.
LINE_SOURCES = ["document", "graph", "section"]


def flow_lines(found: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, line, source, rank, ord) of what a section holds, each line once, from its first source.

    found(key, section, source, line, ord) are flows and processes of the document and its graph; existing(key, section,
    text) are the sections as they stand, whose bullets are taken off."""
    bare = F.trim(F.regexp_replace("line", r"^[-*]\s*", ""))
    kept = existing.select(key, "section", F.posexplode(F.split("text", "\n")).alias("ord", "line")).select(key, "section", F.lit("section").alias("source"), bare.alias("line"), F.col("ord").cast("long"))
    rank = F.array_position(F.array(*map(F.lit, LINE_SOURCES)), F.col("source")).cast("int")
    rows = found.select(key, "section", "source", "line", F.col("ord").cast("long")).union(kept).where("line <> ''").withColumn("rank", rank)
    first = rows.groupBy(key, "section", "line").agg(F.min(F.struct("rank", "ord", "source")).alias("f"))
    return first.select(key, "section", "line", "f.source", "f.rank", "f.ord")


def section_parts(lines: DataFrame, key: str = "doc_id", most: int = 1000) -> DataFrame:
    """(key, section, part, text): sections rebuilt from their lines, in parts of at most `most`; joined by a line break in
    order of part they are the whole section. Ranks place the lines, so a section of any size lies in several tasks."""
    placed = ranks(lines, [key, "section"], ["rank", "ord", "line"], "n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    return placed.groupBy(key, "section", F.floor((F.col("n") - 1) / most).cast("int").alias("part")).agg(text.alias("text"))
