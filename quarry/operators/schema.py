"""Schema inference: DDL and declared tables, seed columns, foreign keys."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.functions.names import column_type, normalize_hint, sql_identifier, sql_type
from quarry.operators.durable import saved
from quarry.operators.linking import contains_pairs
from quarry.operators.relational import unique_by


@F.pandas_udf(ArrayType(StringType()))
def split_top_level(bodies: pd.Series) -> pd.Series:
    """Cuts at commas outside parentheses; depth needs a counter, which built-in functions lack."""

    def cut(body: str | None) -> list[str] | None:
        if body is None:
            return None
        parts, depth, at = [], 0, 0
        for i, c in enumerate(body):
            depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
            if c == "," and not depth:
                parts.append(body[at:i])
                at = i + 1
        return parts + [body[at:]] if body[at:].strip() else parts

    return bodies.map(cut)


_ID = r'[a-zA-Z0-9_."`]+'


def ddl_definitions(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, table_name, ord, definition) of the CREATE TABLE statements."""
    statement = files.select(key, F.posexplode(F.split(text, r";\s*(\n|$)")).alias("stmt", "sql"))
    head = rf"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?({_ID})\s*\((.+)\)\s*$"
    found = statement.where(F.trim("sql").rlike(head)).select(key, sql_identifier(F.regexp_extract("sql", head, 1)).alias("table_name"), F.regexp_extract("sql", head, 2).alias("body"))
    return found.select(key, "table_name", F.posexplode(split_top_level("body")).alias("ord", "definition")).withColumn("definition", F.regexp_replace("definition", r"^\s+|\s+$", "")).where("definition <> ''")


_TABLE_FK = rf"(?i)foreign\s+key\s*\(([^)]+)\)\s*references\s+({_ID})\s*\(([^)]+)\)"
_TABLE_PK = r"(?i)^(?:constraint\s+\S+\s+)?primary\s+key\s*\(([^)]+)\)"
_COLUMN = rf"""(?i)^({_ID})\s+([a-zA-Z0-9_()'"\[\]\-+/.<>,\s]+?)(?:\s+constraint\b|\s+primary\s+key\b|\s+references\b|\s+not\s+null\b|$)"""
_INLINE_FK = rf"(?i)references\s+({_ID})\s*\(([^)]+)\)"


def ddl_columns(definitions: DataFrame, key: str = "file") -> DataFrame:
    rows = definitions.where(~F.col("definition").rlike(_TABLE_FK) & ~F.col("definition").rlike(_TABLE_PK) & F.col("definition").rlike(_COLUMN))
    raw = F.trim(F.regexp_extract("definition", _COLUMN, 2))
    out = rows.select(key, "table_name", "ord", sql_identifier(F.regexp_extract("definition", _COLUMN, 1)).alias("column_name"), raw.alias("detail"), sql_type(raw).alias("type"), (~F.col("definition").rlike(r"(?i)not\s+null")).alias("nullable"))
    return unique_by(out, [key, "table_name", "column_name"], ["ord"])


def ddl_keys(definitions: DataFrame, key: str = "file") -> DataFrame:
    """Primary key columns, of the table or inline."""
    d = F.col("definition")
    table = definitions.where(d.rlike(_TABLE_PK) & ~d.rlike(_TABLE_FK)).select(key, "table_name", F.explode(F.split(F.regexp_extract(d, _TABLE_PK, 1), ",")).alias("c"))
    inline = definitions.where(~d.rlike(_TABLE_PK) & ~d.rlike(_TABLE_FK) & d.rlike(r"(?i)primary\s+key")).select(key, "table_name", F.regexp_extract(d, _COLUMN, 1).alias("c"))
    return table.union(inline).select(key, "table_name", sql_identifier("c").alias("column_name")).distinct()


def ddl_references(definitions: DataFrame, key: str = "file") -> DataFrame:
    """(key, table_name, column_name, target_table, target_column) of foreign keys."""
    d = F.col("definition")
    first = lambda x: F.element_at(F.split(x, ","), 1)
    table = definitions.where(d.rlike(_TABLE_FK)).select(key, "table_name", first(F.regexp_extract(d, _TABLE_FK, 1)).alias("c"), F.regexp_extract(d, _TABLE_FK, 2).alias("t"), first(F.regexp_extract(d, _TABLE_FK, 3)).alias("tc"))
    inline = definitions.where(~d.rlike(_TABLE_FK) & d.rlike(_INLINE_FK)).select(key, "table_name", F.regexp_extract(d, _COLUMN, 1).alias("c"), F.regexp_extract(d, _INLINE_FK, 1).alias("t"), first(F.regexp_extract(d, _INLINE_FK, 2)).alias("tc"))
    return table.union(inline).select(key, "table_name", sql_identifier("c").alias("column_name"), sql_identifier("t").alias("target_table"), sql_identifier("tc").alias("target_column"))


#: Words that name a table in a text, in order.
TABLE_WORDS = [
    "notes", "note", "users", "user", "accounts", "account", "tasks", "task", "events", "event", "messages", "message", "notifications", "notification",
    "audit_log", "audit", "attachments", "attachment", "files", "file", "orders", "order", "payments", "payment", "projects", "project", "comments", "comment",
    "sessions", "session", "roles", "role", "permissions", "permission", "invoices", "invoice",
]


def table_from_text(text: Column) -> Column:
    """Plural of the first table word that the text contains."""
    word = F.try_element_at(F.filter(F.array(*map(F.lit, TABLE_WORDS)), lambda w: F.contains(F.lower(text), w)), F.lit(1))
    return F.when(F.endswith(word, F.lit("s")), word).otherwise(F.concat(word, F.lit("s")))


def parse_schema_items(items: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """table t | pk: .. | columns: a:int,b | relationships: a.x -> b.y (N:1) | source: .. as one row per item."""
    stop = r"(?:\s*\|\s*(?:columns?|relationships?|source)\b|$)"
    name = F.coalesce(normalize_hint(F.nullif(F.regexp_extract(item, r'(?i)\btable\s+([a-zA-Z0-9_."`-]+)', 1), F.lit(""))), table_from_text(F.col(item)))
    pick = lambda p: F.nullif(F.regexp_extract(item, p, 1), F.lit(""))
    names = lambda x: F.filter(F.transform(F.split(x, ","), lambda v: F.lower(F.trim(v))), lambda v: v != "")
    columns = F.transform(F.split(pick(rf"(?i)\bcolumns?\s*:\s*([^|]+?){stop}"), ","), lambda v: F.struct(
        F.lower(F.trim(F.substring_index(v, ":", 1))).alias("name"), column_type(F.when(F.contains(v, F.lit(":")), F.substring_index(v, ":", -1)).otherwise(F.lit(""))).alias("type")))
    links = F.regexp_extract_all(F.coalesce(pick(r"(?i)\brelationships?\s*:\s*(.+)$"), F.lit("")), F.lit(r"([a-zA-Z0-9_.]+\s*->\s*[a-zA-Z0-9_.]+(?:\s*\((?:1:1|1:N|N:1|N:M)\))?)"), F.lit(1))
    return items.select(*keys, name.alias("table_name"), F.coalesce(names(F.coalesce(pick(rf"(?i)\bpk\s*:\s*([^|]+?){stop}"), pick(rf"(?i)\bprimary\s*key\s*:\s*([^|]+?){stop}"))), F.array(F.lit("id"))).alias("primary_key"), columns.alias("columns"), links.alias("relationships"))


def schema_links(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Declared relationships of parse_schema_items as rows."""
    p = r"([a-zA-Z0-9_]+)\.([a-zA-Z0-9_]+)\s*->\s*([a-zA-Z0-9_]+)\.([a-zA-Z0-9_]+)(?:\s*\((1:1|1:N|N:1|N:M)\))?"
    rows = parsed.select(*keys, F.explode("relationships").alias("link"))
    parts = [F.lower(F.regexp_extract("link", p, i)).alias(n) for i, n in enumerate(("from_table", "from_column", "to_table", "to_column"), 1)]
    return rows.select(*keys, *parts, F.coalesce(F.nullif(F.regexp_extract("link", p, 5), F.lit("")), F.lit("N:1")).alias("cardinality"))


#: Meaning of a reference's base name.
SYNONYMS = {"owner": ["users"], "user": ["users"], "actor": ["users"], "author": ["users"], "creator": ["users"], "note": ["notes"], "subject": ["notes", "users"], "audit": ["audit_log"]}
#: Fixed value: words of references to the own table.
HIERARCHY = "parent|child|prev|next|manager|mentor|supervisor"


def infer_fks(columns: DataFrame, tables: DataFrame, synonyms: dict[str, list[str]] | None = None, suffix: str = "_id") -> DataFrame:
    """x_id columns with the table they mean: by synonym, then x, xs, xes, and x without its s; a table meets itself
    only for words of hierarchy. columns(table_name, column_name), tables(table_name)."""
    synonyms = SYNONYMS if synonyms is None else synonyms
    refs = columns.where(F.lower("column_name").rlike(f"{suffix}$") & (F.lower("column_name") != suffix.strip("_"))).withColumn("base", F.regexp_replace(F.lower("column_name"), f"{suffix}$", ""))
    known = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if synonyms else None
    meant = F.coalesce(F.try_element_at(known, F.col("base")), F.array().cast("array<string>")) if synonyms else F.array().cast("array<string>")
    own = F.when(F.col("base") == "parent", F.array(F.lower("table_name"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(meant, own, F.array("base", F.concat("base", F.lit("s")), F.concat("base", F.lit("es")), F.regexp_replace("base", "s$", "")))
    asked = refs.select("table_name", "column_name", "base", F.posexplode(names).alias("rank", "target"))
    targets = tables.select(F.lower("table_name").alias("target"), F.col("table_name").alias("to_table")).distinct()
    best = unique_by(asked.join(targets, "target"), ["table_name", "column_name"], ["rank"])
    return best.where((F.col("table_name") != F.col("to_table")) | F.col("base").rlike(HIERARCHY)).select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), "to_table")


#: Columns of a table by its name, as (name, type).
SEED_COLUMNS = [
    ("note", [("title", "string"), ("content", "text"), ("status", "string"), ("owner_id", "uuid")]),
    ("user|account", [("email", "string"), ("display_name", "string"), ("role", "string"), ("status", "string")]),
    ("task|job", [("name", "string"), ("description", "text"), ("status", "string"), ("due_at", "timestamp")]),
    ("event|message|notification", [("event_type", "string"), ("aggregate_id", "uuid"), ("payload", "json"), ("created_at", "timestamp")]),
    ("audit", [("action", "string"), ("actor_id", "uuid"), ("subject_type", "string"), ("subject_id", "uuid"), ("payload", "json")]),
    ("", [("name", "string"), ("status", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp")]),
]


def seed_columns(tables: DataFrame, name: str = "table_name") -> DataFrame:
    """Columns of a template chosen by the table's name, between an id and time stamps; of equal names the first stays."""

    def template(columns: list[tuple[str, str]]) -> Column:
        rows = [("id", "uuid"), *columns, ("created_at", "timestamp"), ("updated_at", "timestamp")]
        return F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type")) for c, t in rows))

    chosen = template(SEED_COLUMNS[-1][1])
    for pattern, columns in reversed(SEED_COLUMNS[:-1]):
        chosen = F.when(F.lower(name).rlike(pattern), template(columns)).otherwise(chosen)
    rows = tables.select(name, F.posexplode(chosen).alias("ord", "c")).select(name, "ord", "c.*")
    return unique_by(rows, [name, "column_name"], ["ord"])


def infer_tables(explicit: DataFrame, hinted: DataFrame, texts: DataFrame, key: str = "doc_id", fallback: str = "records") -> DataFrame:
    """Declared tables win; else hinted tables and those named in the text; else a fallback."""
    declared = explicit.select(key, "table_name").where("table_name IS NOT NULL").distinct()
    named = hinted.select(key, "table_name", F.lit(1).alias("rank")).union(texts.select(key, table_from_text(F.col("text")).alias("table_name"), F.lit(2).alias("rank"))).where("table_name IS NOT NULL")
    rest = unique_by(named.join(declared.select(key).distinct(), key, "left_anti"), [key, "table_name"], ["rank"]).select(key, "table_name")
    some = declared.union(rest)
    bare = texts.select(key).distinct().join(some.select(key).distinct(), key, "left_anti").select(key, F.lit(fallback).alias("table_name"))
    return some.union(bare)


#: Words of a document that name a table of its domain.
DOMAIN_TABLES = [
    ("notes", r"\bnotes?\b"), ("users", r"\busers?\b|\baccounts?\b"), ("tasks", r"\btasks?\b|\bwork items?\b|\bjobs?\b"),
    ("events", r"\bevents?\b|\bmessages?\b|\bnotifications?\b"), ("audit_log", r"\baudit\b"), ("attachments", r"\battachments?\b|\bfiles?\b|\bassets?\b|\bblobs?\b"),
]
#: Sections whose items may name the main table, in order; words of entity-like nodes; the last resort.
MAIN_SECTIONS, ENTITY_WORDS, FALLBACK_TABLE = ("examples", "processes", "dependencies"), "(?i)persistence|repository|entity|table|database|store", "domain_record"


#: Evidence of a table, the strongest first.
RUNGS = ("explicit", "keyword", "hint", "dependency", "graph", "main")


def table_ladder(docs: DataFrame, explicit: DataFrame, hints: DataFrame, items: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table_name, evidence): tables of each document, each once, with the evidence that stands first.

    Documents with declared tables have no others. The rest have those of keywords, of hints that their text holds, of
    dependencies, of entity-like graph nodes, and a main table, the first that examples, processes, dependencies, nodes,
    the title or the text name; documents that no rung gave a table have the fallback. docs(key, title, text),
    explicit(key, table_name), hints(hint), items(key, section, item_ord, item), nodes(key, type, name, ord).

    Evidence of one table is put together first; what is left meets by key, with a given number of parts. Inputs that are
    dealt out by key already need no other exchange."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(key, F.lower("title").alias("title"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    long, none = (lambda x: F.lit(x).cast("long")), F.lit(None).cast("string")
    # Rungs by their place in RUNGS, -1 marks a document; rows of the main rung are its candidates, by source and place there.
    row = lambda rung, table, source=F.lit(None), at=F.lit(None): F.struct(F.lit(RUNGS.index(rung) if rung else -1).alias("rung"), table.alias("table_name"), source.cast("int").alias("source"), at.cast("long").alias("at"))
    told = lambda df, *rows: df.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")
    words = [row("keyword", F.when(F.col("text").rlike(p), F.lit(t))) for t, p in DOMAIN_TABLES]
    by_docs = told(texts, row(None, none), *words, row("main", table_from_text(F.col("title")), F.lit(4), long(0)), row("main", table_from_text(F.col("text")), F.lit(5), long(0)))
    names = hints.select(normalize_hint("hint").alias("table_name")).where("table_name IS NOT NULL").distinct().withColumn("said", F.replace("table_name", F.lit("_"), F.lit(" ")))
    hinted = told(contains_pairs(texts.select(key, "text"), names, "text", "said"), row("hint", F.col("table_name")))
    sections = F.create_map(*(F.lit(x) for k, s in enumerate(MAIN_SECTIONS) for x in (s, k)))
    item, source = table_from_text(F.col("item")), F.try_element_at(sections, F.col("section"))
    by_items = told(items.where(F.col(key).isNotNull()), row("dependency", F.when(F.col("section") == "dependencies", item)), row("main", F.when(source.isNotNull(), item), source, F.col("item_ord")))
    entity = F.coalesce(F.col("type").rlike(ENTITY_WORDS), F.lit(False)) | F.coalesce(F.col("name").rlike(ENTITY_WORDS), F.lit(False))
    by_name = table_from_text(F.col("name"))
    by_nodes = told(nodes.where(F.col(key).isNotNull()), row("graph", F.when(entity, F.coalesce(by_name, normalize_hint("name")))), row("main", by_name, F.lit(3), F.col("ord")))
    rows = reduce(DataFrame.union, [told(explicit, row("explicit", F.col("table_name"))), by_docs, hinted, by_items, by_nodes])
    rows = rows.where("rung = -1 OR table_name IS NOT NULL AND (rung = 0 OR table_name <> '')")
    main = F.min(F.when(F.col("rung") == RUNGS.index("main"), F.struct("source", "at", "table_name")))
    once = rows.groupBy(key, "table_name").agg(F.min(F.when(F.col("rung") != RUNGS.index("main"), F.col("rung"))).alias("rung"), main.alias("main")).repartition(n, key)
    whole, known = Window.partitionBy(key), F.col(key).isNotNull()
    once = once.withColumns({"gated": known & F.max(F.coalesce(F.col("rung") == 0, F.lit(False))).over(whole), "document": F.max(F.coalesce(F.col("rung") == -1, F.lit(False))).over(whole), "first": F.min("main").over(whole)})
    chosen = F.least("rung", F.when(F.col("main") == F.col("first"), F.lit(RUNGS.index("main"))))
    stays = F.when(F.col("rung") == 0, F.col("table_name") != "").when(F.col("rung") == -1, False).otherwise(chosen.isNotNull() & F.col("document") & ~F.col("gated"))
    once = once.withColumn("stays", stays).withColumn("some", known & F.max("stays").over(whole))
    evidence = F.element_at(F.array(*map(F.lit, RUNGS)), chosen + 1)
    last = F.col("rung") == -1
    return once.where(F.col("stays") | (last & ~F.col("some"))).select(key, F.when(last, F.lit(FALLBACK_TABLE)).otherwise(F.col("table_name")).alias("table_name"), F.when(last, F.lit("fallback")).otherwise(evidence).alias("evidence"))


def relationships(columns: DataFrame, tables: DataFrame, explicit: DataFrame) -> DataFrame:
    """Inferred foreign keys, and declared ones that are not among them."""
    inferred = infer_fks(columns, tables).select("from_table", "from_column", "to_table", F.lit("id").alias("to_column"))
    four = ["from_table", "from_column", "to_table", "to_column"]
    return inferred.withColumn("origin", F.lit("inferred")).union(explicit.select(*four).distinct().join(inferred, four, "left_anti").select(*four, F.lit("declared").alias("origin")))


def schema_confidence(n_tables: Column, declared: Column, drawn: Column) -> Column:
    return F.when((n_tables >= 3) & declared & drawn, "high").when((n_tables >= 2) | declared | drawn, "medium").otherwise("low")


def schema_summary(columns: DataFrame, keys: list[str]) -> DataFrame:
    n = columns.groupBy(*keys).agg(F.countDistinct("table_name").alias("n_tables"), F.count("*").alias("n_columns"))
    return n.withColumn("summary", F.format_string("%d tables, %d columns", "n_tables", "n_columns"))


def fallback_tables(names: DataFrame, name: str = "name") -> DataFrame:
    # The columns of a table that nothing describes.
    stock = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type")) for c, t in (("id", "uuid"), ("name", "string"), ("created_at", "timestamp"))))
    return names.select(normalize_hint(name).alias("table_name")).distinct().select("table_name", F.posexplode(stock).alias("ord", "c")).select("table_name", "ord", "c.*")
