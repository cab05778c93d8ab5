"""Typed records from free JSON: reviews, issues, schemas, candidates, agent records, event lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "array<struct<kind:string,ref:string,detail:string>>"
CANDIDATE = f"struct<targetId:string,kind:string,title:string,summary:string,model:string,confidence:double,evidence:{EVIDENCE}>"
ISSUE = "array<struct<severity:string,code:string,message:string,sourceRef:string>>"
TABLE = "struct<name:string,description:string,primaryKey:array<string>,columns:array<struct<name:string,type:string,nullable:boolean>>>"
RELATIONSHIP = "struct<fromTable:string,fromColumn:string,toTable:string,toColumn:string,cardinality:string,description:string>"
#: What stands for a missing part of a relationship.
RELATIONSHIP_DEFAULTS = {"fromTable": "source_table", "fromColumn": "source_column", "toTable": "target_table", "toColumn": "target_column", "cardinality": "N:1", "description": None}
SEVERITIES = ["gap", "conflict", "warning", "violation", "info"]


def json_candidates(text: Column) -> list[Column]:
    """Places where a JSON object may stand: the whole text, a fenced block, the outermost braces."""
    return [F.trim(text), F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]


def parse_first(text: Column, schema: str) -> Column:
    """The first place that parses to an object with some value."""
    out = F.lit(None).cast(schema)
    for place in reversed(json_candidates(text)):
        looks = place.rlike(r"(?s)^\{.*\}$")
        out = F.coalesce(F.when(looks & F.json_object_keys(place).isNotNull(), F.from_json(place, schema)), out)
    return out


def parse_review(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Summary and notes of a review; without JSON the first line is the summary, the rest the notes."""
    parsed = parse_first(F.col(text), "struct<summary:string,notes:string>")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.array_join(F.slice(lines, 2, 1 << 30), "\n")
    return df.withColumn("__p", parsed).select(
        *keys, F.col("__p").isNotNull().alias("parsed"),
        F.when(F.col("__p").isNotNull(), F.coalesce("__p.summary", F.lit(""))).otherwise(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))).alias("summary"),
        F.when(F.col("__p").isNotNull(), F.coalesce("__p.notes", F.lit(""))).otherwise(rest).alias("notes"),
    )


def normalize_issues(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Issues of a JSON array with defaults; an unknown severity is info."""
    rows = df.select(*keys, F.posexplode(F.from_json(column, ISSUE)).alias("ord", "i"))
    severity = F.lower(F.col("i.severity"))
    return rows.select(*keys, "ord", F.when(severity.isin(SEVERITIES), severity).otherwise("info").alias("severity"), F.coalesce("i.code", F.lit("issue")).alias("code"), F.coalesce("i.message", F.lit("")).alias("message"), F.col("i.sourceRef").alias("source_ref"))


def normalize_schema_json(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Columns of the tables of a schema document, with defaults; rows without tables give none."""
    parsed = df.select(*keys, F.from_json(column, f"tables array<{TABLE}>").alias("s"))
    tables = parsed.select(*keys, F.posexplode("s.tables").alias("table_ord", "t")).where("t.name IS NOT NULL")
    rows = tables.select(*keys, "table_ord", F.col("t.name").alias("table_name"), F.coalesce("t.primaryKey", F.array(F.lit("id"))).alias("primary_key"), F.posexplode_outer("t.columns").alias("column_ord", "c"))
    return rows.select(*keys, "table_ord", "table_name", "primary_key", "column_ord", F.col("c.name").alias("column_name"), F.coalesce("c.type", F.lit("string")).alias("type"), F.coalesce("c.nullable", F.lit(True)).alias("nullable"))


def normalize_relationships(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Relationships of a schema document, in order; missing and blank parts take their defaults. Rows without any give none."""
    rows = df.select(*keys, F.posexplode(F.from_json(column, f"relationships array<{RELATIONSHIP}>")["relationships"]).alias("ord", "r")).where("r IS NOT NULL")
    part = lambda f, default: F.coalesce(F.nullif(F.trim(f"r.{f}"), F.lit("")), F.lit(default).cast("string")).alias(re.sub("[A-Z]", lambda m: "_" + m[0].lower(), f))
    return rows.select(*keys, "ord", *(part(f, d) for f, d in RELATIONSHIP_DEFAULTS.items()))


def parse_candidates(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Candidates of an array or of {candidates: [...]}: trimmed, confidence 0.5 if missing, evidence with ref and
    detail, none without target or summary."""
    as_list = F.from_json(column, f"array<{CANDIDATE}>")
    in_object = F.from_json(column, f"candidates array<{CANDIDATE}>")["candidates"]
    both = F.when(F.trim(column).startswith("["), as_list).otherwise(in_object)
    rows = df.select(*keys, F.posexplode(both).alias("ord", "c"))
    trimmed = lambda f: F.trim(F.col(f"c.{f}"))
    evidence = F.filter(F.coalesce("c.evidence", F.array().cast(EVIDENCE)), lambda e: (F.length(F.trim(e["ref"])) > 0) & (F.length(F.trim(e["detail"])) > 0))
    out = rows.select(*keys, "ord", trimmed("targetId").alias("target_id"), trimmed("kind").alias("kind"), trimmed("title").alias("title"), trimmed("summary").alias("summary"), F.col("c.model").alias("model"), F.coalesce("c.confidence", F.lit(0.5)).alias("confidence"), evidence.alias("evidence"))
    return out.where("length(target_id) > 0 AND length(summary) > 0")


def candidate_issues(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """What a candidate lacks."""
    missing = F.filter(F.array(
        F.when(F.coalesce(F.length("model"), F.lit(0)) == 0, F.lit("missing model")), F.when(F.col("confidence").isNull(), F.lit("missing confidence")),
        F.when(F.size("evidence") < 1, F.lit("missing evidence")), F.when(F.coalesce(F.length("target_id"), F.lit(0)) == 0, F.lit("missing target")),
    ), lambda x: x.isNotNull())
    return candidates.select(*keys, F.explode(missing).alias("issue"))


#: Keys under which agent answers hold their rows, in order.
RECORD_KEYS = ["records", "items", "results", "findings", "tasks"]


def parse_agent_records(df: DataFrame, column: str, keys: list[str], fallback: str = "unparsed answer") -> DataFrame:
    """Rows under the first key that holds any; an answer without them gives one fallback row."""
    rows = "array<struct<id:string,summary:string,confidence:double>>"
    arrays = [F.from_json(F.get_json_object(column, f"$.{k}"), rows) for k in RECORD_KEYS]
    found = F.coalesce(*(F.when(F.size(a) > 0, a) for a in arrays))
    out = df.select(*keys, F.posexplode_outer(found).alias("ord", "r"))
    return out.select(*keys, F.coalesce("ord", F.lit(0)).alias("ord"), F.coalesce("r.id", F.lit("unknown")).alias("record_id"), F.coalesce("r.summary", F.lit(fallback)).alias("summary"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"))


def stream_text(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Text of assistant event lines of two provider formats; tool calls as notes."""
    block = "array<struct<type:string,text:string,name:string>>"
    line = F.from_json(column, f"type string, message struct<content:{block}>, item struct<type:string,text:string>")
    text = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[tool] "), b["name"]))
    first = F.array_join(F.filter(F.transform("__l.message.content", text), lambda x: x.isNotNull()), "\n")
    out = F.when(F.col("__l.type") == "assistant", first).when(F.col("__l.item.type") == "agent_message", F.col("__l.item.text"))
    return df.withColumn("__l", line).select(*keys, out.alias("text")).where("text IS NOT NULL AND text <> ''")


#: Wordings of quota and rate limits.
QUOTA_PATTERNS = ["rate limit", "quota", "usage limit", "too many requests", "insufficient credit", "billing", "429"]


def quota_errors(lines: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """First quota message of each run."""
    hit = F.lower(column).rlike("|".join(QUOTA_PATTERNS)) | F.coalesce(F.get_json_object(column, "$.type") == "error", F.lit(False))
    return lines.where(hit).groupBy(key).agg(F.min_by(column, order).alias("message"))
