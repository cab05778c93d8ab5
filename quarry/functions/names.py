"""Scalar functions as Column expressions: names, slugs, types, kinds and token sets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _chain(x: Column, *rules: tuple[str, str]) -> Column:
    for pattern, new in rules:
        x = F.regexp_replace(x, pattern, new)
    return x


def _first_of(rules: list[tuple[Column, str]], default: Column | None = None) -> Column:
    """Value of the first rule that holds."""
    out = default if default is not None else F.lit(None).cast("string")
    for test, value in reversed(rules):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def _blank_to(x: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), default)


def slugify(x: ColumnOrName, n: int = 64, default: str | None = "item") -> Column:
    """Lower case, runs of other characters to a dash, no dash at the ends, cut to n."""
    s = F.substring(_chain(F.lower(_c(x)), (r"[^a-z0-9]+", "-"), (r"^-+|-+$", "")), 1, n)
    return s if default is None else _blank_to(s, F.lit(default))


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKD", v) if v is not None else None)


def artifact_name(x: ColumnOrName, n: int = 80) -> Column:
    """Safe file name; a name that is too long keeps its head and eight digits of its digest."""
    safe = _chain(_compatible(_c(x)), (r"[^A-Za-z0-9._-]+", "-"), (r"-+", "-"), (r"^[._-]+|[._-]+$", ""))
    safe = _blank_to(safe, F.lit("artifact"))
    head = _chain(F.substring(safe, 1, n - 9), (r"[._-]+$", ""))
    return F.when(F.length(safe) <= n, safe).otherwise(F.concat(head, F.lit("-"), F.substring(F.sha1(_c(x)), 1, 8)))


def snake_case(x: ColumnOrName) -> Column:
    return F.lower(_chain(_c(x), (r"([a-z0-9])([A-Z])", "$1_$2"), (r"[^a-zA-Z0-9]+", "_"), (r"^_+|_+$", "")))


def normalize_hint(x: ColumnOrName) -> Column:
    """Table hint of a file or type name: base name, no extension, no role suffix, snake case."""
    base = F.element_at(F.split(_c(x), r"[\\/]"), -1)
    s = _chain(
        base, (r"\.(java|kt|groovy|ts|tsx|js|jsx)$", ""), (r"(?i)(entity|record|model|repository|repo|table|dto)$", ""),
        (r"([a-z])([A-Z])", "$1_$2"), (r"[^a-zA-Z0-9_]+", "_"),
    )
    return _blank_to(_chain(F.lower(s), (r"^_+|_+$", "")), F.lower(_c(x)))


def humanize(x: ColumnOrName) -> Column:
    """Words of a name, their first letters capital, the rest as they are."""
    words = F.split(F.trim(_chain(_c(x), (r"([a-z0-9])([A-Z])", "$1 $2"), (r"[._/-]+", " "))), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def normalize_text(x: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"\s+", " "))


def trim_text(x: ColumnOrName, n: int) -> Column:
    """Cut to n and without punctuation at the cut; short values stay."""
    cut = F.substring(_c(x), 1, n)
    return F.when(F.length(_c(x)) <= n, _c(x)).otherwise(_blank_to(F.trim(F.regexp_replace(cut, r"[\s,;:-]+$", "")), cut))


def keep_head(x: ColumnOrName, n: int, mark: str = "...") -> Column:
    return F.when(F.length(_c(x)) > n, F.concat(F.substring(_c(x), 1, n), F.lit(mark))).otherwise(_c(x))


def keep_tail(x: ColumnOrName, n: int, mark: str = "...") -> Column:
    return F.when(F.length(_c(x)) > n, F.concat(F.lit(mark), F.right(_c(x), F.lit(n)))).otherwise(_c(x))


def package_of(x: ColumnOrName) -> Column:
    """What stands before the last dot; null without one."""
    return F.nullif(F.regexp_extract(F.trim(_c(x)), r"^(.+)\.[^.]*$", 1), F.lit(""))


def simple_name(x: ColumnOrName) -> Column:
    return F.element_at(F.split(F.trim(_c(x)), r"\."), -1)


def relative_path(x: ColumnOrName, root: str) -> Column:
    path = F.replace(_c(x), F.lit("\\"), F.lit("/"))
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def base_name(x: ColumnOrName) -> Column:
    return F.element_at(F.split(_c(x), r"[\\/]"), -1)


def endpoint_family(x: ColumnOrName) -> Column:
    """First path part that is not a technical prefix."""
    parts = F.filter(F.split(F.substring_index(_c(x), "?", 1), "/+"), lambda p: p != "")
    named = F.filter(parts, lambda p: ~p.rlike(r"(?i)^(api|rest|web|public|internal|v\d+)$"))
    return F.concat(F.lit("/"), F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(parts, F.lit(1)), F.lit("")))


def section_name(x: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(x))), r"\s+", "_")


#: Patterns in their order and the logical type they give.
COLUMN_TYPES = [
    ("uuid|uniqueidentifier", "uuid"),
    ("bigint|int|smallint|tinyint|serial|numeric|decimal|double|float|real", "number"),
    ("timestamp|timestamptz|datetime|date|time", "timestamp"),
    ("bool", "boolean"),
    ("json", "json"),
    ("text|clob|blob", "text"),
    ("char|varchar|string|email|name|title|role|type|kind|action|status|slug|query|message|payload|description|body|token", "string"),
    ("_id$", "uuid"),
]
SQL_TYPES = [
    ("uuid", "uuid"),
    ("bigint|int|smallint|tinyint|serial|numeric|decimal|number|double|float|real", "number"),
    ("timestamp|datetime|date|time", "timestamp"),
    ("bool", "boolean"),
    ("json", "json"),
    ("text|clob|blob", "text"),
    ("char|varchar|string|uuid", "string"),
]
JAVA_TYPES = [
    (r"^(uuid)$", "uuid"),
    (r"^(int|integer|long|short|byte|double|float|bigdecimal|biginteger|number)$", "number"),
    (r"date|time|instant", "timestamp"),
    (r"^bool", "boolean"),
    (r"json", "json"),
    (r"^(list|set|collection)\b", "collection"),
    (r"^map\b", "map"),
    (r"^(string|char|character)$", "string"),
]


def logical_type(x: ColumnOrName, rules: list[tuple[str, str]], passes: bool) -> Column:
    """Type of the first pattern found in the lower-cased value; unknown values pass through or give null."""
    value = F.nullif(normalize_text(x), F.lit(""))
    return _first_of([(value.rlike(p), t) for p, t in rules], value if passes else None)


def column_type(x: ColumnOrName) -> Column:
    return logical_type(x, COLUMN_TYPES, passes=False)


def sql_type(x: ColumnOrName) -> Column:
    return logical_type(x, SQL_TYPES, passes=True)


def java_type(x: ColumnOrName) -> Column:
    return logical_type(x, JAVA_TYPES, passes=True)


def sql_identifier(x: ColumnOrName) -> Column:
    return F.lower(F.regexp_replace(F.trim(_c(x)), r'^[`"\[]+|[`"\]]+$', ""))


def pluralize_keyword(x: ColumnOrName) -> Column:
    return F.when(F.endswith(_c(x), F.lit("s")), _c(x)).otherwise(F.concat(_c(x), F.lit("s")))


def tokens(x: ColumnOrName, least: int = 3) -> Column:
    """Distinct lower-case words of at least `least` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(x)), r"[^a-z0-9]+"), lambda t: F.length(t) >= least))


def overlap(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.size(F.array_intersect(_c(a), _c(b)))


def content_hash(x: ColumnOrName) -> Column:
    return F.sha2(_c(x), 256)


def version_id(x: ColumnOrName) -> Column:
    return F.regexp_replace(F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "[:.]", "-")


#: Kinds of source artifacts, in the order in which they are asked.
ARTIFACT_KINDS = [
    ("controller", r"(?i)@restcontroller|@controller", r"(?i)controller\.java$"),
    ("service", r"(?i)@service", r"(?i)service\.java$"),
    ("repository", r"(?i)@repository", r"(?i)repository\.java$"),
    ("entity", r"(?i)@entity", r"(?i)entity\.java$"),
    ("configuration", r"(?i)@configuration|@config", r"(?:Config|Configuration)\.java$"),
    ("security", r"(?i)@securityfilterchain|@preauthorize|@secured|@rolesallowed", r"(?i)security/"),
    ("job", r"(?i)@scheduled", r"(?i)/jobs/"),
    ("listener", r"(?i)@eventlistener|@kafkalistener|@messagelistener", r"(?i)/listeners/"),
    ("websocket", r"(?i)websocket", r"(?i)websocket"),
]


def artifact_kind(text: ColumnOrName, path: ColumnOrName) -> Column:
    return _first_of([(_c(text).rlike(t) | _c(path).rlike(p), kind) for kind, t, p in ARTIFACT_KINDS], F.lit("component"))


#: Words in annotations, then in qualified names, that tell a type's kind.
ANNOTATION_KINDS = [
    ("controller", "restcontroller|controller|requestmapping"),
    ("service", "service|transactional"),
    ("repository", "repository|mapper"),
    ("domain", "entity|table|embeddable"),
    ("configuration", "configuration|enablewebmvc|enablejpa"),
    ("listener", "eventlistener|kafkalistener|rabbitmq"),
    ("job", "scheduled|enablescheduling"),
    ("component", "component"),
]
NAME_KINDS = [
    ("controller", r"\.controller\.|controller$"),
    ("service", r"\.service\.|service$"),
    ("repository", r"\.repository\.|repository$"),
    ("configuration", r"\.config\.|config$|configuration$"),
    ("domain", r"\.domain\.|entity$"),
    ("listener", r"\.listener\.|listener$"),
    ("job", r"\.job\.|job$"),
]


def type_kind(annotations: ColumnOrName, name: ColumnOrName) -> Column:
    """Kind by annotations first, then by qualified name."""
    by_name = _first_of([(F.lower(_c(name)).rlike(p), k) for k, p in NAME_KINDS])

    def noted(pattern: str) -> Column:
        return F.exists(_c(annotations), lambda a: F.lower(a).rlike(pattern))

    return _first_of([(noted(p), k) for k, p in ANNOTATION_KINDS], by_name)


def mapped(x: ColumnOrName, values: dict[str, str], default: str | None = None) -> Column:
    """Lookup in a small fixed map."""
    table = F.create_map(*(F.lit(v) for pair in values.items() for v in pair))
    found = F.try_element_at(table, _c(x))
    return found if default is None else F.coalesce(found, F.lit(default))


def first_word(x: ColumnOrName, words: list[str]) -> Column:
    """First of ordered words that the lower-cased value contains."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(_c(x)), w)), F.lit(1))


#: Entrypoint kinds by role, flow type and actor.
_LISTENER = r"listener|^event-handler$"
_SCHEDULED = r"^(scheduler|quartz-job|spring-scheduled)$"


def step_role(kind: ColumnOrName) -> Column:
    k = _c(kind)
    return _first_of([(k.rlike(_SCHEDULED) | (k == "batch-job"), "scheduler"), (k.rlike(_LISTENER), "listener")], F.lit("controller"))


def flow_type(kind: ColumnOrName) -> Column:
    k = _c(kind)
    return _first_of([
        (k.rlike(_SCHEDULED), "scheduled"), (k.isin("batch-job", "startup-runner", "cli-command"), "batch"),
        (k.rlike(_LISTENER), "event"), (k.isin("callback-endpoint", "webhook-endpoint"), "integration"),
    ], F.lit("api"))


def flow_actor(kind: ColumnOrName) -> Column:
    k = _c(kind)
    return _first_of([
        (k.isNull(), "system"), (k == "rest-endpoint", "API consumer"), (k.isin("callback-endpoint", "webhook-endpoint"), "external provider"),
        (k.isin("startup-runner", "cli-command"), "operator/runtime"), (k.rlike(_SCHEDULED) | (k == "batch-job"), "scheduler"),
        (k.rlike(_LISTENER), "event source"), (k == "soap-endpoint", "SOAP client"),
    ], F.lit("system"))


def listener_kind(text: ColumnOrName) -> Column:
    t = F.lower(_c(text))
    return _first_of([(F.contains(t, F.lit(w)), f"{w}-listener") for w in ("kafka", "rabbit", "jms")], F.lit("event-handler"))


def collaborator_role(name: ColumnOrName, kind: ColumnOrName, publishes: Column | None = None) -> Column:
    """Role by annotation kind, then by name, then by side effect."""
    n, event = _c(name), publishes if publishes is not None else F.lit(False)
    by_name = _first_of([
        (n.rlike(r"Repository$"), "repository"), (n.rlike(r"Mapper$"), "mapper"), (n.rlike(r"Validator|Resolver|Policy|Guard"), "validator"),
        (n.rlike(r"Publisher|Event") | event, "event-publisher"), (n.rlike(r"Client|Gateway|ServiceClient|Feign|OAuth"), "external-client"), (n.rlike(r"Service$"), "service"),
    ], F.lit("helper"))
    return F.when(_c(kind).isin("repository", "service", "controller"), _c(kind)).otherwise(by_name)


def service_from_title(x: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"(?i)\s+with\s+.*$", ""))


def sanitize_name(x: ColumnOrName) -> Column:
    return F.lower(_chain(_c(x), (r"[^a-zA-Z0-9._-]+", "-"), (r"-+", "-"), (r"^-|-$", "")))


def sanitize_title(x: ColumnOrName, default: str = "Imported Document") -> Column:
    return _blank_to(F.trim(_chain(_c(x), (r"\.[^.]+$", ""), (r"[_-]+", " "))), F.lit(default))


def strip_generic(x: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"<.*>", ""))


def lower_camel(x: ColumnOrName) -> Column:
    return F.concat(F.lower(F.substring(_c(x), 1, 1)), F.substr(_c(x), F.lit(2)))
