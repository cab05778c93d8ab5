"""Predicates over files, types and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.linking import contains_any


def is_http_contract(package: Column, path: Column, types: Column) -> Column:
    """An api package or folder with a type whose name ends in Api."""
    return (F.coalesce(package, F.lit("")).rlike(r"(?i)\.api(\.|$)") | path.rlike("(?i)/api/")) & F.exists(types, lambda t: t.rlike("Api$"))


def is_entity_like(path: Column, package: Column, annotations: Column, kind: Column, hints: Column) -> Column:
    """Annotated entities first; never repositories, transfer objects or generated contracts; else by place and hints."""
    package = F.coalesce(package, F.lit(""))
    hinted = F.exists(hints, lambda h: h.rlike("(?i)^@(Entity|Table|Column|ManyToOne|OneToMany|ManyToMany|JoinColumn)$"))
    return (
        F.when((kind == "repository") | path.rlike("(?i)/repository/"), False).when(F.exists(annotations, lambda a: a.rlike("(?i)^(Entity|Table)$")), True)
        .when(path.rlike("(?i)/dto/|/openapi/") | package.rlike(r"(?i)\.(dto|openapi)(\.|$)"), False).when(kind == "entity", True)
        .when(path.rlike("(?i)/persistence/entity/") | package.rlike(r"(?i)\.persistence\.entity(\.|$)"), True).otherwise(hinted)
    )


def in_scope(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def scope_items(items: DataFrame, item: str, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """Application of each item: the first whose keyword pattern it fits."""
    app = F.lit(default)
    for name, pattern in reversed(rules):
        app = F.when(F.lower(item).rlike(pattern), name).otherwise(app)
    return items.withColumn("app", app)


#: Words by which a request tells its topics.
TOPICS = {
    "is_simple": ["comment", "komment", "javadoc", "rename", "átnevez", "format", "typo", "whitespace", "indent"],
    "is_test": ["test", "teszt", "junit", "assert", "mock", "stub"],
    "is_bug_fix": ["fix", "hiba", "bug", "hibás", "broken", "npe", "exception", "javít", "crash", "error"],
    "is_config": ["config", "configuration", "property", "properties", "yml", "yaml", "env", "beállítás", "konfig"],
    "is_creating": ["new", "új", "create", "létrehoz", "implement", "generate", "scaffold", "készíts"],
    "is_api": ["openapi", "endpoint", "végpont", "dto", "swagger", "controller"],
    "is_db": ["entity", "entities", "table", "tábla", "schema", "database", "adatbázis", "migration", "repository", "sql"],
    "is_layer": ["layer", "réteg", "api", "controller", "service", "persistence", "endpoint", "interface", "rest"],
    "is_module": ["module", "modul", "service", "common", "persistence", "web", "app", "component"],
}


def topics(requests: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One flag per topic."""
    return requests.select(*keys, *(contains_any(F.col(text), words).alias(t) for t, words in TOPICS.items()))


def class_index(types: DataFrame, keys: list[str], annotations: str, methods: str, wanted: list[str], most: int = 8) -> DataFrame:
    """Types with navigation annotations, and their first method names (a display's cap)."""
    kept = F.array_intersect(annotations, F.array(*map(F.lit, wanted)))
    return types.where(F.size(kept) > 0).select(*keys, kept.alias("annotations"), F.slice(methods, 1, most).alias("methods"))


def triage(runs: DataFrame, keys: list[str], kind: str, wanted: str, records: str) -> DataFrame:
    """Records of the runs of one kind."""
    return runs.where(F.col(kind) == wanted).select(*keys, F.posexplode(records).alias("ord", "record"))


def attach_review(graphs: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Each graph with its review record, or none."""
    rest = [c for c in reviews.columns if c != key]
    return graphs.join(reviews.select(key, F.struct(*rest).alias("review")), key, "left")
