"""Integrity rules of a semantic graph, edges of what processes use, processes of persistence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.linking import contains_either

#: Nodes that need a link of a way to a node of some types; no types: to any node or edge.
INTEGRITY_RULES = [
    ("process without interface, data flow or dependency", "Process", "any", ["Interface", "DataFlow", "Dependency"]),
    ("transformation without input flow", "Transformation", "in", ["DataFlow"]),
    ("transformation without output flow", "Transformation", "out", ["DataFlow"]),
    ("security policy without rule or issue", "SecurityPolicy", "any", ["Rule", "Issue"]),
    ("dependency without user", "Dependency", "any", ["Process", "Interface"]),
    ("issue without cause", "Issue", "out", []),
    ("acceptance criterion without intent or process", "AcceptanceCriterion", "any", ["Intent", "Process"]),
]
EXTERNAL_RULE, EXTERNAL_TYPES = "external integration of another type", ["ExternalSystem", "IntegrationEndpoint", "Dependency"]
MONITOR_RULE, MONITOR_TYPES = "monitored concern without monitor, metric or alert", ["Monitor", "Metric", "Alert"]


def integrity_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, node) of nodes that break one of eight rules. nodes(id, type, external, monitored), the flags null or boolean;
    edges(src, dst) and, where issues point to edges, their id.

    Both ends of each edge learn the other's type; a node keeps one boolean per rule, so hubs cost partial sums, not lists."""
    kinds = nodes.select(F.col("id").alias("other"), "type")
    if "id" in edges.columns:
        kinds = kinds.union(edges.select("id", F.lit("Edge")))
    kinds = kinds.where("other IS NOT NULL").groupBy("other").agg(F.min("type").alias("other_type"))
    both = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("way")))
    ends = edges.select(F.inline(both)).join(kinds, "other")

    def met(way: str, types: list[str]) -> Column:
        of = F.col("other_type").isin(types) if types else F.lit(True)
        return F.bool_or(of if way == "any" else of & (F.col("way") == way))

    rules = [(text, F.col("type") == kind, met(way, types)) for text, kind, way, types in INTEGRITY_RULES]
    rules.append((MONITOR_RULE, F.coalesce("monitored", F.lit(False)), met("any", MONITOR_TYPES)))
    seen = ends.groupBy("id").agg(*(m.alias(f"ok{i}") for i, (_, _, m) in enumerate(rules)))
    found = [F.when(need & ~F.coalesce(f"ok{i}", F.lit(False)), text) for i, (text, need, _) in enumerate(rules)]
    found.append(F.when(F.coalesce("external", F.lit(False)) & ~F.coalesce(F.col("type").isin(EXTERNAL_TYPES), F.lit(False)), EXTERNAL_RULE))
    out = nodes.join(seen, "id", "left").select(F.explode(F.array(*found)).alias("rule"), F.col("id").alias("node"))
    return out.where("rule IS NOT NULL").distinct()


def dependency_edges(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, src, dst, type): processes to the dependencies whose name holds theirs or is held by it, the service to all of
    its document. Edges to nodes of type Persistence write, others depend. nodes(key, id, type, name)."""
    kind = F.when(F.col("type") == "Persistence", "writesTo").otherwise("dependsOn")
    used = nodes.where("type IN ('Dependency', 'Persistence')").select(key, F.col("id").alias("dst"), kind.alias("edge"), F.col("name").alias("__b"))
    process = nodes.where("type = 'Process' AND name <> ''").select(key, F.col("id").alias("src"), F.col("name").alias("__a"))
    held = contains_either(process, used.where("__b <> ''"), "__a", "__b", within=(key,))
    whole = nodes.where("type = 'Service'").select(key, F.col("id").alias("src")).join(used.hint("merge"), key)
    return reduce(DataFrame.unionByName, (df.select(key, "src", "dst", F.col("edge").alias("type")) for df in (held, whole))).distinct()


def persistence_processes(nodes: DataFrame) -> DataFrame:
    """Names `<domain> persistence`, each once, of repositories by type or name. nodes(type, name)."""
    repository = F.contains(F.lower("type"), F.lit("repository")) | F.lower("name").rlike("(repository|repo)$")
    domain = F.regexp_replace("name", "(?i)(repository|repo)$", "")
    return nodes.where(repository).select(domain.alias("domain")).where("domain <> ''").select(F.concat("domain", F.lit(" persistence")).alias("process")).distinct()
