"""Entrypoints, traces, clusters and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import flow_actor, flow_type, slugify, step_role
from quarry.operators.relational import step_pairs, top_k, unique_by


def supplement(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Adds the extra rows whose key the base lacks."""
    return base.unionByName(extra.join(base.select(key).distinct(), key, "left_anti").select(base.columns))


def entrypoints(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Union of sources (name, target) with the kind each has; the first of equal ids stays."""
    out = None
    for at, (part, kind) in enumerate(parts):
        rows = part.select("name", "target").withColumns({"kind": F.lit(kind), "rank": F.lit(at)})
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("entry_id", F.concat_ws(".", F.lit("entry"), "kind", slugify("name", 80)))
    return unique_by(out, ["entry_id"], ["rank", "target"]).select("entry_id", "kind", "name", "target", step_role("kind").alias("role"), flow_type("kind").alias("flow_type"))


def flow_traces(entries: DataFrame, steps: list[tuple[DataFrame, str, int]], key: str = "entry_id") -> DataFrame:
    """The entry step, then up to n matched steps of each role (parts of (key, node, score)); equal (role, node) once."""
    out = entries.select(key, F.col("name").alias("node"), F.col("role"), F.lit(0).alias("part"), F.lit(1).alias("place"))
    for at, (part, role, n) in enumerate(steps, 1):
        best = top_k(part, [key], [F.desc("score"), "node"], n)
        placed = best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "node")))
        out = out.unionByName(placed.select(key, "node", F.lit(role).alias("role"), F.lit(at).alias("part"), "place"))
    once = unique_by(out, [key, "role", "node"], ["part", "place"])
    return once.withColumn("step_ord", F.row_number().over(Window.partitionBy(key).orderBy("part", "place"))).select(key, "step_ord", "role", "node")


def cluster_traces(traces: DataFrame, group: str, key: str = "trace_id", evidence: int = 16) -> DataFrame:
    """Traces by anchor: the first service step, else the first step. Only `evidence` traces are listed."""
    order = F.struct("step_ord", "node")
    anchors = traces.groupBy(group, key).agg(F.coalesce(F.min_by(F.when(F.col("role") == "service", F.col("node")), F.when(F.col("role") == "service", order)), F.min_by("node", order)).alias("anchor"))
    named = anchors.withColumn("cluster", slugify("anchor", 80))
    few = top_k(named, [group, "cluster"], [key], evidence).groupBy(group, "cluster").agg(F.sort_array(F.collect_list(key)).alias("evidence"))
    return named.groupBy(group, "cluster").agg(F.count("*").alias("n_traces"), F.min("anchor").alias("anchor")).join(few, [group, "cluster"])


def known_flow(entries: DataFrame, flows: DataFrame, keys: list[str], pairs: DataFrame, order: list) -> DataFrame:
    """The first known flow of each entrypoint among candidate pairs; entrypoints without any keep a null."""
    return entries.join(unique_by(pairs, keys, order), keys, "left")


def semantic_flows(clusters: DataFrame, traces: DataFrame, group: str, kind: Column, known: Column, key: str = "trace_id") -> DataFrame:
    """One flow per cluster: type, actor, path, outcome (its last step) and confidence."""
    first = F.element_at("evidence", 1).alias(key)
    lead = clusters.select(group, "cluster", "anchor", "n_traces", first, kind.alias("kind"), known.alias("known"))
    path = traces.groupBy(group, key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_ord", "node"))), lambda x: x["node"]), " -> ").alias("path"), F.max_by("node", "step_ord").alias("outcome"), F.count("*").alias("n_steps"))
    joined = lead.join(path, [group, key])
    confidence = F.when(F.col("known"), 0.9).when(F.col("n_steps") > 2, 0.78).otherwise(0.62)
    return joined.select(group, "cluster", F.concat_ws(" ", "anchor", F.lit("flow")).alias("name"), flow_type("kind").alias("flow_type"), flow_actor("kind").alias("actor"), "path", "outcome", confidence.alias("confidence"))


def broken_edges(steps: DataFrame, edges: DataFrame, key: str, node: str = "node") -> DataFrame:
    """Consecutive steps without an edge in either direction."""
    pairs = step_pairs(steps, [key], ["step_ord"], node, short=True).select(key, F.col(node).alias("src"), F.col("next_node").alias("dst"))
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return pairs.join(both, ["src", "dst"], "left_anti").select(key, "src", "dst")


def missing_nodes(steps: DataFrame, nodes: DataFrame, key: str, node: str = "node") -> DataFrame:
    """Steps that are neither an id nor a name, whatever its case."""
    known = nodes.select(F.lower(F.col("id").cast("string")).alias("__k")).union(nodes.select(F.lower("name"))).distinct()
    return steps.withColumn("__k", F.lower(F.col(node).cast("string"))).join(known, "__k", "left_anti").select(key, node)


def validate_flows(steps: DataFrame, nodes: DataFrame, edges: DataFrame, key: str, least_steps: int = 2) -> DataFrame:
    """(key, code) of the issues of flows."""
    sizes = steps.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "helper").alias("helpers"), F.countDistinct("group_name").alias("groups"))
    code = lambda df, c: df.select(key, F.lit(c).alias("code")).distinct()
    return (
        code(sizes.where(F.col("n") < least_steps), "low_evidence").union(code(sizes.where(F.col("helpers") * 2 > F.col("n")), "utility_noise"))
        .union(code(sizes.where("groups > 2"), "mixed_flow")).union(code(missing_nodes(steps, nodes, key), "missing_node")).union(code(broken_edges(steps, edges, key), "broken_edge"))
    )


def module_traces(endpoints: DataFrame, module: str, name: str, order: list, presence: dict[str, Column], k: int = 12) -> DataFrame:
    """The first endpoint traces of each module and one row per presence rule that holds."""
    first = top_k(endpoints, [module], order, k).select(module, F.col(name).cast("string").alias("trace"))
    flags = endpoints.groupBy(module).agg(*(F.bool_or(c).alias(n) for n, c in presence.items()))
    rules = F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in presence)), lambda x: x.isNotNull())
    return first.union(flags.select(module, F.explode(rules)))
