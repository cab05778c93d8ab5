"""Node and edge tables: patterns, building, integrity rules, reachability."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import slugify
from quarry.operators.durable import saved
from quarry.operators.relational import ordinals, ranks, unique_by


def match_edge(nodes: DataFrame, edges: DataFrame, src_label: str, kind: str, dst_label: str) -> DataFrame:
    """(src, src_name, dst, dst_name) of one labelled hop."""
    n = nodes.select("id", "label", "name")
    s = n.where(F.col("label") == src_label).select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    d = n.where(F.col("label") == dst_label).select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return edges.where(F.col("type") == kind).select("src", "dst").join(s, "src").join(d, "dst").select("src", "src_name", "dst", "dst_name").distinct()


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(src, mid, dst) of a chain of two edge types."""
    a = edges.where(F.col("type") == first).select("src", F.col("dst").alias("mid"))
    b = edges.where(F.col("type") == second).select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").select("src", "mid", "dst").distinct()


def exclude_platform(df: DataFrame, columns: list[str], prefixes: list[str]) -> DataFrame:
    """Qualified names of the project: with a dot, and under no platform prefix."""
    for c in columns:
        keep = F.contains(c, F.lit("."))
        for p in prefixes:
            keep = keep & ~F.startswith(c, F.lit(p))
        df = df.where(keep)
    return df


def optional_targets(nodes: DataFrame, edges: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Sorted distinct targets per node and edge type, one column each; nodes without any are dropped."""
    wanted = edges.where(F.col("type").isin(list(kinds)))
    lists = [F.sort_array(F.collect_set(F.when(F.col("type") == k, F.col("dst")))).alias(out) for k, out in kinds.items()]
    return nodes.select(F.col("id")).join(wanted, F.col("id") == F.col("src")).groupBy("id").agg(*lists)


def call_edges(edges: DataFrame) -> DataFrame:
    """(caller_type, caller, callee_type, callee): who declares what invokes what."""
    declares = edges.where("type = 'DECLARES'")
    caller = declares.select(F.col("src").alias("caller_type"), F.col("dst").alias("caller"))
    callee = declares.select(F.col("src").alias("callee_type"), F.col("dst").alias("callee"))
    calls = edges.where("type = 'INVOKES'").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return calls.join(caller, "caller").join(callee, "callee").select("caller_type", "caller", "callee_type", "callee").distinct()


def attach_grouped(types: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Adds each part's values (key, value) as a sorted array column."""
    for name, part in parts.items():
        types = types.join(part.groupBy(key).agg(F.sort_array(F.collect_set("value")).alias(name)), key, "left")
    return types.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in parts})


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct targets per source without self edges."""
    return edges.where("src <> dst").groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def node_ids(items: DataFrame, keys: list[str], kind: Column, name: str, order: list, short: bool = False) -> DataFrame:
    """id = kind.slug(name).n with n the place of the item within its kind. Short keys, of a bounded number of items, are
    numbered in one window each."""
    placed = (ordinals if short else ranks)(items.withColumn("__kind", kind), [*keys, "__kind"], order, "__n")
    return placed.withColumn("id", F.concat_ws(".", "__kind", slugify(name), F.col("__n").cast("string"))).drop("__kind", "__n")


#: Node type and id prefix of each section.
SECTION_NODES = {
    "context": ("Context", "ctx"), "interfaces": ("Interface", "iface"), "data_flows": ("DataFlow", "flow"), "processes": ("Process", "proc"),
    "rules": ("Rule", "rule"), "security": ("Security", "sec"), "dependencies": ("Dependency", "dep"), "examples": ("Example", "ex"), "acceptance_criteria": ("Acceptance", "acc"),
}
#: Words in items that seed nodes of operation.
SEED_NODES = [("ExternalSystem", "ext", r"(?i)external|third.party|provider"), ("Monitor", "mon", r"(?i)monitor|observ"), ("Metric", "met", r"(?i)metric|latency|throughput"), ("Alert", "alert", r"(?i)alert|alarm")]


def canonical_nodes(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes (doc, id, type, name) of section items(key, section, item_ord, item), with seeded ones by keyword."""
    kinds = F.create_map(*(F.lit(x) for s, (t, p) in SECTION_NODES.items() for x in (s, f"{t}:{p}")))
    # All nodes of an item in one pass: items are dear, as they are made of texts.
    held = F.array(F.try_element_at(kinds, F.col("section")), *(F.when(F.col("item").rlike(pattern), F.lit(f"{t}:{p}")) for t, p, pattern in SEED_NODES))
    both = items.select(key, "section", "item_ord", "item", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("__m"))
    both = both.withColumns({"type": F.substring_index("__m", ":", 1), "prefix": F.substring_index("__m", ":", -1)}).drop("__m")
    # The items of a document came from one text.
    return node_ids(both, [key], F.col("prefix"), "item", ["section", "item_ord"], short=True).select(key, "id", "type", F.col("item").alias("name"), "section", "item_ord")


#: Which node types are linked one by one, in turn, and how.
TURN_EDGES = [("Interface", "Process", "exposes"), ("Process", "DataFlow", "flows"), ("Security", "Interface", "guards"), ("Rule", "Process", "refines"), ("Monitor", "Process", "observes"), ("Alert", "Monitor", "triggers"), ("Process", "Dependency", "uses"), ("Acceptance", "Process", "supports")]


def canonical_edges(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Containment by the document, and the i-th node of one type to the (i mod n)-th of another."""
    out = nodes.select(key, F.concat(F.lit("system."), F.col(key).cast("string")).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"))
    placed = saved(ordinals(nodes, [key, "type"], ["section", "item_ord", "id"], "n").withColumn("n", F.col("n") - 1), "canonical-places")
    rules = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(e).alias("e")) for a, b, e in TURN_EDGES))
    sizes = placed.groupBy(key, F.col("type").alias("b")).agg(F.count("*").alias("size"))
    left = placed.withColumn("r", F.explode(rules)).where("type = r.a").select(key, F.col("id").alias("src"), "n", F.col("r.b").alias("b"), F.col("r.e").alias("e"))
    asked = left.join(sizes.hint("merge"), [key, "b"]).withColumn("at", F.col("n") % F.col("size"))
    right = placed.select(key, F.col("type").alias("b"), F.col("n").alias("at"), F.col("id").alias("dst"))
    return out.unionByName(asked.join(right.hint("merge"), [key, "b", "at"]).select(key, "src", "dst", F.col("e").alias("type")))


def cross_edges(left: DataFrame, right: DataFrame, group: str, kind: str, order: list, cap: int | None = None) -> DataFrame:
    """All edges between two small node sets of a group; the left side may be capped, as such drawings are."""
    if cap is not None:
        left = left.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")
    return left.select(group, F.col("id").alias("src")).join(right.select(group, F.col("id").alias("dst")), group).select(group, "src", "dst", F.lit(kind).alias("type"))


def edge_phrases(nodes: DataFrame, edges: DataFrame, phrases: dict[tuple[str, str], str], default: str) -> DataFrame:
    """A phrase per edge by the labels of its ends."""
    s = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"), F.col("name").alias("src_name"))
    d = nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"), F.col("name").alias("dst_name"))
    verb = F.lit(default)
    for (a, b), text in phrases.items():
        verb = F.when((F.col("src_label") == a) & (F.col("dst_label") == b), text).otherwise(verb)
    return edges.join(s, "src").join(d, "dst").select("src", "dst", F.concat_ws(" ", "src_name", verb, "dst_name").alias("phrase"))


def chains(nodes: DataFrame, edges: DataFrame, label: str, skip: str) -> DataFrame:
    """One label per node: its name and its targets' names in order."""
    s = nodes.where(F.col("label") == label).select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    d = nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    hops = edges.where(F.col("type") != skip).select("src", "dst").distinct().join(s, "src").join(d, "dst")
    return hops.groupBy("src", "src_name").agg(F.concat_ws(" -> ", F.first("src_name"), F.array_join(F.array_sort(F.collect_set("dst_name")), ", ")).alias("chain")).select("src", "chain")


def graph_rules(nodes: DataFrame, edges: DataFrame, linked: dict[str, str]) -> DataFrame:
    """(rule, node) of nodes that break an integrity rule: nodes of a label need an edge in, out or either way; ends must exist."""
    out, into = edges.select(F.col("src").alias("id")).distinct(), edges.select(F.col("dst").alias("id")).distinct()
    both = out.union(into).distinct()
    broken = None
    for label, way in linked.items():
        part = nodes.where(F.col("label") == label).join({"out": out, "in": into}.get(way, both), "id", "left_anti").select(F.lit(f"{label} needs an edge ({way})").alias("rule"), F.col("id").alias("node"))
        broken = part if broken is None else broken.union(part)
    known = nodes.select("id").distinct()
    return broken.union(both.join(known, "id", "left_anti").select(F.lit("edge end must exist").alias("rule"), F.col("id").alias("node")))


def issue_nodes(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues as nodes, and their edges to the nodes that caused them."""
    named = issues.withColumn("id", F.concat(F.lit("issue."), F.substring(F.sha2(F.concat_ws("|", "rule", F.col("node").cast("string")), 256), 1, 12)))
    return named.select("id", F.lit("Issue").alias("label"), F.col("rule").alias("name")), named.select(F.col("id").alias("src"), F.col("node").cast("string").alias("dst"), F.lit("caused_by").alias("type"))


def reachable(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth): least number of hops from any start node. Frontier joins; every second round is saved, which cuts
    the lineage."""
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        if depth % 2 == 0:
            frontier = saved(frontier, "frontier")
        seen = seen.unionByName(frontier)
        if depth % 2 == 0:
            seen = saved(seen, "reached")
            if frontier.isEmpty():
                break
    return seen


def graph_preview(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("label").alias("type"), "name", F.lit("active").alias("status"))


def context_nodes(parts: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Union of row sources (id, name) with a kind and a cap each; the first of equal ids stays."""
    out = None
    for at, (part, kind, cap) in enumerate(parts):
        rows = part.select("id", "name").orderBy("id").limit(cap).withColumns({"kind": F.lit(kind), "rank": F.lit(at)})
        out = rows if out is None else out.unionByName(rows)
    return unique_by(out, ["id"], ["rank"]).select("id", "name", "kind")
