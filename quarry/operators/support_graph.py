"""The support graph of applications, its containment closure, and the cards read from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import base_name, slugify
from quarry.operators.durable import saved
from quarry.operators.relational import top_k, unique_by

#: Items that a node or card lists; their number is whole.
ITEMS_MOST = 20
_FACT = ["project", "app_id", "app", "part", "label", "item", "ord"]


def support_facts(layouts: DataFrame, layers: DataFrame, modules: DataFrame, packages: DataFrame, flows: DataFrame) -> DataFrame:
    """Evidence of applications as one tagged relation (project, app_id, app, part, label, item, ord).

    layouts(project, app_root, role, ord); layers(project, app, layer, item, ord); modules(project, parent, module, ord):
    a module belongs to the applications whose name its parent ends with; packages(project, app, package, ord);
    flows(project, app, flow, ord), of applications that need no layout. app is the last part of app_root."""
    app_id = lambda c: F.concat(F.lit("application:"), slugify(c))
    apps = saved(layouts.select("project", "app_root", "role", "ord", base_name("app_root").alias("app"), app_id("app_root").alias("app_id")), "support-apps")
    named = unique_by(apps.select("project", "app", "app_id", "ord"), ["project", "app"], ["ord"]).drop("ord")
    fact = lambda df, part, label, item: df.select("project", "app_id", "app", F.lit(part).alias("part"), label.alias("label"), F.col(item).alias("item"), F.col("ord").cast("long").alias("ord"))
    own = fact(apps, "application", F.col("app"), "role")
    by_name = lambda df: df.join(apps.select("project", "app", "app_id"), ["project", "app"])
    ends = modules.withColumn("app", F.explode(F.transform(F.sequence(F.lit(1), F.length("parent")), lambda k: F.substr("parent", k))))
    flowing = flows.join(named, ["project", "app"], "left").withColumn("app_id", F.coalesce("app_id", app_id("app")))
    return reduce(DataFrame.unionByName, [
        own, fact(by_name(layers), "layer", F.col("layer"), "item"), fact(by_name(ends), "module-group", F.lit("modules"), "module"),
        fact(by_name(packages), "package-group", F.lit("package slices"), "package"), fact(flowing, "flow-group", F.concat_ws(" ", "app", F.lit("flows")), "flow"),
    ]).where("item IS NOT NULL")


def support_graph(facts: DataFrame, externals: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of projects, applications, layers, module, package and flow groups, and external systems.

    One pass of grouping sets over distinct items counts every level. nodes(project, id, type, name, app_id, n_items,
    items): the number of items is whole, the list has the first ones. edges(project, src, dst, type)."""
    item = saved(facts.groupBy("project", "app_id", "part", "label", "item").agg(F.min("app").alias("app"), F.min("ord").alias("ord")), "support-items")
    rolled = item.groupingSets([["project"], ["project", "app_id"], ["project", "app_id", "part", "label"]], "project", "app_id", "part", "label").agg(
        F.grouping_id("project", "app_id", "part", "label").alias("level"), F.min("app").alias("app"), F.count_if(F.col("part") != "application").alias("inner"), F.count_if(F.col("part") == "application").alias("own"),
        F.count_distinct("app_id").alias("apps"), F.count("*").alias("n"),
    )
    project_id = F.concat(F.lit("project:"), slugify("project"))
    group_id = F.when(F.col("part") == "layer", F.concat_ws(":", "app_id", F.lit("layer"), slugify("label"))).otherwise(F.concat_ws(":", "app_id", F.regexp_replace("part", "-group$", "s")))
    group = (F.col("level") == 0) & (F.col("part") != "application")
    levels = rolled.where((F.col("level") == 7) | ((F.col("level") == 3) & (F.col("own") > 0)) | group).select(
        "project", F.when(F.col("level") == 7, project_id).when(F.col("level") == 3, F.col("app_id")).otherwise(group_id).alias("id"),
        F.when(F.col("level") == 7, "project").when(F.col("level") == 3, "application").otherwise(F.col("part")).alias("type"),
        F.when(F.col("level") == 7, F.col("project")).when(F.col("level") == 3, F.col("app")).otherwise(F.col("label")).alias("name"), "app_id",
        F.when(F.col("level") == 7, F.col("apps")).when(F.col("level") == 3, F.col("inner")).otherwise(F.col("n")).alias("n_items"),
    )
    bare = projects.select("project").distinct().join(levels.where("type = 'project'").select("project"), "project", "left_anti")
    rest = bare.select("project", project_id.alias("id"), F.lit("project").alias("type"), F.col("project").alias("name"))
    outside = externals.where("system <> ''").select("project", F.concat(F.lit("external:"), slugify("system")).alias("id"), F.lit("external-system").alias("type"), F.col("system").alias("name"))
    outside = unique_by(outside, ["project", "id"], ["name"])
    listed = item.where("part <> 'application'").select("project", group_id.alias("id"), "item", "ord")
    few = top_k(listed, ["project", "id"], ["ord", "item"], ITEMS_MOST).groupBy("project", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]).alias("items"))
    none = F.array().cast("array<string>")
    nodes = levels.unionByName(rest, allowMissingColumns=True).unionByName(outside, allowMissingColumns=True).join(few, ["project", "id"], "left").withColumns({"items": F.coalesce("items", none), "n_items": F.coalesce("n_items", F.lit(0).cast("long"))})
    nodes = saved(nodes.select("project", "id", "type", "name", "app_id", "n_items", "items"), "support-nodes")
    edge = lambda df, src, kind: df.select("project", src.alias("src"), F.col("id").alias("dst"), F.lit(kind).alias("type"))
    edges = edge(nodes.where("type = 'application'"), project_id, "contains").union(edge(nodes.where("type = 'external-system'"), project_id, "communicates-with"))
    return nodes, edges.union(edge(nodes.where("app_id IS NOT NULL AND type <> 'application'"), F.col("app_id"), "contains"))


def nearest_containers(nodes: DataFrame, edges: DataFrame, container: str, contains: str = "contains") -> DataFrame:
    """(id, container, depth, path): the nearest node of type `container` from which a node is reached by edges that
    contain; of equally near ones the least, with the least path (ids from the container on). A walk ends at the next
    container and at nodes that are placed already, so cycles end. Containers themselves are in none.

    Each round joins the last round's nodes with the edges; the rounds are as many as the containment is deep."""
    own = saved(edges.where((F.col("type") == contains) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct(), "containment")
    heads = nodes.where(F.col("type") == container).select(F.col("id").alias("container")).distinct()
    frontier = heads.select(F.col("container").alias("id"), "container", F.lit(0).alias("depth"), F.col("container").alias("path"))
    placed = frontier
    while True:
        found = frontier.join(own, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "container", (F.col("depth") + 1).alias("depth"), F.concat_ws(" > ", "path", "dst").alias("path"))
        found = found.groupBy("id").agg(F.min(F.struct("container", "path", "depth")).alias("x")).select("id", "x.container", "x.depth", "x.path")
        frontier = saved(found.join(placed.select("id"), "id", "left_anti"), "contained")
        if frontier.isEmpty():
            return placed.where("depth > 0")
        placed = placed.unionByName(frontier)


def cards(nodes: DataFrame, edges: DataFrame, kinds: list[str], container: str = "application", most: int = ITEMS_MOST) -> DataFrame:
    """(app, card, n_items, items): the merged distinct items of all nodes(id, type, name, items) of some kinds that lie
    in an application at any depth, by lower-case name. Items are in the order of their nodes' ids, the first ones listed."""
    near = nearest_containers(nodes, edges, container).select("id", "container")
    apps = nodes.where(F.col("type") == container).select(F.col("id").alias("container"), F.col("name").alias("app"))
    rows = nodes.where(F.col("type").isin(kinds)).join(near, "id").join(apps, "container").select("app", F.lower("name").alias("card"), "id", F.posexplode("items").alias("at", "item"))
    return application_cards([rows.select("app", "card", "item", F.struct("id", "at").alias("ord"))], most)


def application_cards(parts: list[DataFrame], most: int = ITEMS_MOST) -> DataFrame:
    """(app, card, n_items, items): items of several sources(app, card, item, ord), merged by card. Those of earlier sources
    come first, and of equal items the first stays; n_items counts all, items lists the first."""
    rows = reduce(DataFrame.unionByName, [p.where("item <> ''").groupBy("app", "card", "item").agg(F.min("ord").alias("ord")).select("app", "card", "item", F.lit(k).alias("rank"), "ord") for k, p in enumerate(parts)])
    once = saved(unique_by(rows, ["app", "card", "item"], ["rank", "ord"]), "cards")
    counts = once.groupBy("app", "card").agg(F.count("*").alias("n_items"))
    few = top_k(once, ["app", "card"], ["rank", "ord", "item"], most).groupBy("app", "card").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", "item"))), lambda x: x["item"]).alias("items"))
    return counts.join(few, ["app", "card"])
