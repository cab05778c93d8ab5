"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.common import stored, tasks_for


def _joined(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with what is known of u, that per u): the least node m around u, and the neighbours below and above u.
    Neighbours are summed up before they are joined back, so a hub is one small row on one side and a splittable run
    of rows on the other."""
    known = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))
    return edges.join(known, "u"), known


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges(a, b); the component is its least id.

    Rounds go on until every node is either above one node and below none, or below others only: stars around
    the least ids. That takes a number of rounds that grows with the logarithm of the nodes."""
    held = Observation()
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stored(links.observe(held, F.count("*").alias("rows")), "links")
    n = tasks_for(2 * held.get["rows"])
    while True:
        # Large star: neighbours above a node join the least node around it.
        seen = Observation()
        joined, _known = _joined(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        joined = joined.observe(seen, F.count_if((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") > 0))).alias("loose"))
        wide = stored(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(n), "links")
        if not seen.get["loose"]:
            break
        # Small star: neighbours below a node, and the node, join the least of them.
        joined, known = _joined(wide)
        near = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(known.select("u", F.col("m").alias("v")))
        links = stored(near.where("u > v").distinct().coalesce(n), "links")
    heads = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(heads)
