"""Versions, deltas and run-log accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import content_hash
from quarry.operators.linking import longest_key
from quarry.operators.relational import latest


def stale(docs: DataFrame, versions: DataFrame, keys: list[str], digest: str = "hash", at: str = "created_at") -> DataFrame:
    """Documents whose latest version has another digest, or that have none."""
    last = latest(versions.select(*keys, digest, at), keys, at, digest).select(*keys, F.col(digest).alias("__last"))
    return docs.join(last, keys, "left").where((F.col(digest) != F.col("__last")) | F.col("__last").isNull()).drop("__last")


def checkpoint_rows(docs: DataFrame, versions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """What must be written: documents whose content differs from their latest version."""
    return stale(docs.withColumn("hash", content_hash(text)), versions, keys)


def by_freshness(versions: DataFrame, keys: list[str], at: str) -> DataFrame:
    return versions.groupBy(*keys).agg(F.max(at).alias("last_at")).orderBy(F.desc("last_at"), *keys)


def usage_cost(usage: DataFrame, prices: DataFrame, keys: list[str], model: str = "model", price_key: str = "price_key", default: str = "default") -> DataFrame:
    """Sums of four token classes and their cost; the longest price key that a model name contains counts."""
    priced = longest_key(usage, prices, model, price_key, default)
    classes = ["input", "cache_create", "cache_read", "output"]
    cost = sum((F.col(c) * F.col(f"{c}_price") for c in classes), F.lit(0.0)) / 1_000_000
    return priced.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in classes), F.round(F.sum(cost), 4).alias("cost"), F.sort_array(F.collect_set(model)).alias("models"))


def run_progress(runs: DataFrame, modules: DataFrame, key: str, stages: int) -> DataFrame:
    """Completed stages and modules over all, in whole percent from 0 to 100."""
    done = modules.groupBy(key).agg(F.count("*").alias("n_modules"), F.count_if(F.col("status") == "completed").alias("n_done"))
    joined = runs.join(done, key, "left").fillna(0, ["n_modules", "n_done"])
    percent = F.floor(100.0 * (F.col("stages_done") + F.col("n_done")) / (F.lit(stages) + F.col("n_modules")) + 0.5)
    return joined.select(key, F.greatest(F.lit(0), F.least(F.lit(100), percent)).cast("int").alias("percent"))


def task_metrics(tasks: DataFrame) -> DataFrame:
    """Tasks, share of drift among finished ones, mean risks, share of finished ones."""
    done = F.col("status") == "done"
    return tasks.agg(
        F.count("*").alias("n_tasks"), F.round(F.count_if(done & F.col("drift")) / F.count_if(done), 4).alias("drift_rate"),
        F.round(F.avg("n_risks"), 4).alias("mean_risks"), F.round(F.count_if(done) / F.count("*"), 4).alias("done_ratio"),
    )


def since_last_sync(tasks: DataFrame, syncs: DataFrame, key: str, at: str, order: list, k: int = 5) -> DataFrame:
    """Tasks after the last sync of their key; the last k of keys that never synced."""
    from quarry.operators.relational import top_k

    last = syncs.groupBy(key).agg(F.max(at).alias("__last"))
    joined = tasks.join(last, key, "left")
    fresh = joined.where(F.col(at) > F.col("__last")).drop("__last")
    never = top_k(joined.where("__last IS NULL").drop("__last"), [key], order, k)
    return fresh.unionByName(never)


def low_confidence(candidates: DataFrame, limit: float = 0.7, cap: int = 8) -> DataFrame:
    return candidates.where(F.col("confidence") < limit).orderBy("confidence", "target_id").limit(cap)


def review_dossier(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Counts of nodes and edges, distinct labels, and the nodes with most edges."""
    degree = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("n"))
    top = degree.orderBy(F.desc("n"), "id").limit(k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "id"))), lambda x: x["id"].cast("string")), ",").alias("focus"))
    return nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("label").alias("n_labels")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(top)  # one row each
