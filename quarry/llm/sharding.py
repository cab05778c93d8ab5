"""Operator 1, sharding by balanced label propagation (DataFrame operations only).

Documents with equal texts are linked. Starting from hashed shards, each round
lets linked documents move to the shard that holds most of their neighbours.
All neighbours of a document share a text, so the votes of a whole group are
its numbers of members per shard: one aggregation gives them, and a group of a
third of all rows is one small row. Moves into a shard go by whole (group,
shard) cells, largest first, up to the shard's capacity; what does not fit
tries the next best shard with room in the next round, until no group is cut or
no move is left (at most `ROUNDS` rounds). Groups of more than a quarter of a
shard, of which there are fewer than eight times as many as shards, are placed
first, largest first: whole where a shard has room, else over the shards with
most room, so that a group lies in no more shards than it must, plus one.

Law `rows`: the numbers of documents per shard differ by one at most. Unlinked
documents have no edges to cut and fill the gaps; a last step moves exactly the
surplus of each shard to the free slots of others.

Defined results: a null text counts as an empty one; rows are placed one by
one, also repeated ones; ties go by hash; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions_for, stored, table

SHARDS, ROUNDS = 8, 16
#: Rank buckets per shard and class; ranks are taken within a bucket.
RANK_BUCKETS = 1024
_CELL_BUCKETS = 256
_KEY = ["g_hash", "text_crc32", "size"]


def _cumulative(counts: F.Column) -> F.Column:
    """Running sums of an array."""
    return F.transform(counts, lambda x, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))


def _placed(groups: DataFrame, capacity: int, shards: int) -> tuple[DataFrame, list[int]]:
    """(groups, those of more than a quarter of a shard with their places; rows of these per shard). Only these few
    groups' counts reach the driver: fewer than eight times as many rows as shards."""
    room, places = [capacity] * shards, []
    large = groups.where(F.col("n") * 4 > capacity).collect()
    for r in sorted(large, key=lambda r: (-r["n"], r["g_hash"], r["text_crc32"], r["size"])):
        held, rest, near = [0] * shards, r["n"], r["held"]
        while rest:
            fits = [s for s in range(shards) if room[s] >= rest]
            if fits:  # where most neighbours are, ties by the tightest shard
                at = max(fits, key=lambda s: (near[s], -room[s], -s))
            else:
                at = max(range(shards), key=lambda s: (room[s], near[s], -s))
            # What is beyond all capacity goes on top of it; the last step evens that out.
            take = min(rest, room[at]) if room[at] > 0 else rest
            held[at] += take
            room[at] -= take
            rest -= take
        places.append({**{k: r[k] for k in _KEY}, "n": r["n"], "held": held})
    small = groups.where(F.col("n") * 4 <= capacity).select(*_KEY, "n", "held", F.lit(False).alias("placed"))
    rows = F.from_json(F.lit(json.dumps(places)), "array<struct<g_hash: long, text_crc32: long, size: long, n: long, held: array<long>>>")
    placed = groups.sparkSession.range(1).select(F.inline(rows)).withColumn("placed", F.lit(True))
    return small.union(placed), [capacity - x for x in room]


def _propagate(groups: DataFrame, total: int, shards: int, rounds: int) -> DataFrame:
    """Moves the members of groups (array `held`: members per shard) towards their majority shards."""
    capacity = max(1, total // shards)
    groups, load = _placed(stored(groups, "shard-groups"), capacity, shards)
    state = stored(groups, "shard-groups")
    for turn in range(rounds):
        if turn:
            now = state.agg(F.sum(F.when(~F.col("placed"), F.col("n") - F.array_max("held"))).alias("cut"), *(F.coalesce(F.sum(F.element_at("held", s + 1)), F.lit(0)) for s in range(shards))).first()
            if not now["cut"]:
                break
            load = now[1:]
        # The best shard with room for the rest of the group: most neighbours, ties by the group's hash. In the first
        # round all are on the move, and what the placed groups leave is open.
        room = F.array(*(F.lit(capacity - int(load[s])).cast("long") for s in range(shards)))
        fits = lambda c, s: F.element_at(room, s + 1) >= F.col("n") - (c if turn else F.lit(0))  # noqa: B023, E731
        ranked = F.transform(
            F.col("held"),
            lambda c, s: F.struct((fits(c, s) & (c > 0)).alias("open"), c.alias("c"), F.xxhash64("g_hash", s).alias("tie"), s.cast("int").alias("s")),
        )
        best = state.withColumn("best", F.array_max(ranked)).withColumn("target", F.when(F.col("best.open") & ~F.col("placed"), F.col("best.s")))
        # A cell moves if it is no larger than the target's; out of a full shard, where its group cannot meet,
        # also if it is larger.
        moves = lambda c, s: F.col("target").isNotNull() & (s != F.col("target")) & (c > 0) & ((c <= F.col("best.c")) | ~fits(c, s))
        place = lambda c, s: (63 - F.floor(F.log2(c.cast("double")))) * _CELL_BUCKETS + F.pmod(F.xxhash64("g_hash", s, F.lit(1)), F.lit(_CELL_BUCKETS))
        cells = best.select(
            "target",
            F.posexplode(F.transform("held", lambda c, s: F.struct(moves(c, s).alias("moves"), c.alias("c"), F.when(c > 0, place(c, s)).cast("long").alias("place")))).alias("shard", "cell"),
        ).where("cell.c > 0")
        stays = cells.where("NOT cell.moves").groupBy(F.col("shard").alias("target")).agg(F.sum("cell.c").alias("stay"))
        wants = cells.where("cell.moves").groupBy("target", F.col("cell.place").alias("place")).agg(F.sum("cell.c").alias("c"))
        reached = wants.withColumn("seen", F.sum("c").over(Window.partitionBy("target").orderBy("place")))
        allowed = (
            reached.join(stays, "target", "left").where(F.col("seen") <= capacity - F.coalesce("stay", F.lit(0)))
            .groupBy("target").agg(F.max("place").alias("place")).collect()
        )  # one row per shard
        if not allowed:
            break
        limits = {r["target"]: r["place"] for r in allowed}
        limit = F.element_at(F.array(*(F.lit(limits.get(s, -1)).cast("long") for s in range(shards))), F.col("target") + 1)
        goes = lambda c, s: F.coalesce(moves(c, s) & (place(c, s) <= limit), F.lit(False))
        gone = F.transform("held", lambda c, s: F.when((c > 0) & goes(c, s), c).otherwise(F.lit(0).cast("long")))
        inflow = F.aggregate("gone", F.lit(0).cast("long"), lambda a, b: a + b)
        moved = best.withColumn("gone", gone).withColumn("inflow", inflow).withColumn(
            "held", F.transform("held", lambda c, s: c - F.element_at(F.col("gone"), s + 1) + F.when(s == F.col("target"), F.col("inflow")).otherwise(F.lit(0)))
        )
        state = stored(moved.select(*_KEY, "n", "held", "placed"), "shard-groups")
    return state


def balanced_shards(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nodes = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g_hash"), F.xxhash64(F.col("doc_id"), F.lit(17)).alias("d_hash"),
        ), "shard-nodes",
    )
    first = F.pmod("d_hash", F.lit(shards)).cast("int")
    total = nodes.count()
    groups = nodes.groupBy(*_KEY).agg(F.count("*").alias("n"), F.array(*(F.count_if(first == s) for s in range(shards))).alias("held")).where("n > 1")
    state = _propagate(groups, total, shards, rounds)
    # Most groups have one cell. Members of the others are dealt to the cells by their rank: the rank within a hash
    # bucket plus the members of the buckets before it.
    dealt = state.withColumn("upto", _cumulative(F.col("held"))).withColumn("cells", F.size(F.filter("held", lambda c: c > 0))).select(*_KEY, "n", "upto", "cells")
    at = lambda rank: F.size(F.filter("upto", lambda x: x <= rank)).cast("int")
    linked = F.col("n").isNotNull()
    plain = nodes.join(dealt, _KEY, "left").where("cells IS NULL OR cells = 1").withColumn("label", F.when(linked, at(F.lit(0))).otherwise(first))
    cut = nodes.join(dealt.where("cells > 1"), _KEY).withColumn("deal", F.pmod(F.xxhash64("d_hash", F.lit(3)), F.lit(RANK_BUCKETS)))
    # Dealt out by (group, deal) before the windows: after a join by group, a cut group would lie in one task.
    cut = cut.repartition(partitions_for(docs.sparkSession), *_KEY, "deal")
    ahead = cut.groupBy(*_KEY, "deal").agg(F.count("*").alias("rows"))
    ahead = ahead.select(*_KEY, "deal", (F.sum("rows").over(Window.partitionBy(*_KEY).orderBy("deal")) - F.col("rows")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy(*_KEY, "deal").orderBy("d_hash", "doc_id")) - 1
    cut = cut.withColumn("within", within).join(ahead, [*_KEY, "deal"]).withColumn("label", at(F.col("within") + F.col("ahead")))
    columns = ["doc_id", *_KEY, "d_hash", "n", "label"]
    labelled = stored(
        plain.select(columns).union(cut.select(columns))
        # Large groups first, then small ones, each in one piece, then unlinked documents: the surplus of a
        # shard is taken from the end. Members of large groups are spread over the buckets.
        .withColumn("class", F.when(~linked, 2).when(F.col("n") > total // (shards * 64) + 1, 0).otherwise(1))
        .withColumn("o_hash", F.when(F.col("class") == 1, F.col("g_hash")).otherwise(F.col("d_hash")))
        .withColumn("bucket", (F.col("class") * RANK_BUCKETS + F.pmod(F.xxhash64("o_hash", F.lit(5)), F.lit(RANK_BUCKETS))).cast("int"))
        .select("doc_id", "size", "text_crc32", "label", "bucket", "o_hash", "d_hash"), "shard-labels",
    )
    # Rank within a shard: rank within a bucket plus the rows of the buckets before it.
    counts = labelled.groupBy("label", "bucket").agg(F.count("*").alias("rows"))
    before = counts.withColumn("before", F.sum("rows").over(Window.partitionBy("label").orderBy("bucket")) - F.col("rows")).drop("rows")
    sizes = {r["label"]: r["rows"] for r in counts.groupBy("label").agg(F.sum("rows").alias("rows")).collect()}  # one row per shard
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over, free = [0], [0]
    for s in range(shards):
        over.append(over[-1] + max(0, sizes.get(s, 0) - quota[s]))
        free.append(free[-1] + max(0, quota[s] - sizes.get(s, 0)))
    longs = lambda xs: F.array(*(F.lit(int(x)).cast("long") for x in xs))
    rank = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("o_hash", "d_hash", "doc_id", "text_crc32", "size")) - 1
    ranked = labelled.withColumn("rank", rank).join(before, ["label", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    spare = F.when(F.col("rank") >= F.element_at(longs(quota), F.col("label") + 1), F.element_at(longs(over), F.col("label") + 1) + F.col("rank") - F.element_at(longs(quota), F.col("label") + 1))
    to = F.when(F.col("spare").isNull(), F.col("label")).otherwise(F.size(F.filter(longs(free[1:]), lambda x: x <= F.col("spare"))))
    held = longs([min(sizes.get(s, 0), quota[s]) for s in range(shards)])
    slot = F.when(F.col("spare").isNull(), F.col("rank")).otherwise(F.element_at(held, F.col("shard") + 1) + F.col("spare") - F.element_at(longs(free), F.col("shard") + 1))
    return (
        ranked.withColumn("spare", spare).withColumn("shard", to.cast("int")).withColumn("slot", slot.cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
