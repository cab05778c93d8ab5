"""Operator 12, Merkle manifest of a table of documents.

Leaves are hashes of rows; per language they form a tree of fixed arity by
doc_id, and the languages' roots form one tree more. A superblock is a run of
512 leaves, three levels of the tree. Superblocks are reduced to their roots,
these are grouped into superblocks again, and so on until one node is left of
each tree: every step shrinks the table 512 times.

Then the way down: the nodes of a superblock and the one row with what lies
outside it (the siblings on the way from its root to the root of all) are
cogrouped by superblock. The group repeats the local reduction, joins the local
siblings with the outer ones, and hands every node its way up; on the last step
the nodes are leaves, whose proofs are digested and folded. A group is 512 rows
and one, whatever the language's share of the table, and no node of the upper
tree is joined by a key that many rows share.

Ranks come from ranges of (language, doc_id, leaf), so a language of any size
lies in several tasks.

Defined results: nulls are hashed as `-`; a null language is a tree of its own,
before the others; null doc_ids come first and are never tampered with; rows
that repeat a doc_id are leaves of their own, in order of their hashes; an empty
table has no rows and no root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions_for, stored, table

ARITY, LOCAL_LEVELS = 8, 3
BLOCK = ARITY**LOCAL_LEVELS
_TIER = "tree string, at long, size long, node string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(size: int) -> int:
    """Levels of a tree of so many leaves that lie in one superblock."""
    n = 0
    while size > 1 and n < LOCAL_LEVELS:
        size, n = -(-size // ARITY), n + 1
    return n


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, lowest first, of one superblock."""
    out = [nodes]
    for _ in range(levels):
        out.append([_hash("".join(out[-1][i : i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, level by level."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % ARITY
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + ARITY])))
        at //= ARITY
    return out


def folded(leaf: str, way: list[tuple[str, str]]) -> str:
    for left, right in way:
        leaf = _hash(left + leaf + right)
    return leaf


def _packed(way: list[tuple[str, str]]) -> str:
    return "".join(f"{left}.{right}/" for left, right in way)


def _way(packed: str) -> list[tuple[str, str]]:
    return [tuple(x.split(".")) for x in packed.split("/")[:-1]]


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, node, changed, row): the hash of each row, and that of its tampered form where there is one."""
    text = F.col("text").cast("string")
    field = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    before = [field(F.col(c).cast("string")) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf: Column = F.sha2(F.concat(*before, field(text)), 256)
    tampered = F.sha2(F.concat(*before, field(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))), 256)
    tree = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("node"), F.when(chosen, tampered).alias("changed"), F.monotonically_increasing_id().alias("row"))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds at (place in its tree, from 0) and size (of the tree). Rows are dealt by ranges of (tree, order): a row's place
    is that in its range plus the tree's rows in the ranges before."""
    by = ["tree", *order]
    cut = stored(rows.repartitionByRange(partitions_for(rows.sparkSession), *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "merkle-ranges")
    cut = cut.withColumn("__part", F.shiftright("__at", 33))
    runs = cut.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("tree")
    before = F.sum("__n").over(own.orderBy("__part")) - F.col("__n")
    runs = runs.select("tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("size"))
    return cut.join(runs, ["tree", "__part"]).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("at"), "size")


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at")
    size = int(pdf["size"].iloc[0])
    node = reduced(pdf["node"].tolist(), _levels(size))[-1]
    return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "at": int(pdf["at"].iloc[0]) // BLOCK, "size": -(-size // BLOCK), "node": node})


def _tiers(leaf_tier: DataFrame) -> list[DataFrame]:
    """The leaves and the roots of their superblocks, tier by tier, up to one node for each tree."""
    tiers = [leaf_tier]
    block = F.floor(F.col("at") / BLOCK).alias("block")
    while (tiers[-1].agg(F.max("size").alias("n")).first()["n"] or 0) > 1:
        up = tiers[-1].select("tree", "at", "size", "node").groupBy("tree", block).applyInPandas(_reduce, _TIER)
        tiers.append(stored(up, "merkle-tier"))
    return tiers


def _ways(nodes: pd.DataFrame, outer: pd.DataFrame) -> tuple[pd.DataFrame, list[list[tuple[str, str]]]]:
    nodes = nodes.sort_values("at")
    levels = reduced(nodes["node"].tolist(), _levels(int(nodes["size"].iloc[0])))
    return nodes, [siblings(levels, i) for i in range(len(nodes))]


def _hand_down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Every node of a superblock with its way to the root of all."""
    nodes, ways = _ways(nodes, outer)
    rest = outer.iloc[0]
    return pd.DataFrame({"tree": nodes["tree"], "block": nodes["at"], "way": [_packed(w) + rest["way"] for w in ways], "subroot": rest["subroot"], "root": rest["root"]})


def _prove(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Every leaf of a superblock with the digest of its proof and the root that its proof folds to."""
    nodes, ways = _ways(nodes, outer)
    rest = outer.iloc[0]
    above, proofs, roots = _way(rest["way"]), [], []
    for leaf, changed, local in zip(nodes["node"], nodes["changed"], ways, strict=True):
        way = local + above
        proofs.append(_hash("".join(left + right for left, right in way)))
        roots.append(folded(changed if isinstance(changed, str) else leaf, way))
    return pd.DataFrame(
        {"doc_id": nodes["doc_id"].astype("Int64"), "leaf": nodes["node"], "subroot": rest["subroot"], "root": rest["root"], "proof_sha256": proofs, "folded_root": roots, "verified": [r == rest["root"] for r in roots]}
    )


_WAY = "tree string, block long, way string, subroot string, root string"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _down(tiers: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The ways of the leaves' superblocks, from those of the last tier's (tree, block 0)."""
    for tier in reversed(tiers[1:]):
        blocks = tier.select("tree", F.floor(F.col("at") / BLOCK).alias("block"), "at", "size", "node").groupBy("tree", "block")
        outer = stored(blocks.cogroup(outer.groupBy("tree", "block")).applyInPandas(_hand_down, _WAY), "merkle-ways")
    return outer


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, the roots above it, the digest of its proof, and whether the proof of its
    (tampered) form holds."""
    rows = stored(leaves(docs), "merkle-leaves")
    tiers = _tiers(stored(_placed(rows, ["doc_id", "node", "row"]), "merkle-tier"))
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), F.col("node"))
    tops = _tiers(stored(_placed(subroots, ["lang_tree"]), "merkle-tier"))
    root = tops[-1].select("tree", F.lit(0).cast("long").alias("block"), F.lit("").alias("way"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    # The ways of the languages' superblocks, then those of the languages, which are the outermost of the leaves.
    blocks = tops[0].select("tree", F.floor(F.col("at") / BLOCK).alias("block"), "at", "size", "node", "lang_tree").groupBy("tree", "block")

    def languages(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, ways = _ways(nodes, outer)
        rest = outer.iloc[0]
        return pd.DataFrame({"tree": nodes["lang_tree"], "block": 0, "way": [_packed(w) + rest["way"] for w in ways], "subroot": nodes["node"], "root": rest["root"]})

    langs = stored(blocks.cogroup(_down(tops, root).groupBy("tree", "block")).applyInPandas(languages, _WAY), "merkle-ways")
    own = tiers[0].select("tree", F.floor(F.col("at") / BLOCK).alias("block"), "at", "size", "node", "changed", "doc_id").groupBy("tree", "block")
    return own.cogroup(_down(tiers, langs).groupBy("tree", "block")).applyInPandas(_prove, _PROOF)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _tree_sql(leaf: str, name: str, depth: int) -> str:
    """SQL of a tree over leaf(tree, pos, node): the nodes of each level, the runs of siblings, and of each leaf its root
    and the siblings on its way. Each level is a table, so depth bounds the leaves (8 ** depth); nothing else does."""
    parts = [f"{name}0 AS (SELECT tree, pos, node FROM {leaf})"]
    for k in range(depth):
        size = f"(SELECT tree, count(*) AS size FROM {name}{k} GROUP BY tree)"
        parts.append(f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node FROM {name}{k} JOIN {size} s USING (tree) GROUP BY tree, pos // 8)")
        parts.append(f"{name}r{k} AS (SELECT tree, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM {name}{k} JOIN {size} s USING (tree) WHERE size > 1 GROUP BY ALL)")
    ways = ", ".join(f"CASE WHEN r{k}.nodes IS NULL THEN NULL ELSE [array_to_string(r{k}.nodes[:(l.pos // {8**k}) % 8], ''), array_to_string(r{k}.nodes[(l.pos // {8**k}) % 8 + 2:], '')] END" for k in range(depth))
    joins = " ".join(f"LEFT JOIN {name}r{k} r{k} ON r{k}.tree = l.tree AND r{k}.run = l.pos // {8 ** (k + 1)}" for k in range(depth))
    parts.append(f"{name}w AS (SELECT l.tree, l.pos, top.node AS root, list_filter([{ways}], lambda x: x IS NOT NULL) AS way FROM {name}0 l JOIN {name}{depth} top ON top.tree = l.tree {joins})")
    return ",\n".join(parts)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_BEFORE = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: CRC-32 of the decimal doc_id, bit by bit: the polynomial and the two complements are its definition.
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) AS BIGINT) ELSE CAST(0 AS BIGINT) END)), lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) // 2, 3988292384) ELSE xor(c, x) // 2 END))"
OP12_SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_BEFORE} || {_FIELD.format("text")}) AS node,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({_BEFORE} || {_FIELD.format(_LOWER)}) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM h),
{_tree_sql("l", "a", 7)},
s AS (SELECT '' AS tree, tree AS own, node, row_number() OVER (ORDER BY tree) - 1 AS pos FROM a7),
{_tree_sql("s", "b", 3)},
w AS (
  SELECT doc_id, l.node AS leaf, changed, aw.root AS subroot, bw.root, list_concat(aw.way, bw.way) AS way
  FROM l JOIN aw ON aw.tree = l.tree AND aw.pos = l.pos JOIN s ON s.own = l.tree JOIN bw ON bw.pos = s.pos),
p AS (
  SELECT *, sha256(array_to_string(list_transform(way, lambda x: x[1] || x[2]), '')) AS proof_sha256,
    list_reduce(list_prepend([coalesce(changed, leaf)], way), lambda x, y: [sha256(y[1] || x[1] || y[2])])[1] AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM p
"""
