"""Operator 5, n-gram Jaccard join with prefix trees.

The n-grams of all documents have one global order, that of their 64-bit
hashes, and a document is the ordered set of its n-grams. The order is cut into
parts; two sets as similar as asked differ in fewer n-grams than there are
parts, so they agree in a whole part. Documents that share a part are
candidates: a bucket gives star edges to its least id (already where the rows
are, so a hot part sends one row per batch), and the candidate graph's
components bring possible links together without pairs. Of the documents of a
component that have equal sets only the first is compared; the others follow it.

Within a component the sets are stored in a path-compressed trie. The sets go
down it together, partial overlaps being shared by all sets below a node; a set
leaves a subtree when the remaining lengths cannot make up the overlap that it
lacks, or when its size fits nothing there. Only links that connect something
are listed. In a trie, n-grams of one set alone come after the others, each
group in the global order. Large components are split into
blocks: blocks are joined on their own, their clusters' first sets are joined
with each other, and the few sets that are still outside the main cluster probe
every block. No link between different texts is lost, and none is listed twice.

N-grams that very many documents share (passages, common lines) would make
unlike documents candidates. The part keys leave out the most frequent ones, at
most `FREQUENT_MOST` of those counted `FREQUENT` times or more. That is safe
for any choice of them: without some n-grams two sets differ in no more of them
than before. Similarity itself is always taken on whole sets.

Empty parts: with e empty parts in a set, agreement may be empty too. Parts
exceed the greatest possible difference by a slack; sets with more empty parts
than the slack also meet by their prefix n-grams, which no pair can evade.

Defined results: a text without words has an empty set and stands alone; a null
doc_id keeps its row with a null component; rows that repeat a doc_id are one
document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, most_frequent, partitions_for, slices, stored, table, tasks_for, unused
from quarry.llm.components import components
from quarry.llm.hashing import mix, shingles, word_hashes

WORDS, PERCENT = 4, 85
#: N-grams (and a constant per set) that one block of a large component may hold.
BLOCK_WEIGHT, SET_WEIGHT = 1_000_000, 400
#: Clusters of a large component that are compared before single sets are.
FIRST_SETS = 500
#: N-grams counted this often are left out of part keys; the bound of their broadcast.
FREQUENT, FREQUENT_MOST = 24, 200_000


def ngram_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    return shingles(word_hashes((text or b"").lower()), words)


class Parts:
    """Size classes and the number of parts of each, for a similarity of percent/100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(self.lows[-1] * 100 // percent + 1)
        self.edges = np.array(self.lows)

    def scheme(self, j: int) -> tuple[int, int]:
        """(parts, slack) for sets of the classes j - 1 and j."""
        most = self.lows[j + 1] - 1
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        slack = 2 + differ // 4
        return differ + 1 + slack, slack

    def keys(self, whole: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Bucket keys of one set: both schemes' parts, and prefix n-grams where parts are too often empty."""
        n = len(whole)
        if not n:
            return whole
        grams = whole
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, whole), len(frequent) - 1)
            grams = whole[frequent[at] != whole]
        k = int(np.searchsorted(self.edges, n, side="right")) - 1
        out = []
        for j in (k, k + 1):
            parts, slack = self.scheme(j)
            own = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
            sums = np.add.reduceat(mix(grams + np.uint64(0x51ED270B)), firsts) if len(own) else np.empty(0, np.uint64)
            out.append(mix(sums + own[firsts] * np.uint64(0xA24BAED4963EE407) + np.uint64((j + 1) * 0x9FB21C651E98DF25 % (1 << 64))))
            if parts - len(firsts) > slack:
                prefix = n - -(-n * self.percent // 100) + 1
                out.append(mix(whole[:prefix] + np.uint64((j + 1) * 0xD1B54A32D192ED03 % (1 << 64))))
        return np.unique(np.concatenate(out))


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept: first id of each key, edge ends a, edge ends b) of bucket rows."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    heads = ids[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))] if len(keys) else ids
    other = heads != ids
    edges = np.unique(np.stack([heads[other], ids[other]], axis=1), axis=0) if other.any() else np.empty((0, 2), np.int64)
    return order[first], edges[:, 0], edges[:, 1]


def forest(edges: np.ndarray) -> np.ndarray:
    """Star edges (least id, id) with the same components as some edges: no more than there are ids."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in edges.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([(r, x) for x in parent if (r := find(x)) != x], np.int64).reshape(-1, 2)


#: Kinds of rows that leave the first pass: bucket row (key, id), edge (a, b), document (digest of its set, id, size of its
#: set).
BUCKET, EDGE, DOCUMENT = 0, 1, 2
_FLOW = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
_FLOW_DDL = "key long, kind tinyint, a long, b long"


def _flow(key: np.ndarray, kind: int, a, b) -> pa.RecordBatch:  # noqa: ANN001
    kinds = pa.array(np.full(len(key), kind, np.int8))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), kinds, a if isinstance(a, pa.Array) else pa.array(a), pa.array(b)], schema=_FLOW)


def frequent_grams(docs: DataFrame, words: int) -> np.ndarray:
    """The most frequent n-grams, sorted. Where the texts are, only those that repeat are counted further."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1])], schema=schema)

        size = 0
        for batch in slices(batches, "text", 8 << 20):
            own = [ngram_set(t, words) for t in as_bytes(batch.column("text"))]
            held += own
            size += sum(map(len, own))
            if size > 4_000_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long")
    top = most_frequent(rows.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "n", FREQUENT_MOST).select("gram").toArrow()
    return np.sort(top.column("gram").to_numpy().view(np.uint64))


def candidate_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """First pass over the texts."""
    common = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, frequent = Parts(percent), common.value
        for batch in slices(batches, "text", 8 << 20):
            ids = batch.column("doc_id")
            sets = [ngram_set(t, words) for t in as_bytes(batch.column("text"))]
            sizes = np.array([len(s) for s in sets], np.int64)
            numbers = np.asarray(ids.fill_null(0))
            digests = np.array([int(mix(s).sum()) for s in sets], np.uint64)
            yield _flow(digests, DOCUMENT, ids, sizes)
            known = np.asarray(ids.is_valid())
            # Equal sets at hand: one stands for all.
            seen: dict[tuple[int, int], int] = {}
            keys, owners, same = [], [], []
            for at in np.flatnonzero(known & (sizes > 0)):
                s = sets[at]
                head = seen.setdefault((len(s), int(digests[at])), int(numbers[at]))
                if head != numbers[at]:
                    same.append((head, int(numbers[at])))
                    continue
                own = parts.keys(s, frequent)
                keys.append(own)
                owners.append(np.full(len(own), numbers[at]))
            edges = [np.array(same, np.int64).reshape(-1, 2)]
            if keys:
                key, own = np.concatenate(keys), np.concatenate(owners)
                kept, a, b = stars(key, own)
                yield _flow(key[kept], BUCKET, own[kept], np.zeros(len(kept), np.int64))
                edges.append(np.stack([a, b], axis=1))
            edge = forest(np.concatenate(edges))
            if len(edge):
                yield _flow(mix(edge[:, 0].astype(np.uint64) * np.uint64(31) + edge[:, 1].astype(np.uint64)), EDGE, edge[:, 0], edge[:, 1])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FLOW_DDL)


def candidate_edges(rows: DataFrame, n: int) -> DataFrame:
    """Star edges of all buckets, and the document rows; a task holds one slice of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, edges = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
        for batch in batches:
            kind = np.asarray(batch.column("kind"))
            if (kind == DOCUMENT).any():
                yield batch.filter(pa.array(kind == DOCUMENT))
            a, b = (np.asarray(batch.column(c).fill_null(0)) for c in ("a", "b"))
            keys.append(np.asarray(batch.column("key"))[kind == BUCKET])
            ids.append(a[kind == BUCKET])
            if (kind == EDGE).any():
                edges.append(np.unique(np.stack([a, b], axis=1)[kind == EDGE], axis=0))
        _, a, b = stars(np.concatenate(keys), np.concatenate(ids))
        edges.append(np.stack([a, b], axis=1))
        edge = forest(np.concatenate(edges))
        if len(edge):
            yield _flow(np.zeros(len(edge), np.int64), EDGE, np.ascontiguousarray(edge[:, 0]), np.ascontiguousarray(edge[:, 1]))

    # Documents go by id: many have one digest.
    return rows.repartition(n, F.when(F.col("kind") == DOCUMENT, F.col("a")).otherwise(F.col("key"))).mapInArrow(run, _FLOW_DDL)


class _Node:
    __slots__ = ("tokens", "children", "own", "least", "most")

    def __init__(self, tokens: np.ndarray, size: int):
        self.tokens, self.children, self.own = tokens, {}, []
        self.least, self.most = size, size


class Trie:
    """Ordered sets with shared prefixes, path-compressed."""

    def __init__(self) -> None:
        self.root = _Node(np.empty(0, np.int64), 1 << 60)
        self.root.most = 0

    def insert(self, tokens: np.ndarray, member: int) -> None:
        node, at, n = self.root, 0, len(tokens)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.own.append(member)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                leaf = _Node(tokens[at:], n)
                leaf.own.append(member)
                node.children[int(tokens[at])] = leaf
                return
            m = min(len(child.tokens), n - at)
            differ = np.flatnonzero(child.tokens[:m] != tokens[at : at + m])
            common = int(differ[0]) if len(differ) else m
            if common < len(child.tokens):  # split the edge
                upper = _Node(child.tokens[:common], child.least)
                upper.most = child.most
                upper.children[int(child.tokens[common])] = child
                child.tokens = child.tokens[common:]
                node.children[int(upper.tokens[0])] = upper
                child = upper
            node, at = child, at + common

    def join(self, held: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member, rows) of the similar ones. All rows go down the trie together: the overlaps so far are one
        vector per node, shared by all sets below. A row leaves a subtree when the tokens that remain there
        cannot make up what it lacks, or when its size fits none of the sets below.

        held: 0/1 rows over columns, the last column (of tokens that no row shares) being 0."""
        low, high = -(-sizes * percent // 100), sizes * 100 // percent
        stack = [(self.root, np.arange(len(sizes)), np.zeros(len(sizes), np.int64), 0)]
        while stack:
            node, rows, overlap, depth = stack.pop()
            for at in range(0, max(1, len(node.tokens)), STEP):
                part = node.tokens[at : at + STEP]
                if len(part):
                    overlap = overlap + held[rows[:, None], part].sum(axis=1)
                    depth += len(part)
                reach = np.minimum(high[rows], node.most)
                stays = (reach >= np.maximum(low[rows], node.least)) & ((100 + percent) * (overlap + reach - depth) >= percent * (sizes[rows] + reach))
                if not stays.all():
                    rows, overlap = rows[stays], overlap[stays]
                if not len(rows):
                    break
            if not len(rows):
                continue
            if node.own:
                hit = (low[rows] <= depth) & (depth <= high[rows]) & ((100 + percent) * overlap >= percent * (sizes[rows] + depth))
                if hit.any():
                    for member in node.own:
                        yield member, rows[hit]
            stack += [(c, rows, overlap, depth) for c in node.children.values()]


#: Tokens of an edge that are compared at once, and bytes of the rows that go down the trie together.
STEP, HELD_BYTES = 16, 32 << 20


def link_sets(members: list[tuple[int, np.ndarray, int]], percent: int, probes: list[tuple[int, np.ndarray, int]] | None = None) -> list[tuple[int, int]]:
    """Links (id, id) that connect similar sets. Each member is (id, set, label so far); equal labels are connected.
    With probes, links are sought between probes and members only. Only links that connect something are listed."""
    indexed = sorted((m for m in members if len(m[1])), key=lambda m: (len(m[1]), m[0]))
    asked = [m for m in probes if len(m[1])] if probes is not None else indexed
    if not indexed or not asked:
        return []
    sets = [m[1] for m in (indexed if probes is None else [*indexed, *asked])]
    grams, place, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(many > 1, np.cumsum(many > 1) - 1, -1)[place]
    width = int((many > 1).sum())
    cuts = np.cumsum([0, *map(len, sets)])
    # Places keep the global order; tokens of one set alone have no column and only count as missing.
    rank = np.where(column < 0, width + place, column)
    trie = Trie()
    for at in range(len(indexed)):
        own = np.sort(rank[cuts[at] : cuts[at + 1]])
        trie.insert(own, at)
    _clip(trie.root, width)
    ids = [m[0] for m in indexed] + ([] if probes is None else [m[0] for m in asked])
    known: dict[int, int] = {}
    labels = np.array([known.setdefault(m[2], k) for k, m in enumerate(indexed if probes is None else [*indexed, *asked])])
    first = 0 if probes is None else len(indexed)
    links = []
    step = max(16, HELD_BYTES // (width + 1))
    for begin in range(first, len(sets), step):
        end = min(len(sets), begin + step)
        held = np.zeros((end - begin, width + 1), np.uint8)
        for at in range(begin, end):
            own = column[cuts[at] : cuts[at + 1]]
            held[at - begin, own[own >= 0]] = 1
        for member, rows in trie.join(held, np.array([len(x) for x in sets[begin:end]], np.int64), percent):
            found = rows + begin
            fresh = found[labels[found] != labels[member]]
            while len(fresh):
                links.append((ids[member], ids[fresh[0]]))
                labels[labels == labels[fresh[0]]] = labels[member]
                fresh = fresh[labels[fresh] != labels[member]]
    return links


def _clip(node: _Node, width: int) -> None:
    """Tokens without a column share the last, empty one."""
    stack = [node]
    while stack:
        node = stack.pop()
        node.tokens = np.minimum(node.tokens, width)
        stack += node.children.values()


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([np.asarray(batch.column(k)) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(columns[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_CLUSTERS = pa.schema([("component", pa.int64()), ("blocks", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("label", pa.int64()), ("grams", pa.binary())])
_CLUSTERS_DDL = "component long, blocks int, block int, doc_id long, label long, grams binary"


def _sets_of(group: pa.Table) -> list[tuple[int, np.ndarray, int]]:
    return [(i, np.frombuffer(g, np.uint64), label) for i, g, label in zip(*(group.column(c).to_pylist() for c in ("doc_id", "grams", "label")), strict=True)]


def _clusters_within(sets: DataFrame, keys: tuple[str, ...], n: int, percent: int) -> DataFrame:
    """The sets with the least label of their cluster within their group. Groups share no documents, so what a task
    finds is final; the sets of components of one block, which are settled, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            rows = _sets_of(group)
            own = {i: label for i, _, label in rows}
            star = forest(np.array([(own[a], own[b]) for a, b in link_sets(rows, percent)], np.int64).reshape(-1, 2))
            roots = dict(zip(star[:, 1].tolist(), star[:, 0].tolist(), strict=True))
            labels = pa.array([roots.get(label, label) for _, _, label in rows], pa.int64())
            kept = [group.column(c) for c in ("component", "blocks", "block", "doc_id")]
            grams = group.column("grams") if group.column("blocks")[0].as_py() > 1 else pa.array([None] * len(rows), pa.binary())
            yield from pa.Table.from_arrays([*kept, labels, grams], schema=_CLUSTERS).to_batches()

    return sets.select(*_CLUSTERS.names).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, _CLUSTERS_DDL)


def _links_across(sets: DataFrame, keys: tuple[str, ...], n: int, percent: int) -> DataFrame:
    """Links (a, b) between the labels of probes and of other sets in each group of sets(keys..., doc_id, grams, label, probe)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            asked = group.column("probe")
            members, probes = _sets_of(group.filter(pc.invert(asked))), _sets_of(group.filter(asked))
            own = {i: label for i, _, label in [*members, *probes]}
            found = link_sets(members, percent, probes)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([own[x[k]] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return sets.select(*keys, "doc_id", "grams", "label", "probe").repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    spark = docs.sparkSession
    n = partitions_for(spark, 8)
    # A pair shares many parts and comes up in most slices of the keys, so fewer, larger slices repeat fewer edges.
    flow = stored(candidate_edges(candidate_rows(docs, words, percent), max(1, n // 2)), "ngram-flow")
    nodes = stored(components(flow.where(F.col("kind") == EDGE).select("a", "b")), "ngram-candidates")
    of_id = flow.where((F.col("kind") == DOCUMENT) & F.col("a").isNotNull()).groupBy(F.col("a").alias("id")).agg(
        F.max("b").alias("size"), F.when((F.min("key") == F.max("key")) & (F.min("b") == F.max("b")), F.min("key")).alias("digest")
    )
    # Of documents with one set the first is compared; an id with several sets stands for itself.
    known = stored(nodes.join(of_id, "id"), "ngram-known")
    firsts = known.where("digest IS NOT NULL").groupBy("component", "size", "digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.where("n > 1").drop("n"), "ngram-equal")  # a join with a stored table can split a set of very many copies
    known = known.join(firsts, ["component", "size", "digest"], "left").withColumn("first", F.coalesce("first", "id"))
    known = stored(known.select("id", "component", "size", "first"), "ngram-firsts")
    compared, copies = known.where(F.col("id") == F.col("first")), known.where(F.col("id") != F.col("first")).select("id", "first")
    weights = compared.groupBy("component").agg(F.ceil(F.sum(F.col("size") + SET_WEIGHT) / BLOCK_WEIGHT).cast("int").alias("blocks"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    members = stored(
        compared.join(weights, "component").select(F.col("id").alias("m_id"), "component", "blocks", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int").alias("block")), "ngram-members"
    )

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            grams = [ngram_set(t, words).tobytes() for t in as_bytes(batch.column("text"))]
            known = [batch.column(c) for c in ("component", "blocks", "block", "doc_id")]
            yield pa.RecordBatch.from_arrays([*known, known[3], pa.array(grams, pa.binary())], schema=_CLUSTERS)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(members.hint("shuffle_hash"), F.col("doc_id") == F.col("m_id")).select("component", "blocks", "block", "doc_id", "text")
    clusters = stored(_clusters_within(found.mapInArrow(to_sets, _CLUSTERS_DDL), ("component", "block"), n, percent), "ngram-clusters")
    labels = clusters.where("label <> doc_id").select(F.col("doc_id").alias("l_id"), "label").distinct()
    labels = labels.union(copies.join(labels, F.col("first") == F.col("l_id"), "left").select("id", F.coalesce("label", "first")))
    rows = flow.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    rows = rows.join(labels, F.col("doc_id") == F.col("l_id"), "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("label"))
    large = clusters.where("blocks > 1")
    if large.isEmpty():
        return rows.withColumnRenamed("label", "component_id")
    joined = components(_links_between_blocks(large, n, percent))
    return rows.join(joined, F.col("label") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "label").alias("component_id"))


def _links_between_blocks(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between labels of clusters in different blocks of large components."""
    size = F.length("grams") / 8 + SET_WEIGHT
    # The first sets of the largest clusters, which stand for them, are compared with each other.
    clusters = sets.groupBy("component", "label").agg(F.count("*").alias("held"), F.max(F.when(F.col("doc_id") == F.col("label"), size)).alias("size")).where("held > 1")
    by_held = Window.partitionBy("component").orderBy(F.desc("held"), "label")
    firsts = clusters.withColumn("place", F.row_number().over(by_held)).where(F.col("place") <= FIRST_SETS)
    firsts = firsts.withColumn("weight", F.sum("size").over(by_held)).where(F.col("weight") <= 4 * BLOCK_WEIGHT).select("component", F.col("label").alias("doc_id"))
    heads = _clusters_within(sets.join(firsts, ["component", "doc_id"], "left_semi"), ("component",), n, percent)
    merged = stored(heads.where("label <> doc_id").select(F.col("doc_id").alias("head"), F.col("label").alias("to")).distinct().coalesce(tasks_for(0)), "ngram-heads")

    labelled = sets.join(merged, F.col("label") == F.col("head"), "left").withColumn("label", F.coalesce("to", "label")).drop("head", "to")
    # Whatever is outside the main cluster still probes every block.
    counts = labelled.groupBy("component", "label").agg(F.count("*").alias("count"), F.sum(size).alias("weight"))
    largest = F.struct("count", "label")
    main = counts.groupBy("component").agg(F.max_by("label", largest).alias("main"), F.ceil((F.sum("weight") - F.max_by("weight", largest)) / BLOCK_WEIGHT).cast("int").alias("chunks"))
    main = stored(main.where("chunks > 0").coalesce(tasks_for(0)), "ngram-main")
    known = labelled.join(main, "component")
    probes = known.where("label <> main").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.col("chunks")).cast("int"))
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
    indexed = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("probe", F.lit(False))
    columns = ["component", "block", "chunk", "doc_id", "grams", "label", "probe"]
    across = _links_across(indexed.select(columns).union(probes.select(columns)), ("component", "block", "chunk"), n, percent)
    return stored(across.union(merged.toDF("a", "b")), "ngram-links")


def keep_first(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """One document of each group of similar ones, the one of the least doc_id, with all columns."""
    name = unused(docs, "dropped_id")
    dropped = similar_documents(docs, **options).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped[name], "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
