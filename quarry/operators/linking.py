"""Fuzzy joins as equi-joins: prefixes, containment, token overlap, longest key."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.functions.names import tokens
from quarry.operators.durable import saved
from quarry.operators.relational import top_k, unique_by


def prefixes(path: Column, sep: str) -> Column:
    """All prefixes of a path that end at a separator, and the path itself."""
    parts = F.split(path, sep.replace(".", r"\.") if sep == "." else sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))


def prefix_join(left: DataFrame, right: DataFrame, path: str, root: str, sep: str, order: list, left_key: list[str]) -> DataFrame:
    """Each left row with the first root (by order) that is a whole-part prefix of its path."""
    cut = left.withColumn("__prefix", F.explode(prefixes(F.col(path), sep)))
    return unique_by(cut.join(right, F.col("__prefix") == F.col(root)).drop("__prefix"), left_key, order)


def _grams(x: Column, n: Column | int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substr(x, i, F.lit(n) if isinstance(n, int) else n)))


#: Most n-grams of names that are sent to all tasks. Above, names and texts meet by exchange: Spark guesses the size of what
#: it sends from files, and those of names and texts that repeat are far smaller than their rows.
SENT_GRAMS = 100_000
#: Most names of a group (rows that agree in `within`) that are compared with each text of the group, without n-grams.
FEW_NAMES = 32
#: Rows with one text that one task joins to names that meet by exchange; more copies are dealt out.
COPIES = 10_000


class _Names:
    """The rows with a name, written once for several readings, the n-gram lengths that they need, and whether they are few."""

    def __init__(self, df: DataFrame, name: str, gram: int):
        seen, size = Observation(), F.least(F.length(name), F.lit(gram))
        counts = [F.count_if(size == k).alias(f"k{k}") for k in range(1, gram + 1)]
        self.rows = saved(df.where(F.length(name) > 0).observe(seen, *counts, F.coalesce(F.sum(F.length(name) - size + 1), F.lit(0)).alias("grams")), "names")
        self.sizes = [k for k in range(1, gram + 1) if seen.get[f"k{k}"]]
        self.few = seen.get["grams"] <= SENT_GRAMS
        self.handful = self.few and sum(seen.get[f"k{k}"] for k in self.sizes) <= FEW_NAMES

    def met(self, df: DataFrame) -> DataFrame:
        """df, made of the names, as the right side of a join with what is made of texts."""
        return F.broadcast(df) if self.few else df.hint("merge")


def _contained(texts: DataFrame, names: _Names, text: str, name: str, gram: int, within: list[str]) -> DataFrame:
    """Groups of few names by their group, the others by n-grams."""
    named = names.rows if set(names.rows.columns) != {*within, name} else names.rows.distinct()
    if not within and names.handful:
        low = F.lower(F.col(text)).alias("__low")
        found = texts.select("*", low).join(F.broadcast(named), F.contains("__low", F.lower(F.col(name)))).drop("__low")
        return found if named.columns == [name] else found.select(name, *texts.columns, *(c for c in named.columns if c != name))
    if not within:
        return _by_grams(texts, names, names.rows, text, name, gram, within)
    crowded = saved(names.rows.groupBy(*within).count().where(F.col("count") > FEW_NAMES).select(*within), "crowded")
    holds = F.contains(F.lower(F.col(text)), F.lower(F.col(name)))
    if crowded.isEmpty():
        return texts.join(names.met(named), within).where(holds)
    crowded = names.met(crowded)
    few = texts.join(names.met(named.join(crowded, within, "left_anti")), within).where(holds)
    return few.unionByName(_by_grams(texts.join(crowded, within, "left_semi"), names, names.rows.join(crowded, within, "left_semi"), text, name, gram, within))


def _by_grams(texts: DataFrame, names: _Names, named: DataFrame, text: str, name: str, gram: int, within: list[str]) -> DataFrame:
    low, size = F.lower(F.col(name)), F.least(F.length(name), F.lit(gram))
    grams = [F.when(F.length(text) >= k, _grams(F.lower(F.col(text)), k)).otherwise(F.array().cast("array<string>")) for k in names.sizes or [1]]
    gram_of = F.explode(F.flatten(F.array(*grams))).alias("__gram")
    own = named.select(*within, name, F.explode(_grams(low, size)).alias("__gram"))
    met, holds = [*within, "__gram"], F.contains(F.lower(F.col(text)), low)
    digest, once = F.md5(F.lower(F.col(text))).alias("__text"), texts if names.few else texts.select(*within, text).distinct()
    counts = once.select(*within, gram_of)
    if names.few:
        counts = counts.join(F.broadcast(own.select(*met)), met, "left_semi")
    counts = counts.groupBy(*met).agg(F.count("*").alias("__n"))
    # A name with an n-gram that no text holds is in none.
    rarest = own.join(counts.hint("merge"), met, "left").groupBy(*within, name).agg(F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram"), F.count_if(F.col("__n").isNull()).alias("__none"))
    rarest = rarest.where("__none = 0").drop("__none")
    if names.few:
        found = texts.select("*", gram_of).join(F.broadcast(rarest), met).where(holds).drop("__gram")
    else:
        near = once.select(*within, digest, gram_of).join(rarest.hint("merge"), met).select(*within, "__text", name).distinct()
        found = _joined(texts.select("*", digest), near, [*within, "__text"]).where(holds).drop("__text")
    return found if set(named.columns) == {*within, name} else found.join(names.met(named), [*within, name])


def _joined(rows: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and near by keys, where rows may have any number of copies of a key: those of which there are more than COPIES
    are dealt out over parts, each of which near reaches. Keys of so many rows are at most rows / COPIES; they are sent."""
    crowds = saved(rows.groupBy(*keys).count().where(F.col("count") > COPIES).select(*keys, F.ceil(F.col("count") / COPIES).alias("__parts")), "copies")
    if crowds.isEmpty():
        return rows.join(near.hint("merge"), keys)
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    place = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), parts)
    left = rows.join(F.broadcast(crowds), keys, "left").withColumn("__part", place).drop("__parts")
    right = near.join(F.broadcast(crowds), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return left.join(right.hint("merge"), [*keys, "__part"]).drop("__part")


def contains_pairs(texts: DataFrame, names: DataFrame, text: str, name: str, gram: int = 4, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs in which the text contains the name, compared in lower case. A name meets the texts that hold its rarest
    n-gram; names shorter than that meet texts by an n-gram of their own length. Each pair comes once. With columns
    `within`, which both sides have, only rows that agree in them meet.

    Few names (SENT_GRAMS) are sent to the texts, which are cut into n-grams and compared where they lie: no text is
    exchanged. Else distinct texts are cut into (digest, n-gram) rows, so what is exchanged grows with their length; texts
    are joined to the candidate names by digest, copies of one text in parts, and compared there. Only n-gram lengths that
    names have (at most `gram`) are cut. At most FEW_NAMES names, in all or of a group, need no n-grams."""
    return _contained(texts, _Names(names, name, gram), text, name, gram, list(within))


def contains_either(left: DataFrame, right: DataFrame, a: str, b: str, gram: int = 4, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs in which either value contains the other; equal values once."""
    l, r = _Names(left, a, gram), _Names(right, b, gram)
    back = _contained(r.rows, l, b, a, gram, list(within)).where(F.lower(F.col(a)) != F.lower(F.col(b)))
    return _contained(l.rows, r, a, b, gram, list(within)).unionByName(back)


def align(doc_names: DataFrame, code_names: DataFrame, doc: str, code: str) -> DataFrame:
    """matched / doc_only / code_only names by containment in either direction."""
    pairs = saved(contains_either(doc_names, code_names, doc, code).select(doc, code), "aligned")
    matched = pairs.select(F.col(doc).alias("name")).distinct()
    doc_only = doc_names.join(pairs.select(doc).distinct(), doc, "left_anti").select(F.col(doc).alias("name"))
    code_only = code_names.join(pairs.select(code).distinct(), code, "left_anti").select(F.col(code).alias("name"))
    label = lambda df, what: df.distinct().select(F.lit(what).alias("status"), "name")
    return label(matched, "matched").union(label(doc_only, "doc_only")).union(label(code_only, "code_only"))


def token_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str) -> DataFrame:
    """(left key, right key, common tokens) of pairs that share a token, by an inverted index. A token that most rows
    have gives all their pairs; best_matches has no such token."""
    l_tokens = left.select(left_key, F.explode(tokens(left_text)).alias("token"))
    r_tokens = right.select(right_key, F.explode(tokens(right_text)).alias("token"))
    return l_tokens.join(r_tokens, "token").groupBy(left_key, right_key).agg(F.count("*").alias("overlap"))


#: Fixed value: how names of components end.
COMPONENT_NAME = "(service|controller|repository|handler|manager)$"


def align_components(doc_names: DataFrame, code_names: DataFrame, doc: str, code: str) -> DataFrame:
    """(status, name) in lower case: documented names that code has (matched) or lacks (doc_only), and components of the
    code that no document has (code_only). A code name counts as a whole where it holds a documented name, and up to its
    first dot where a documented name holds it."""
    docs = saved(doc_names.select(F.lower(doc).alias("doc_name")).where("doc_name <> ''").distinct(), "align-docs")
    codes = saved(code_names.select(F.lower(code).alias("code_name")).where("code_name <> ''").distinct().withColumn("stem", F.regexp_replace("code_name", r"\..+$", "")), "align-codes")
    whole = contains_pairs(codes.select("code_name"), docs, "code_name", "doc_name").select("doc_name", "code_name")
    stems = contains_pairs(docs, codes.select("stem").where("stem <> ''").distinct(), "doc_name", "stem").join(codes, "stem").select("doc_name", "code_name")
    pairs = saved(whole.union(stems).distinct(), "aligned")
    label = lambda df, what, c: df.select(F.lit(what).alias("status"), F.col(c).alias("name")).distinct()
    lone = codes.join(pairs.select("code_name"), "code_name", "left_anti").where(F.col("code_name").rlike(COMPONENT_NAME))
    return label(pairs, "matched", "doc_name").union(label(docs.join(pairs.select("doc_name"), "doc_name", "left_anti"), "doc_only", "doc_name")).union(label(lone, "code_only", "code_name"))


#: Left rows and their features that one pass over the right rows takes, and scores that a task holds at once.
PASS_ROWS, PASS_FEATURES, CELLS = 512, 1 << 17, 1 << 22


def best_matches(left: DataFrame, right: DataFrame, k: int, block: int = PASS_ROWS) -> DataFrame:
    """best_rows of right rows given by feature: right(right_id, ord, feature, weight)."""
    lists = right.where("feature IS NOT NULL").groupBy("right_id", "ord").agg(F.collect_set(F.struct("feature", "weight")).alias("features"))
    return best_rows(left, lists, k, block)


def best_rows(left: DataFrame, right: DataFrame, k: int, block: int = PASS_ROWS) -> DataFrame:
    """(left_id, right_id, ord, score): the k best rows of right for each of left by the summed weights of the features that
    they share; ties by ord, then by right_id. left(left_id, feature), right(right_id, ord, features), a list of distinct
    (feature, weight); weight belongs to the feature.

    Each pass takes a block of left rows, which the driver sends to all tasks, and scores every right row where it lies:
    only the k best of a batch for each left row travel, and no right row or pair does, however frequent a feature is. There
    are left rows / `block` passes, as any right row may be a best one."""
    own = saved(left.where("feature IS NOT NULL").distinct(), "match-left")
    lefts = saved(own.select("left_id").distinct().withColumn("left", F.monotonically_increasing_id()), "match-ids")
    seen = own.agg(F.count_distinct("left_id").alias("rows"), F.count("*").alias("features")).first()
    n = max(1, -(-seen["rows"] // block), -(-seen["features"] // PASS_FEATURES))
    numbered = own.join(lefts, "left_id").select("left", "feature", F.pmod(F.xxhash64("left"), F.lit(n)).alias("pass"))
    if n > 1:
        numbered, right = saved(numbered, "match-passes"), saved(right, "match-right")
    found = [_scored(numbered.where(F.col("pass") == i), right, k) for i in range(n)]
    return top_k(reduce(DataFrame.union, found), ["left"], [F.desc("score"), "ord", "right_id"], k).join(lefts, "left").select("left_id", "right_id", "ord", "score")


def _scored(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(left, right_id, ord, score): the k best of each batch of right rows for each of left(left, feature)."""
    rows = sorted((r["feature"], r["left"]) for r in left.select("left", "feature").collect())
    ids, place = np.unique(np.array([at for _, at in rows], np.int64), return_inverse=True)
    held = Counter(f for f, _ in rows)
    sent = right.sparkSession.sparkContext.broadcast((pa.array(list(held), pa.string()), np.cumsum([0, *held.values()]), place, ids))
    schema = StructType([StructField("left", LongType()), *(right.schema[c] for c in ("right_id", "ord")), StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts, place, ids = sent.value
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            keys = batch.select(["right_id", "ord"])
            batch = batch.take(pc.sort_indices(keys, sort_keys=[("ord", "ascending"), ("right_id", "ascending")], null_placement="at_start"))
            row, own = pc.list_parent_indices(batch.column("features")).to_numpy(), batch.column("features").flatten()
            code = pc.fill_null(pc.index_in(own.field("feature"), value_set=known), -1).to_numpy()
            row, code, weight = (x[code >= 0] for x in (row, code, own.field("weight").to_numpy(zero_copy_only=False)))
            for first in range(0, batch.num_rows if len(code) else 0, step):
                m = min(step, batch.num_rows - first)
                a, b = np.searchsorted(row, (first, first + m))
                scores = _sums(row[a:b] - first, code[a:b], weight[a:b], starts, place, len(ids), m)
                best = np.argpartition(scores * m + np.arange(m)[::-1], max(0, m - k), axis=1)[:, max(0, m - k) :]
                at, own_best = np.nonzero(np.take_along_axis(scores, best, 1) > 0)
                picked = best[at, own_best]
                out = batch.select(["right_id", "ord"]).take(pa.array(picked + first))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), *out.columns, pa.array(scores[at, picked])], names=schema.names)

    out = saved(right.select("right_id", "ord", "features").mapInArrow(run, schema), "match-best")
    sent.destroy()
    return out


def _sums(row: np.ndarray, code: np.ndarray, weight: np.ndarray, starts: np.ndarray, place: np.ndarray, n: int, m: int, most: int = 1 << 21) -> np.ndarray:
    """Summed weights by left row (n) and right row (m) of features that right rows have; feature f is held by the left rows
    place[starts[f]:starts[f + 1]]. About `most` links are added at a time."""
    out, held = np.zeros(n * m, np.int64), starts[code + 1] - starts[code]
    ends = np.cumsum(held)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, most)), len(code)))
    for a, b in itertools.pairwise(cuts):
        before = ends[a:b] - held[a:b]
        links = np.arange(before[0], ends[b - 1]) + np.repeat(starts[code[a:b]] - before, held[a:b])
        cells = place[links] * m + np.repeat(row[a:b], held[a:b])
        out += np.bincount(cells, np.repeat(weight[a:b], held[a:b]), n * m).astype(np.int64)
    return out.reshape(n, m)


#: Weights of what speaks for an operation: common tokens with the service and the operation, the service's
#: stem among the tokens, the operation's name in the trigger, the stem in the target, a call of the service.
MATCH_WEIGHTS = {"service": 2, "operation": 3, "stem": 4, "trigger": 5, "target": 3, "call": 8}


def match_services(entries: DataFrame, operations: DataFrame, calls: DataFrame, impls: DataFrame, k: int = 2, block: int = PASS_ROWS) -> DataFrame:
    """(entry_id, service, operation, ord, score): the k best operations of each entry.

    entries(entry_id, name, trigger, target, notes), operations(service, service_purpose, operation, purpose, input, ord)
    with ord unique, calls(caller, callee) of types, impls(service, impl). All that speaks for an operation is a feature
    that both sides have, so that names and callees, like tokens, may be shared by any number of rows. Empty names and
    stems speak for nothing."""
    text = lambda *cs: F.concat_ws(" ", *cs)
    has = lambda kind, x: F.concat(F.lit(kind + ":"), x)
    stem = F.regexp_replace(F.coalesce("service", F.lit("")), "Service$", "")
    named = operations.withColumn("low", F.lower(stem))
    ops = saved(operations.select("ord", "service", "operation", stem.alias("stem"), F.lower(stem).alias("low")), "match-operations")
    words = {
        "service": tokens(text("service", "service_purpose")), "operation": tokens(text("operation", "purpose", "input")), "stem": F.array("low"),
        "trigger": F.array(F.nullif(F.lower("operation"), F.lit(""))), "target": F.array(F.nullif("low", F.lit(""))), "call": F.array("service"),
    }
    weighed = lambda kind, found: F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.struct(has(kind, x).alias("feature"), F.lit(MATCH_WEIGHTS[kind]).cast("long").alias("weight")))
    features = F.concat(*(weighed(kind, found) for kind, found in words.items()))
    right = named.select(F.col("ord").alias("right_id"), "ord", features.alias("features"))

    said = entries.select("entry_id", F.explode(tokens(text("name", "trigger", "target", "notes"))).alias("t")).select("entry_id", F.explode(F.array(*(has(kind, F.col("t")) for kind in ("service", "operation", "stem")))).alias("feature"))
    triggers = contains_pairs(entries.select("entry_id", F.lower("trigger").alias("said")), ops.select(F.lower("operation").alias("low")).where("low <> ''").distinct(), "said", "low")
    targets = contains_pairs(entries.select("entry_id", F.lower("target").alias("said")), ops.select("low").where("low <> ''").distinct(), "said", "low")
    services, callees = ops.select("service", "stem").where("service IS NOT NULL").distinct(), calls.select("callee").where("callee <> ''").distinct()
    holds_callee = contains_pairs(services.select("service"), callees, "service", "callee").where(F.contains("service", F.col("callee"))).select("service", "callee")
    holds_stem = contains_pairs(callees, services.where("stem <> ''"), "callee", "stem").where(F.contains("callee", F.col("stem"))).select("service", "callee")
    called = holds_callee.union(holds_stem).union(impls.select("service", F.col("impl").alias("callee"))).distinct()
    by_call = entries.join(calls, F.col("target") == F.col("caller")).select("entry_id", "callee").distinct().join(called, "callee").select("entry_id", has("call", F.col("service")).alias("feature"))
    left = said.union(triggers.select("entry_id", has("trigger", F.col("low")))).union(targets.select("entry_id", has("target", F.col("low")))).union(by_call)
    best = best_rows(left.withColumnRenamed("entry_id", "left_id"), right, k, block)
    return best.select(F.col("left_id").alias("entry_id"), "ord", "score").join(ops.select("ord", "service", "operation"), "ord").select("entry_id", "service", "operation", "ord", "score")


def resolve_name(refs: DataFrame, nodes: DataFrame, ref: str, name: str, order: list, ref_keys: list[str], suffix: str = "service") -> DataFrame:
    """Node of a reference by lower-case name; either side may lack the suffix."""
    bare = lambda c: F.regexp_replace(F.lower(F.col(c)), f"{suffix}$", "")
    r = refs.withColumn("__key", F.explode(F.array_distinct(F.array(F.concat(F.lit("n:"), F.lower(F.col(ref))), F.concat(F.lit("n:"), bare(ref)), F.concat(F.lit("b:"), F.lower(F.col(ref)))))))
    n = nodes.withColumn("__key", F.explode(F.array_distinct(F.array(F.concat(F.lit("n:"), F.lower(F.col(name))), F.concat(F.lit("b:"), bare(name))))))
    return unique_by(r.join(n, "__key").drop("__key"), ref_keys, order)


def longest_key(usage: DataFrame, prices: DataFrame, model: str, key: str, default: str) -> DataFrame:
    """Price row of the longest key that the model name contains; the default's row if none does."""
    hit = contains_pairs(usage.select(model).distinct(), prices.select(key).distinct(), model, key)
    best = hit.groupBy(model).agg(F.max_by(key, F.struct(F.length(key), key)).alias("__key"))
    named = usage.join(best, model, "left").withColumn(key, F.coalesce("__key", F.lit(default))).drop("__key")
    return named.join(prices, key).select(*usage.columns, *(c for c in prices.columns))


def keyword_score(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(F.lower(text), F.lit(w)).cast("int")
    return total


def contains_any(text: Column, words: list[str], whole_words: bool = False) -> Column:
    """Whether the normalised text contains any word; optionally as a whole word."""
    if whole_words:
        return F.lower(text).rlike("|".join(rf"\b{w}\b" for w in words))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(w))
    return out
