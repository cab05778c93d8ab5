"""Operator 11, collocation mining over vertically partitioned suffix trees.

The words of a piece of text (what stands between punctuation) are its
alphabet; phrases of up to three words are paths from the root of the suffix
tree, so the tree is wanted to depth three only. As it outgrows memory, it is
partitioned vertically: by prefixes whose occurrences fit a budget. A first scan
counts the suffixes that begin with each of 2**16 buckets of first words. A
bucket over the budget is extended: a second scan counts its suffixes by buckets
of the first two words, and those over the budget are extended to three words,
where a path is one counter. Buckets within the budget are put together into
groups up to the budget; the scan after that sends every suffix, cut to three
words, to its group, and each group builds its subtrees on its own: sorted
suffixes are the leaves, and the occurrences of a path are the sum of the leaves
below it. Where an extended prefix splits a path over groups, the sums of the
groups are added.

A task sends equal suffixes of a few MB of text once, with their number, packed
by group, so a line that a third of the documents hold is a few numbers. Only
bucket counts over the budget reach the driver: at most two for each budget's
worth of text, and 2**16. Words are compared as bytes, never by hash; hashes
choose groups alone.

Phrases under the least count are dropped once their counts are whole; every
part of a candidate occurs as often as the candidate, so no count is missed.
Scores are taken with 38 digits.

Defined results: null texts have no words; a null language is `und`; rows that
repeat a doc_id count each; a language without candidates has no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, slices, stored, table
from quarry.llm.hashing import mix, prefix_sums, window_hashes

LEAST, TOP = 10, 2000
#: Suffixes (before equal ones are put together) that a group's prefixes may have.
BUDGET = 1 << 20
#: Groups are no more than this, whatever the corpus: the budget grows beyond.
GROUPS_MOST = 1 << 16
BUCKET_BITS = 16
#: Bytes of text of one language whose suffixes are put together before they are sent; of all languages, eight times this.
SCAN = 4 << 20
#: Rows of the top lists are ranked in so many parts of a language first.
RANK_PARTS = 32

_SPACE, _END = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.int8)
_KIND[list(_SPACE)], _KIND[list(_END)] = 1, 2
_LAST_BREAK = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D](?=[^\x20\x09.,;:!?\x0A-\x0D]*\Z)")
_NEXT_BREAK = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
#: What may follow a cut and still belong to a suffix that begins before it: two words.
_CONTEXT = re.compile(rb"[\x20\x09]*[^\x20\x09.,;:!?\x0A-\x0D]*[\x20\x09]*[^\x20\x09.,;:!?\x0A-\x0D]*")


def _chunks(text: bytes, most: int = SCAN) -> Iterator[tuple[bytes, int]]:
    """(bytes, own): parts of a text, of which the suffixes that begin in the first `own` bytes count; the rest is context."""
    at = 0
    while len(text) - at > most:
        cut = _LAST_BREAK.search(text[at : at + most]) or _NEXT_BREAK.search(text[at:])
        if not cut:
            break
        own = cut.end()
        end = _CONTEXT.match(text, at + own).end()
        yield text[at:end], own
        at += own
    yield text[at:], len(text) - at


class Suffixes:
    """Suffixes of up to three words of some chunks of one language, equal ones together: word numbers a, b, c (0: none,
    else place in words plus one) and how often each occurs."""

    def __init__(self, chunks: list[tuple[bytes, int]], lang: str):
        joined = b"\n".join(c for c, _ in chunks).lower()
        data = np.frombuffer(joined, np.uint8)
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letters = data[kind == 0]
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        one = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1)
        piece = np.cumsum(kind == 2)[starts] if len(starts) else starts
        two, three = np.zeros_like(one), np.zeros_like(one)
        if len(one) > 1:
            two[:-1] = np.where(piece[1:] == piece[:-1], one[1:], 0)
            three[:-1] = np.where(two[:-1] > 0, two[1:], 0)
        if any(own < len(c) for c, own in chunks):
            begin = np.cumsum([0, *(len(c) + 1 for c, _ in chunks)])[:-1]
            chunk = np.searchsorted(begin, starts, side="right") - 1
            counts = starts < (begin + np.array([own for _, own in chunks]))[chunk]
            one, two, three = one[counts], two[counts], three[counts]
        size = np.uint64(len(self.words) + 1)  # under 2**21, as chunks are short: three fit 64 bits
        keys, self.count = np.unique((one * size + two) * size + three, return_counts=True)
        self.a, self.b, self.c = (keys // size // size).astype(np.int64), (keys // size % size).astype(np.int64), (keys % size).astype(np.int64)
        self._hashes(lang)

    def _hashes(self, lang: str) -> None:
        """Hashes of the first one, two and three words of each suffix; of the same value wherever they stand."""
        offsets = np.frombuffer(self.words.buffers()[1], np.int64)[: len(self.words) + 1] if len(self.words) else np.zeros(1, np.int64)
        data = np.frombuffer(self.words.buffers()[2], np.uint8)[: offsets[-1]] if len(self.words) else np.empty(0, np.uint8)
        own = window_hashes(prefix_sums(data), offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64)
        seed = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little"))
        words = np.concatenate([np.zeros(1, np.uint64), mix(own ^ mix(np.array([seed], np.uint64)))])
        self.one = words[self.a]
        self.two = mix(self.one * np.uint64(0x9E3779B97F4A7C15) + words[self.b])
        self.three = mix(self.two * np.uint64(0x9E3779B97F4A7C15) + words[self.c])


def _scans(batches: Iterator[pa.RecordBatch], scan: int) -> Iterator[tuple[str, Suffixes]]:
    """The suffixes of a task's texts, some MB of one language at a time."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for part in slices([batch], "text", scan):
            for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part.column("text")), strict=True):
                for chunk in _chunks(text or b"", scan):
                    if sizes.get(lang, 0) + len(chunk[0]) > scan and sizes.get(lang):
                        yield lang, Suffixes(held.pop(lang), lang)
                        sizes.pop(lang)
                    held.setdefault(lang, []).append(chunk)
                    sizes[lang] = sizes.get(lang, 0) + len(chunk[0]) + 1
                if len(sizes) > 8 and sum(sizes.values()) > 8 * scan:
                    for k in list(held):
                        yield k, Suffixes(held.pop(k), k)
                    sizes.clear()
    for k in list(held):
        yield k, Suffixes(held.pop(k), k)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Partition:
    """Which group a suffix belongs to. Groups are numbered by the length of their prefixes: first those of one word,
    then those of two, then those of three."""

    def __init__(self, counts: dict[int, int], budget: int):
        self.budget, self.total = budget, sum(counts.values())
        self.extended = np.array(sorted(b for b, n in counts.items() if n > budget // 2), np.int64)
        self.of_bucket = np.zeros(1 << BUCKET_BITS, np.int64)
        group, load = 0, 0
        for bucket, n in sorted(counts.items()):
            if n > budget // 2:
                continue
            if load + n > budget:
                group, load = group + 1, 0
            self.of_bucket[bucket], load = group, load + n
        self.ends = [group + 1, group + 1, group + 1]
        self.hot = sum(counts[b] for b in self.extended.tolist())
        self.long = np.empty(0, np.int64)

    def extend(self, long: dict[int, int]) -> None:
        """Adds groups for the extended buckets; long: the buckets of two words over the budget, with their suffixes."""
        self.long = np.array(sorted(long), np.int64)
        third = sum(long.values())
        two, three = max(1, -(-(self.hot - third) // self.budget)), -(-third // self.budget)
        self.ends = [self.ends[0], self.ends[0] + two, self.ends[0] + two + three]

    def pair_bucket(self, s: Suffixes) -> np.ndarray:
        """Bucket of the first two words within an extended bucket."""
        return (_bucket(s.one) << BUCKET_BITS) | _bucket(s.two)

    def groups(self, s: Suffixes) -> np.ndarray:
        out = self.of_bucket[_bucket(s.one)]
        if len(self.extended):
            two = np.isin(_bucket(s.one), self.extended)
            three = two & np.isin(self.pair_bucket(s), self.long)
            spread = lambda h, n: ((h & np.uint64(0xFFFFFFFF)) % np.uint64(max(1, n))).astype(np.int64)
            out = np.where(two, self.ends[0] + spread(s.two, self.ends[1] - self.ends[0]), out)
            out = np.where(three, self.ends[1] + spread(s.three, self.ends[2] - self.ends[1]), out)
        return out

    def prefix_length(self, group: int) -> int:
        return 1 + sum(group >= e for e in self.ends[:2])


def _counted(texts: DataFrame, keys, scan: int) -> DataFrame:  # noqa: ANN001
    """(bucket, n): suffixes by keys(suffixes), which gives buckets, -1 for suffixes that do not count."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for _, s in _scans(batches, scan):
            buckets = keys(s)
            found, at = np.unique(buckets[buckets >= 0], return_inverse=True)
            for b, n in zip(found.tolist(), np.bincount(at, weights=s.count[buckets >= 0], minlength=len(found)).tolist(), strict=True):
                held[b] = held.get(b, 0) + int(n)
            if len(held) > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], schema=schema)
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], schema=schema)

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def partition(texts: DataFrame, budget: int, scan: int) -> Partition:
    """The groups of prefixes for texts(lang, text)."""
    counts = {r["bucket"]: r["n"] for r in _counted(texts, lambda s: _bucket(s.one), scan).collect()}  # 2**16 at most
    out = Partition(counts, max(budget, sum(counts.values()) // GROUPS_MOST))
    if len(out.extended):
        inside = lambda s: np.where(np.isin(_bucket(s.one), out.extended), out.pair_bucket(s), -1)
        out.extend({r["bucket"]: r["n"] for r in _counted(texts, inside, scan).where(F.col("n") > out.budget // 2).collect()})
    return out


_PACK = pa.schema([("group", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("rows", pa.binary())])
_PACK_DDL = "group long, lang string, words binary, rows binary"


def _packed(s: Suffixes, lang: str, groups: np.ndarray) -> Iterator[tuple[int, str, bytes, bytes]]:
    """The suffixes of each group, with the words they have."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], groups[order][1:] != groups[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = order[lo:hi]
        used, own = np.unique(np.concatenate([s.a[at], s.b[at], s.c[at]]), return_inverse=True)
        if used[0] != 0:
            own += 1
        words = s.words.take(pa.array(used[used > 0] - 1))
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.uint32)
        letters = b"".join(words.to_pylist())
        head = np.array([len(sizes)], np.uint32).tobytes()
        yield int(groups[at[0]]), lang, squeeze(head + sizes.tobytes() + letters), squeeze(np.concatenate([own.astype(np.uint32), s.count[at].astype(np.uint32)]).tobytes())


def _unpacked(words: bytes, rows: bytes) -> tuple[pa.Array, np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    data, numbers = open_(words), np.frombuffer(open_(rows), np.uint32).reshape(4, -1)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    places = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint32, n, 4).astype(np.int64))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(places), pa.py_buffer(data[4 + 4 * n :] or b"\0")]), numbers.astype(np.int64)


_NODES = pa.schema([("lang", pa.string()), ("depth", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
_NODES_DDL = "lang string, depth int, phrase string, n long"


def subtree(packs: list[tuple[bytes, bytes]], lang: str, prefix: int, least: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a group's subtrees with their occurrences: all of those above the prefix, of the others those that
    occur often enough. The root's node, of depth 0, counts the words."""
    parts = [_unpacked(*p) for p in packs]
    coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    words, codes = coded.dictionary, np.concatenate([[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1])
    at, columns = 0, []
    for own, numbers in parts:
        place = lambda x, at=at: np.where(x > 0, codes[np.where(x > 0, x + at, 0)], 0)
        columns.append(np.stack([place(numbers[0]), place(numbers[1]), place(numbers[2]), numbers[3]]))
        at += len(own)
    a, b, c, n = np.concatenate(columns, axis=1)
    order = np.lexsort((c, b, a))  # the leaves, in the order of the tree
    a, b, c, n = a[order], b[order], c[order], n[order]
    new = np.ones(len(a), bool)
    fresh = [new]
    for x in (a, b, c):
        new = fresh[-1].copy() if x is not a else np.zeros(len(a), bool)
        new[0] = True
        new[1:] |= x[1:] != x[:-1]
        fresh.append(new)
    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int(n.sum())], pa.int64())], schema=_NODES)
    for depth, last in ((1, a), (2, b), (3, c)):
        firsts = np.flatnonzero(fresh[depth])
        sums = np.add.reduceat(n, firsts)
        kept = (last[firsts] > 0) & ((sums >= least) | (depth < prefix))
        firsts, sums = firsts[kept], sums[kept]
        text = pc.binary_join_element_wise(*(words.take(pa.array(x[firsts] - 1)) for x in (a, b, c)[:depth]), pa.scalar(b" ", pa.large_binary()))
        phrase = text.cast(pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(firsts), pa.string()), pa.array(np.full(len(firsts), depth, np.int32)), phrase, pa.array(sums, pa.int64())], schema=_NODES)


def phrase_counts(docs: DataFrame, *, least: int = LEAST, budget: int = BUDGET, scan: int = SCAN) -> DataFrame:
    """(lang, depth, phrase, n): the words of each language (depth 0), and its phrases of 1 to 3 words that occur
    `least` times or more."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    groups = partition(texts, budget, scan)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, s in _scans(batches, scan):
            rows = list(_packed(s, lang, groups.groups(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PACK.types, strict=True)], schema=_PACK)

    def build(packs: pa.Table) -> pa.Table:
        group, found = packs.column("group")[0].as_py(), []
        for lang in packs.column("lang").unique().to_pylist():
            own = packs.filter(pc.equal(packs.column("lang"), lang))
            found += subtree(list(zip(own.column("words").to_pylist(), own.column("rows").to_pylist(), strict=True)), lang, groups.prefix_length(group), least)
        return pa.Table.from_batches(found, schema=_NODES)

    nodes = texts.mapInArrow(send, _PACK_DDL).groupBy("group").applyInArrow(build, _NODES_DDL)
    return nodes.groupBy("lang", "depth", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("depth") == 0))


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP, cover: int = 50, budget: int = BUDGET, scan: int = SCAN) -> DataFrame:
    """The top phrases of two and three words of each language by the score of their weakest cut."""
    nodes = stored(phrase_counts(docs, least=least, budget=budget, scan=scan), "phrase-nodes")
    counts = nodes.where("depth > 0").select(F.col("lang").alias("c_lang"), F.col("phrase").alias("part"), F.col("n").alias("f"))
    candidates = nodes.where("depth > 1").select("lang", "depth", "phrase", F.col("n").alias("a"))
    word = F.split("phrase", " ")
    cut = lambda lo, hi: F.array_join(F.slice(word, lo, hi), " ")
    two = F.array(F.struct(F.lit("l1").alias("role"), cut(1, 1).alias("part")), F.struct(F.lit("r1").alias("role"), cut(2, 2).alias("part")))
    three = F.array(*(F.struct(F.lit(role).alias("role"), part.alias("part")) for role, part in (("l1", cut(1, 1)), ("r1", cut(2, 2)), ("l2", cut(1, 2)), ("r2", cut(3, 1)))))
    asked = candidates.withColumn("cut", F.explode(F.when(F.col("depth") == 2, two).otherwise(three))).select("lang", "depth", "phrase", "a", "cut.*")
    known = asked.join(counts, (F.col("lang") == F.col("c_lang")) & (asked["part"] == counts["part"])).groupBy("lang", "depth", "phrase", "a")
    parts = known.agg(*(F.max(F.when(F.col("role") == r, F.col("f"))).alias(r) for r in ("l1", "r1", "l2", "r2")))
    score = lambda k: f"CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l{k} AS DECIMAL(18,0)) * CAST(r{k} AS DECIMAL(18,0)))"
    scored = parts.withColumns({"s1": F.expr(score(1)), "s2": F.expr(score(2))})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    scored = stored(scored.select("lang", "depth", "phrase", "a", *(F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias(y) for x, y in (("l", "l"), ("r", "r"), ("s", "score")))), "phrase-scores")
    inner = F.explode(F.array_distinct(F.array(cut(1, 2), cut(2, 2)))).alias("held")
    longer = scored.where("depth = 3").select(F.col("lang").alias("h_lang"), "a", inner).groupBy("h_lang", "held").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, (F.col("lang") == F.col("h_lang")) & (F.col("phrase") == F.col("held")), "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    firsts = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = nodes.where("depth = 0").select(F.col("lang").alias("n_lang"), F.col("n"))
    return ranked.join(words, F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS piece,
    regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM p, unnest(range(1, len(w) + 1)) AS t(i), unnest(range(1, 4)) AS u(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS depth, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
s AS (
  SELECT c.lang, depth, c.phrase, a, x.f AS l, y.f AS r, j,
    CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c, unnest(range(1, depth)) AS t(j)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (
  SELECT lang, array_to_string(w[o:o + 1], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(1, 3)) AS t(o) WHERE depth = 3 GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n USING (lang) LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""
