"""Operator 6, benchmark decontamination.

One Aho-Corasick automaton holds every window of ten consecutive normalised
words of the benchmark items. Each document is normalised once (ASCII letters
lower-cased, words are runs of ASCII letters, digits and non-ASCII characters),
scanned once, and every match is mapped back to word positions and to byte
offsets of the original text.

A benchmark of up to `block_bytes` bytes of item text is sent to the tasks
whole, and the texts are read once. A larger one is dealt by item into blocks of
about that size, one of which is at the driver and in the tasks at a time: each
is scanned on its own, and only hits are brought together by row. An item is cut
nowhere, so the longest item adds to the bound.

Defined results: a null or empty text has no words and is clean; an item without
words matches nothing; an item shorter than a window is one window; repeated
rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, stored, table, unused

WINDOW = 10
BLOCK_BYTES = 4 << 20

#: Byte map of the normalisation: letters lower-cased, all other ASCII but digits to a space.
_NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def _windows(words: list[bytes], size: int) -> Iterator[bytes]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield b" " + b" ".join(words[i : i + size]) + b" "


def build_automaton(items: list[tuple[str, bytes | None]], size: int = WINDOW):
    """Automaton whose patterns carry their length in words and the positions of their items."""
    import ahocorasick

    owners: dict[bytes, list[int]] = {}
    for at, (_, text) in enumerate(items):
        for window in set(_windows(words_of(text), size)):
            owners.setdefault(window, []).append(at)
    automaton = ahocorasick.Automaton()
    for window, own in owners.items():
        automaton.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, own))
    if owners:
        automaton.make_automaton()
    return automaton


def scan(words: list[bytes], automaton) -> tuple[np.ndarray, set[int]]:
    """Half-open word ranges covered by windows (merged, in order), and the items found."""
    if not len(automaton) or not words:
        return np.empty((0, 2), np.int64), set()
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return np.empty((0, 2), np.int64), set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    lasts = np.searchsorted(spaces, np.array([end for end, _ in found]))
    firsts = lasts - np.array([v[1] for _, v in found])
    items = {x for _, v in found for x in v[2]}
    return merge_ranges(firsts, lasts), items


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of half-open ranges as maximal runs; touching ranges join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    lasts = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.stack([starts[new], ends[lasts]], axis=1)


def byte_spans(text: bytes, ranges: np.ndarray) -> list[dict]:
    """Byte offsets in the original text of word ranges (normalisation keeps every byte in place)."""
    flat = np.frombuffer(text.translate(_NORMAL), np.uint8) != 0x20
    edges = np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [{"start": int(begins[a]), "end": int(ends[b - 1])} for a, b in ranges]


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
        ("items", pa.list_(pa.string())), ("items_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("contaminated", pa.bool_()),
    ]
)
HIT_DDL = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<struct<start:long,end:long>>, contaminated boolean"


Items = list[tuple[str, bytes | None]]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    """Items in blocks of about `block_bytes` bytes of text, one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = -(-size // block_bytes)
    if n > 1:
        items = stored(items.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(n))), "benchmark-items")
    for k in range(max(1, n)):
        own = items.where(F.col("block") == k) if n > 1 else items
        yield [(r["item"], bytes(r["body"]) if r["body"] is not None else None) for r in own.collect()]


def _verdict(doc_id: int | None, text: bytes | None, n_words: int, ranges: np.ndarray, items: set[str]) -> dict:
    found = sorted(items)
    n_hit = int((ranges[:, 1] - ranges[:, 0]).sum())
    return {
        "doc_id": doc_id, "n_words": n_words, "n_hit": n_hit, "n_items": len(found), "items": found,
        "items_sha256": hashlib.sha256(",".join(found).encode()).hexdigest(),
        "spans": byte_spans(text, ranges) if n_hit else [], "contaminated": n_hit > 0,
    }


_HITS = pa.schema([("row", pa.int64()), ("ranges", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _block_hits(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(row, ranges, items) of the hit rows(row, text) by block; each block has its own pass over the texts."""

    def scanned(items: Items) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            automaton = build_automaton(own, window)
            for batch in batches:
                found = [(row, *scan(words_of(t), automaton)) for row, t in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text")), strict=True)]
                hits = [{"row": row, "ranges": ranges.reshape(-1).tolist(), "items": [own[x][0] for x in items]} for row, ranges, items in found if items]
                yield pa.RecordBatch.from_pylist(hits, schema=_HITS)

        out = stored(rows.mapInArrow(run, "row long, ranges array<long>, items array<string>"), "benchmark-hits")
        sent.destroy()
        return out

    return reduce(DataFrame.union, map(scanned, _blocks(benchmark, block_bytes)))


def _fits(benchmark: DataFrame, block_bytes: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0) <= block_bytes


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, the hit words, the items found, and the spans in bytes of the original text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if _fits(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(next(_blocks(benchmark, block_bytes)))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            automaton = build_automaton(items, window)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                    words = words_of(text)
                    ranges, found = scan(words, automaton)
                    rows.append(_verdict(doc_id, text, len(words), ranges, {items[x][0] for x in found}))
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

        return docs.mapInArrow(judge, HIT_DDL)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges, items in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("ranges", "items")), strict=True):
                flat = np.array(ranges or [], np.int64).reshape(-1, 2)
                rows.append(_verdict(doc_id, text, len(words_of(text)), merge_ranges(flat[:, 0], flat[:, 1]) if len(flat) else flat, set(items or [])))
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "benchmark-rows")
    hits = _block_hits(rows.select("row", "text"), benchmark, window, block_bytes)
    hits = hits.groupBy(F.col("row").alias("hit_row")).agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
    return rows.join(hits, F.col("row") == F.col("hit_row"), "left").select("doc_id", "text", "ranges", "items").mapInArrow(merge, HIT_DDL)


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in which no benchmark window occurs, with all their columns."""
    if _fits(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(next(_blocks(benchmark, block_bytes)))
        at = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(sent.value, window)
            for batch in batches:
                texts = batch.column(at).cast(pa.string())
                yield batch.filter(pa.array([not scan(words_of(t), automaton)[1] for t in as_bytes(texts)], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)
    name = unused(docs, "row")
    rows = stored(docs.withColumn(name, F.monotonically_increasing_id()), "benchmark-rows")
    hits = _block_hits(rows.select(F.col(name).alias("row"), F.col("text").cast("string").alias("text")), benchmark, window, block_bytes)
    return rows.join(hits.select(F.col("row").alias(name)).distinct(), name, "left_anti").select(*docs.columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
