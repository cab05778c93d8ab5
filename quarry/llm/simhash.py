"""Operator 13, near-duplicates by SimHash fingerprints.

A fingerprint is the bitwise majority of the 64-bit hashes of all shingles of a
text. Distinct fingerprints, each with the least doc_id that has it, are laid
out in tiles: a tile holds the fingerprints whose bytes have the same eight
population counts. Two fingerprints differ in at least as many bits as their
counts differ in sum, so with a radius of two only tiles at most two counts
apart can hold a link, and all other tile pairs are skipped unseen. Two such
tiles have a tile between them (or one of the two) that is at most one count
from both: every fingerprint goes to its own tile and the tiles one count away,
and what meets there is compared exactly, by exclusive-or and bit counts of
whole tile pairs. Of the meetings of a pair of tiles one or two are used.

A tile with many fingerprints would make large meetings. Around tiles of more
than MEETING / (tiles around) fingerprints nothing meets at this level; what
would have met there is laid out again by the population counts of half bytes,
then of bit pairs, then of single bits, where a tile is one fingerprint and a
meeting holds 65. So no link is lost, no meeting exceeds MEETING fingerprints,
and no group of copies costs a square of its size.

Defined results: a null or wordless text has fingerprint zero and is linked like
any other; fewer words than a shingle are one shingle; a null doc_id keeps its
row, with its fingerprint and the component of that fingerprint's other rows, if
any; rows that repeat a doc_id keep one row each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ROWS_PER_TASK, as_bytes, partitions_for, slices, stored, table
from quarry.llm.components import components
from quarry.llm.ngram_join import forest

WORDS, RADIUS, SEED = 3, 2, 42
#: Fingerprints that one meeting of tiles may hold; at the last level 65 do, whatever this is.
MEETING = 8192
#: Into how many parts a fingerprint is cut for its population counts, level by level.
LEVELS = (8, 16, 32, 64)
#: Bytes of text whose words are in memory at once.
PIECE = 1 << 20
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
#: Meetings of up to so many rows are compared together with others.
_FEW = 64


def _word_lists(text: bytes, words: int) -> Iterator[list[bytes]]:
    """Words in lower case, a piece of the text at a time; each list begins with the last words of the one before, so
    that every shingle is whole in one list."""
    at, tail = 0, []
    while at < len(text):
        cut = _BREAK.search(text, min(len(text), at + PIECE))
        to = cut.start() if cut else len(text)
        tail += text[at:to].lower().split()
        if len(tail) >= words or to == len(text):
            yield tail
            tail = tail[len(tail) - words + 1 :] if words > 1 and len(tail) >= words else tail if len(tail) < words else []
        at = to


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text."""
    ones, n = np.zeros(64, np.int64), 0
    hashed = xxhash.xxh64_intdigest
    for found in _word_lists(text or b"", words):
        if not found or n and len(found) < words:
            continue
        joined, size = b" ".join(found), min(words, len(found))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - size + 1].tolist()
        hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, print) of every row; print is the fingerprint as a signed 64-bit number."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found = np.array([fingerprint(t, words) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], schema=schema)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, print long")


def tiles(prints: np.ndarray, parts: int) -> np.ndarray:
    """The population counts of the parts of each fingerprint, side by side in one number."""
    width = 64 // parts
    field, low = width.bit_length(), np.uint64((1 << width) - 1)
    out = np.zeros(len(prints), np.uint64)
    for k in range(parts):
        counts = np.bitwise_count((prints >> np.uint64(k * width)) & low).astype(np.uint64)
        out |= counts << np.uint64(k * field)
    return out


def around(own: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tile): each tile itself and the tiles one count away."""
    width = 64 // parts
    field = width.bit_length()
    rows, found, every = [np.arange(len(own))], [own], np.arange(len(own))
    for k in range(parts):
        count, one = (own >> np.uint64(k * field)) & np.uint64((1 << field) - 1), np.uint64(1 << (k * field))
        more, less = count < width, count > 0
        rows += [every[more], every[less]]
        found += [own[more] + one, own[less] - one]
    return np.concatenate(rows), np.concatenate(found)


def _used(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether tiles a and b are compared where they meet: a tile with itself there, tiles one count apart in the lesser."""
    here = (a == at) | (b == at)
    return np.where(a == b, here, ~here | (at <= np.minimum(a, b)))


def _tile_links(prints: np.ndarray, own: np.ndarray, at: np.uint64, radius: int) -> np.ndarray:
    """(first, other) places that connect what is linked in one meeting, its rows sorted by tile."""
    labels = np.arange(len(prints))
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    for i, (a, b) in enumerate(spans):
        for c, d in spans[i:]:
            if not _used(own[a : a + 1], own[c : c + 1], np.array([at]))[0]:
                continue
            near = np.bitwise_count(prints[a:b, None] ^ prints[None, c:d]) <= radius
            near &= labels[a:b, None] != labels[None, c:d]
            x, y = np.nonzero(near)
            if len(x):
                stars = forest(np.unique(np.stack([labels[a + x], labels[c + y]], axis=1), axis=0))
                to = np.arange(len(prints))
                to[stars[:, 1]] = stars[:, 0]
                labels = to[labels]
    other = np.flatnonzero(labels != np.arange(len(labels)))
    return np.stack([labels[other], other], axis=1)


def _meeting_links(at: np.ndarray, prints: np.ndarray, parts: int, radius: int) -> np.ndarray:
    """Pairs of places that connect what is linked in meetings, whose rows stand together."""
    own, found = tiles(prints, parts), []
    firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.concatenate([firsts[1:], [len(at)]])
    sizes = ends - firsts
    for a, b in zip(firsts[sizes > _FEW].tolist(), ends[sizes > _FEW].tolist(), strict=True):
        order = a + np.argsort(own[a:b], kind="stable")
        found.append(order[_tile_links(prints[order], own[order], at[a], radius)])
    last = np.repeat(np.where(sizes > _FEW, firsts, ends), sizes)  # the large ones are done
    left = np.arange(len(at))
    for step in range(1, _FEW):
        left = left[left + step < last[left]]
        if not len(left):
            break
        a, b = left, left + step
        used = _used(own[a], own[b], at[a])
        a, b = a[used], b[used]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        found.append(np.stack([a[near], b[near]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _links(meetings: DataFrame, parts: int, radius: int, n: int) -> DataFrame:
    """Links (a, b) between the documents that stand for fingerprints, from rows (at, print, first)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(at: np.ndarray, prints: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        pairs = _meeting_links(at.view(np.uint64), prints.view(np.uint64), parts, radius)
        ends = forest(np.unique(first[pairs], axis=0)) if len(pairs) else pairs
        return pa.RecordBatch.from_arrays([pa.array(ends[:, k], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, ("at", "print", "first"), strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last meeting may go on
            if whole >= 1 << 16:
                yield linked(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield linked(*held)

    return meetings.repartition(n, "at").sortWithinPartitions("at").mapInArrow(run, "a long, b long")


def _laid_out(classes: DataFrame, parts: int) -> DataFrame:
    """(tile, print, first) of classes(print, first)."""
    schema = pa.schema([("tile", pa.int64()), ("print", pa.int64()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = tiles(batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64), parts)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), batch.column("print"), batch.column("first")], schema=schema)

    return classes.select("print", "first").mapInArrow(run, "tile long, print long, first long")


def _near_tiles(own: DataFrame, column: str, parts: int, out: str) -> DataFrame:
    """(column, out): each tile with itself and those one count away."""
    schema = pa.schema([(column, pa.int64()), (out, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(column).to_numpy(zero_copy_only=False)
            rows, found = around(at.view(np.uint64), parts)
            yield pa.RecordBatch.from_arrays([pa.array(at[rows]), pa.array(found.view(np.int64))], schema=schema)

    return own.select(column).mapInArrow(run, f"{column} long, {out} long")


def _meetings(laid: DataFrame, parts: int) -> DataFrame:
    """(at, print, first): every fingerprint in its own tile and those one count away, but not in tiles of `closed`."""
    schema = pa.schema([("at", pa.int64()), ("print", pa.int64()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, closed = batch.column("tile").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("closed")
            rows, at = around(own, parts)
            if closed.null_count < len(closed):
                shut = closed.to_pylist()
                open_ = np.fromiter((not shut[r] or a not in shut[r] for r, a in zip(rows.tolist(), at.view(np.int64).tolist(), strict=True)), bool, len(rows))
                rows, at = rows[open_], at[open_]
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), batch.column("print").take(pa.array(rows)), batch.column("first").take(pa.array(rows))], schema=schema)

    return laid.select("tile", "print", "first", "closed").mapInArrow(run, "at long, print long, first long")


def near_links(classes: DataFrame, radius: int = RADIUS, meeting: int = MEETING) -> DataFrame:
    """Links (a, b) that connect the classes(print, first) with fingerprints at most `radius` (of 2) bits apart."""
    if not 0 <= radius <= 2:
        raise ValueError("tiles around a tile are one count away: radius 0, 1 or 2")
    spark, out = classes.sparkSession, None
    for parts in LEVELS:
        counted, crowded = Observation(), Observation()
        laid = stored(_laid_out(classes, parts).observe(counted, F.count("*").alias("rows")), "simhash-tiles")
        heavy = laid.groupBy("tile").count().where(F.col("count") > max(1, meeting // (2 * parts + 1)))
        shut = stored(_near_tiles(heavy, "tile", parts, "shut").select("shut").distinct().observe(crowded, F.count("*").alias("rows")), "simhash-shut")
        open_rows, left = laid.withColumn("closed", F.lit(None).cast("array<long>")), None
        if crowded.get["rows"]:
            near = _near_tiles(shut, "shut", parts, "tile").groupBy(F.col("tile").alias("t")).agg(F.collect_set("shut").alias("closed"))
            open_rows = stored(laid.join(near, laid["tile"] == near["t"], "left").select("tile", "print", "first", "closed"), "simhash-marked")
            left = open_rows.where("closed IS NOT NULL")
        n = max(partitions_for(spark), counted.get["rows"] * (2 * parts + 1) // ROWS_PER_TASK + 1)
        links = stored(_links(_meetings(open_rows, parts), parts, radius, n), "simhash-links")
        out = links if out is None else out.union(links)
        if left is None:
            return out
        classes = left
    return out


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, meeting: int = MEETING) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    prints = stored(fingerprints(docs, words), "simhash-prints")
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")).where("first IS NOT NULL"), "simhash-classes")
    joined = components(near_links(classes, radius, meeting))
    named = classes.join(joined, classes["first"] == joined["id"], "left").select(F.col("print").alias("p"), F.coalesce("component", "first").alias("component_id"))
    found = prints.join(named, F.col("print") == F.col("p"), "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
