"""Operator 3, suffix-array dedup with a logarithmic index family.

Every byte covered by a `LENGTH`-byte string that also starts earlier (smaller
doc_id, or earlier in the same document) is removed. A full suffix array of all
bytes would take many times the space of the text, so it is sparse: of the
suffixes that start inside a window of LENGTH bytes, the one whose first ANCHOR
bytes have the least fingerprint is indexed (the leftmost of equals). The choice
depends on the window's bytes alone, so equal windows index the same suffix,
and consecutive windows that index the same suffix form a run of up to
LENGTH - ANCHOR + 1 windows: about one entry in 35 bytes.

Entries are ordered by the fingerprints of their prefix (the anchor) and of
their run's text; a task holds one slice of that order for all documents. In
it, each arriving batch is sorted into an array, scanned against the levels
there for equal runs (the earlier start stays, the later is a repeat), and added
as a new level; levels of like sizes merge, so n batches leave log n levels.
Equal runs settle all their windows at once. Two runs count as equal if 64 bits
of their hash, 32 bits of a second one and the 64 bits of their anchor agree.
Runs that share an anchor but not their whole text (the ends of a passage) are
few: their windows are compared byte by byte among blocks with an equal core.

Hot anchors, those that a sample of about `SAMPLE_ROWS` documents holds
`HOT_IN_SAMPLE` times or more, would bring the rows of very many documents to
one task. Their runs are dealt by anchor and run, and the windows of their
different runs are dealt one by one and found equal by their hashes. The sample
decides where rows go, never what is found.

Defined results: null and empty texts have nothing to remove; texts shorter
than LENGTH stay; a null doc_id takes part in no comparison and stays whole;
rows that repeat a doc_id are one document; extra columns are ignored, or kept
by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, partitions_for, slices, stored, table, unused
from quarry.llm.hashing import CHECK_VALUES, mix, prefix_sums, window_hashes

LENGTH, ANCHOR = 100, 32
#: Windows per block when runs differ; a block's windows share LENGTH - BLOCK + 1 bytes.
BLOCK = 17
_LOW = np.uint64((1 << 24) - 1)
#: Bytes read at once; the rest of a longer text follows in further pieces.
PIECE = 4 << 20
#: Kinds of rows: indexed run, repeated windows (first window, number), run whose windows must be compared; and the
#: first and the last for hot anchors.
RUN, REPEAT, COMPARE, HOT_RUN, HOT_COMPARE = 0, 1, 2, 3, 4
#: Documents that are sampled for hot anchors, and how often one must be found in them.
SAMPLE_ROWS, HOT_IN_SAMPLE = 20_000, 50


def window_anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, position of the indexed suffix for each window start) of a byte array."""
    sums = prefix_sums(data)
    starts = np.arange(len(data) - anchor + 1)
    value = (mix(window_hashes(sums, starts, starts + anchor)) & ~_LOW) | starts.astype(np.uint64)
    width, have = length - anchor + 1, 1
    while have * 2 <= width:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    if have < width:
        value = np.minimum(value[: len(value) - (width - have)], value[width - have :])
    return sums, (value & _LOW).astype(np.int64)


def runs_of(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor hash, run hash, second run hash) of all runs of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2)) + (np.empty(0, np.int32),)
    sums, chosen = window_anchors(data, length, anchor)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(chosen)]
    inside = np.arange(len(chosen)) + length <= begins[owner + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return runs_of([b""], length, anchor)
    own, picked = owner[starts], chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    at, at_anchor = starts[first], picked[first]
    anchors = mix(window_hashes(sums, at_anchor, at_anchor + anchor))
    whole = mix(window_hashes(sums, at, at + count + length - 1) + count.astype(np.uint64))
    return own[first], at - begins[own[first]], count, anchors, whole, second_hashes(data, at, at + count + length - 1)


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32 further bits of the hashes of data[start:end]."""
    return (mix(window_hashes(prefix_sums(data, CHECK_VALUES), starts, ends)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def pieces(batches: Iterator[pa.RecordBatch], length: int, most: int = PIECE) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(doc_ids, offsets, texts) of bounded size; long texts come in pieces that overlap by a window less one byte."""
    for batch in slices(batches, "text", 1 << 20):
        ids, offsets, texts = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if doc_id is None or not text or len(text) < length:
                continue
            for at in range(0, len(text) - length + 1, most):
                ids.append(doc_id)
                offsets.append(at)
                texts.append(text[at : at + most + length - 1])
                if len(text) > most:
                    yield ids, offsets, texts
                    ids, offsets, texts = [], [], []
        if ids:
            yield ids, offsets, texts


class Levels:
    """Sorted arrays of runs whose sizes at least double from level to level.

    Rows are (run hash, second hash, anchor hash, doc_id, place); of equal runs the earliest stays.
    """

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def add(self, run: np.ndarray, check: np.ndarray, anchor: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds a batch; returns (doc_id, place) of the runs found to be repeats."""
        order = np.lexsort((place, doc, anchor, check, run))
        new = [x[order] for x in (run, check, anchor, doc, place)]
        first = np.ones(len(order), bool)
        first[1:] = (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1]) | (new[2][1:] != new[2][:-1])
        # A row that repeats the very place before it (a repeated row) is no repeat.
        heads = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.arange(0)
        later = ~first & ~((new[3] == new[3][heads]) & (new[4] == new[4][heads]))
        out = [(new[3][later], new[4][later])]
        new = [x[first] for x in new]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], new[0]), len(level[0]) - 1)
            other = np.flatnonzero(level[0][at] == new[0])
            hit = []
            while len(other):  # more than once only where different runs share a hash
                old = at[other]
                same = (level[1][old] == new[1][other]) & (level[2][old] == new[2][other])
                hit.append(other[same])
                other = other[~same]
                at[other] += 1
                other = other[at[other] < len(level[0])]
                other = other[level[0][at[other]] == new[0][other]]
            hit = np.concatenate(hit) if hit else other
            if not len(hit):
                continue
            old = at[hit]
            same = (level[3][old] == new[3][hit]) & (level[4][old] == new[4][hit])
            wins = (new[3][hit] < level[3][old]) | ((new[3][hit] == level[3][old]) & (new[4][hit] < level[4][old]))
            out.append((np.where(wins, level[3][old], new[3][hit])[~same], np.where(wins, level[4][old], new[4][hit])[~same]))
            level[3][old[wins]], level[4][old[wins]] = new[3][hit[wins]], new[4][hit[wins]]
            rest = np.ones(len(new[0]), bool)
            rest[hit] = False
            new = [x[rest] for x in new]
        if len(new[0]):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self.merge()
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def merge(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        joined = [np.concatenate([x, y]) for x, y in zip(b, a, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        self.levels.append([x[order] for x in joined])

    def all(self) -> list[np.ndarray]:
        """The rows of all levels, merged to one."""
        while len(self.levels) > 1:
            self.merge()
        return self.levels[0] if self.levels else [np.empty(0, t) for t in (np.uint64, np.int32, np.uint64, np.int64, np.int64)]

    def unsettled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, doc_id, place) of the runs that share their anchor with a different run."""
        _, _, anchor, doc, place = self.all()
        order = np.argsort(anchor, kind="stable")
        anchor, doc, place = anchor[order], doc[order], place[order]
        shared = np.zeros(len(anchor), bool)
        shared[1:] = anchor[1:] == anchor[:-1]
        shared[:-1] |= shared[1:]
        return anchor[shared], doc[shared], place[shared]


_ROWS = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("run", pa.int64()), ("check", pa.int32()), ("doc", pa.int64()), ("place", pa.int64())])
_ROWS_DDL = "key long, kind tinyint, run long, check int, doc long, place long"


def _rows(key: np.ndarray, kind: int, doc: np.ndarray, place: np.ndarray, run: np.ndarray | None = None, check: np.ndarray | None = None) -> pa.RecordBatch:
    run = np.zeros(len(key), np.int64) if run is None else run.view(np.int64)
    check = np.zeros(len(key), np.int32) if check is None else check
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind, np.int8)), *map(pa.array, (run, check, doc, place))], schema=_ROWS)


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class _Sender:
    """Rows of one task: what repeats within the task is settled there, so a frequent run sends one row a batch."""

    def __init__(self, kinds: np.ndarray, most: int = 1_000_000):
        self.hot, self.most = kinds, most
        self.levels, self.repeats, self.held = Levels(), [], 0

    def add(self, run: np.ndarray, check: np.ndarray, anchor: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.repeats.append(self.levels.add(run, check, anchor, doc, place))
        self.held += len(run)
        if self.held > self.most:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        run, check, anchor, doc, place = self.levels.all()
        hot = _is_in(anchor, self.hot)
        for kind, own in ((RUN, ~hot), (HOT_RUN, hot)):
            if own.any():
                key = anchor[own] if kind == RUN else mix(anchor[own] ^ run[own])
                yield _rows(key, kind, doc[own], place[own], run[own], check[own])
        if self.repeats:
            doc, place = (np.concatenate(x) for x in zip(*self.repeats, strict=True))
            if len(doc):
                yield _rows(mix(doc.astype(np.uint64)), REPEAT, doc, place)
        self.levels, self.repeats, self.held = Levels(), [], 0


def hot_anchors(texts: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Anchors that many documents of a sample hold, sorted. A document counts each once a batch of texts."""
    rows = texts.count()
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own in pieces(batches, length):
            owner, _, _, anchors, _, _ = runs_of(own, length)
            pairs = np.unique(np.stack([anchors, owner.astype(np.uint64)], axis=1), axis=0)[:, 0]
            found, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], schema=schema)

    some = texts.sample(min(1.0, SAMPLE_ROWS / max(1, rows)), seed=1) if rows > SAMPLE_ROWS else texts
    counts = some.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_IN_SAMPLE)
    return np.sort(counts.select("anchor").toArrow().column(0).to_numpy().view(np.uint64))


def _run_rows(texts: DataFrame, length: int, piece: int, hot: np.ndarray) -> DataFrame:
    """Runs of all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(sent.value)
        for ids, offsets, own in pieces(batches, length, piece):
            owner, first, count, anchors, whole, check = runs_of(own, length)
            yield from sender.add(whole, check, anchors, np.array(ids, np.int64)[owner], (np.array(offsets, np.int64)[owner] + first) * 128 + count)
        yield from sender.end()

    return texts.mapInArrow(run, _ROWS_DDL)


def _settled_rows(rows: DataFrame, n: int) -> DataFrame:
    """Repeats, and runs to compare, of one slice of the order per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, hot = Levels(), Levels()
        for batch in batches:
            kind = np.asarray(batch.column("kind"))
            if (kind == REPEAT).any():
                yield batch.filter(pa.array(kind == REPEAT))
            for levels, own in ((plain, kind == RUN), (hot, kind == HOT_RUN)):
                if own.any():
                    key, whole, check, doc, place = (np.asarray(batch.column(c))[own] for c in ("key", "run", "check", "doc", "place"))
                    doc, place = levels.add(whole.view(np.uint64), check, key.view(np.uint64), doc, place)
                    if len(doc):
                        yield _rows(np.zeros(len(doc), np.int64), REPEAT, doc, place)
        anchor, doc, place = plain.unsettled()
        if len(doc):
            yield _rows(anchor, COMPARE, doc, place)
        _, _, anchor, doc, place = hot.all()
        if len(doc):
            yield _rows(anchor, HOT_COMPARE, doc, place)

    return rows.repartition(n, "key").mapInArrow(run, _ROWS_DDL)


def _window_rows(texts: DataFrame, length: int) -> DataFrame:
    """The windows of the runs to compare of texts(doc_id, text, places), one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(np.empty(0, np.uint64))
        for batch in slices(batches, "text", 1 << 20):
            parts: list[bytes] = []
            docs, starts, counts = [], [], []
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                for place in set(places):
                    docs.append(doc)
                    starts.append(place >> 7)
                    counts.append(place & 127)
                    parts.append(text[starts[-1] : starts[-1] + counts[-1] + length - 1])
            data = np.frombuffer(b"".join(parts), np.uint8)
            count = np.array(counts, np.int64)
            owner = np.repeat(np.arange(len(parts)), count)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            at = np.cumsum([0, *map(len, parts)])[owner] + within
            whole = mix(window_hashes(prefix_sums(data), at, at + length))
            yield from sender.add(whole, second_hashes(data, at, at + length), whole, np.array(docs, np.int64)[owner], (np.array(starts, np.int64)[owner] + within) * 128 + 1)
        yield from sender.end()

    return texts.mapInArrow(run, _ROWS_DDL)


def _block_rows(texts: DataFrame, length: int) -> DataFrame:
    """Blocks of windows of the runs to compare: (core hash, doc, first window, windows, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            keys, docs, firsts, counts, parts = [], [], [], [], []
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                done = set()
                for place in places:
                    start, count = place >> 7, place & 127
                    if place in done:
                        continue
                    done.add(place)
                    piece = np.frombuffer(text[start : start + count + length - 1], np.uint8)
                    sums, chosen = window_anchors(piece, length)
                    lefts = int(chosen[0]) - np.arange(count)  # bytes of each window before the anchor
                    for j in range(int(lefts[-1]) // BLOCK, int(lefts[0]) // BLOCK + 1):
                        own = np.flatnonzero(lefts // BLOCK == j)
                        a, b = int(own[0]), int(own[-1])
                        core = int(chosen[0]) - BLOCK * j
                        keys.append(window_hashes(sums, np.array([core]), np.array([core + length - BLOCK + 1]))[0])
                        docs.append(doc)
                        firsts.append(start + a)
                        counts.append(b - a + 1)
                        parts.append(piece[a : b + length].tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(np.array(keys, np.uint64)).view(np.int64)), pa.array(docs, pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int32()), pa.array(parts, pa.binary())],
                    names=["key", "doc", "first", "count", "part"],
                )

    return texts.mapInArrow(run, "key long, doc long, first long, count int, part binary")


_PAIR = pa.schema([("doc", pa.int64()), ("place", pa.int64())])


def _repeated_windows(blocks: DataFrame, n: int, length: int) -> DataFrame:
    """(doc, place) of windows that start earlier too, in a block with an equal core."""

    def shares_hash(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, keys: np.ndarray) -> bool:
        """Whether different windows, in order of their hashes, share one: equal hashes count only if the bytes are equal."""
        same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (keys[1:] == keys[:-1])) + 1
        return any(data[at[i] : at[i] + length].tobytes() != data[at[i - 1] : at[i - 1] + length].tobytes() for i in same.tolist())

    def settle(columns: list[np.ndarray], parts: list[bytes]) -> pa.RecordBatch | None:
        key, doc, first, count = columns
        total = int(count.sum())
        owner = np.repeat(np.arange(len(key)), count)
        offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        begins = np.cumsum([0, *map(len, parts)])[:-1]
        data = np.frombuffer(b"".join(parts), np.uint8)
        at = begins[owner] + offset
        hashes = window_hashes(prefix_sums(data), at, at + length)
        start = first[owner] + offset
        order = np.lexsort((start, doc[owner], hashes, key[owner]))
        if shares_hash(data, at[order], hashes[order], key[owner][order]):
            known: dict[bytes, int] = {}
            hashes = np.array([known.setdefault(data[a : a + length].tobytes(), len(known)) for a in at.tolist()], np.uint64)
            order = np.lexsort((start, doc[owner], hashes, key[owner]))
        k, h, d, s = key[owner][order], hashes[order], doc[owner][order], start[order]
        head = np.ones(total, bool)
        head[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        heads = np.maximum.accumulate(np.where(head, np.arange(total), 0))
        later = ~head & ~((d == d[heads]) & (s == s[heads]))
        if not later.any():
            return None
        d, s = d[later], s[later]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
        firsts = np.flatnonzero(new)
        runs = np.diff(np.append(firsts, len(d)))
        wide = np.flatnonzero(runs > 127)
        if len(wide):  # a place holds at most 127 windows
            firsts = np.unique(np.concatenate([firsts, *(firsts[i] + np.arange(0, runs[i], 127) for i in wide)]))
            runs = np.diff(np.append(firsts, len(d)))
        return pa.RecordBatch.from_arrays([pa.array(d[firsts]), pa.array(s[firsts] * 128 + runs)], schema=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # Whole keys at a time: what follows the last change of key waits for the next batch.
            key = np.asarray(batch.column("key"))
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1 if len(key) else np.empty(0, np.int64)
            if held and size > 20_000 and len(key):
                last = held[-1].column("key")[-1].as_py()
                stop = 0 if key[0] != last else int(cut[0]) if len(cut) else len(key)
                if stop < len(key):
                    held.append(batch.slice(0, stop))
                    out = done(held)
                    if out is not None:
                        yield out
                    held, size = [batch.slice(stop)], len(key) - stop
                    continue
            held.append(batch)
            size += len(key)
        out = done(held)
        if out is not None:
            yield out

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(held) if held else None
        if whole is None or not whole.num_rows:
            return None
        key = whole.column("key").to_numpy()
        _, back, many = np.unique(key, return_inverse=True, return_counts=True)
        whole = whole.filter(pa.array(many[back] > 1))
        if not whole.num_rows:
            return None
        return settle([whole.column(c).to_numpy() for c in ("key", "doc", "first", "count")], whole.column("part").to_pylist())

    return blocks.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "doc long, place long")


def repeated_places(docs: DataFrame, *, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(doc_id, places): first windows (times 128, plus their number) that repeat earlier ones."""
    spark = docs.sparkSession
    n = 4 * partitions_for(spark, 8)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = hot_anchors(texts, length)
    marks = stored(_settled_rows(_run_rows(texts, length, piece, hot), n).select("kind", "doc", "place"), "suffix-marks")

    def to_compare(kind: int) -> DataFrame:
        own = marks.where(F.col("kind") == kind).groupBy("doc").agg(F.collect_list("place").alias("places"))
        return texts.join(own.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "places")

    repeats = marks.where(F.col("kind") == REPEAT).select("doc", "place").union(_repeated_windows(_block_rows(to_compare(COMPARE), length), n, length))
    if len(hot):
        windows = _settled_rows(_window_rows(to_compare(HOT_COMPARE), length), n)
        repeats = repeats.union(windows.where(F.col("kind") == REPEAT).select("doc", "place"))
    return stored(repeats.groupBy(F.col("doc").alias("r_doc")).agg(F.collect_list("place").alias("places")), "suffix-repeats")


def removed_ranges(places: list[int] | None, length: int) -> np.ndarray:
    """Maximal removed byte ranges of a text from its repeated windows."""
    if not places:
        return np.empty((0, 2), np.int64)
    place = np.array(places, np.int64)
    starts = place >> 7
    ends = starts + (place & 127) + length - 1
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    lasts = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.stack([starts[new], ends[lasts]], axis=1)


def kept_bytes(text: bytes, ranges: np.ndarray) -> bytes:
    if not len(ranges):
        return text
    edges = [0, *ranges.reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_places(docs: DataFrame, length: int, piece: int) -> DataFrame:
    """docs with one further column, their repeated places."""
    doc, places = unused(docs, "r_doc"), unused(docs, "places")
    repeats = repeated_places(docs, length=length, piece=piece).toDF(doc, places).hint("shuffle_hash")
    return docs.join(repeats, docs["doc_id"].cast("long") == F.col(doc), "left").drop(doc)


def dedup_digests(docs: DataFrame, *, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """Per document: bytes, removed bytes, removed spans, and the digest of what is left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(as_bytes(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                ranges = removed_ranges(places, length)
                kept = kept_bytes(text or b"", ranges)
                rows.append((len(text or b""), len(text or b"") - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], schema=schema)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_places(picked, length, piece).select("doc_id", "text", "places").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """The documents with repeated passages cut out (a character cut in half goes too); documents of which
    nothing is left are dropped. All columns stay; n_chars, where there is one, follows the text."""
    own = docs.columns
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, places in zip(as_bytes(batch.column(at)), batch.column(len(own)).to_pylist(), strict=True):
                ranges = removed_ranges(places, length)
                texts.append(None if text is None else kept_bytes(text, ranges).decode("utf-8", "ignore") if len(ranges) else text.decode("utf-8", "replace"))
            emptied = np.array([bool(p) and not t for p, t in zip(batch.column(len(own)).to_pylist(), texts, strict=True)], bool)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays(columns, names=own).filter(pa.array(~emptied))

    joined = _with_places(docs, length, piece)
    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS g
  FROM d, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS t(i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM w),
r AS (
  SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM f WHERE again),
g AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM s),
x AS (
  SELECT d.doc_id, any_value(h) AS h, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || any_value(substr(h, 2 * last_b + 1)) AS kept
  FROM d JOIN (SELECT *, max(b) OVER (PARTITION BY doc_id) AS last_b FROM e) e USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, d.h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
