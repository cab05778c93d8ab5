"""Operator 9, BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so
every such pair in a word is a certain cut. Words are cut there, the fragments
are encoded independently, and their ids are concatenated. The result equals
encoding the whole word at once.

Texts are encoded a batch at a time. Of a batch, each distinct chunk between
white space is split into words once, and each distinct fragment is merged
once: fragments of one length are the rows of a matrix, and one step merges the
leftmost pair of the least rank in every row. Long fragments are merged one by
one with a heap, so that their cost is not quadratic. Ids are then gathered
back through the chunks to the texts as Arrow lists.

The vocabulary file is a parameter; nothing is trained.

Defined results: a null or empty text has no tokens and decodes to the empty
string; the strings of special tokens in a text become those tokens, as in the
reference library; repeated rows are encoded one by one; extra columns are
ignored by `encode_digests`; `encode_documents` takes doc_id and text, and lang
and source where the table has them (else they are null).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices, table

#: Text bytes encoded together; bytes from which a fragment is merged with a heap.
BATCH_BYTES, LONG = 8 << 20, 64
#: Ids that are joined to one string at a time.
PIECE_IDS = 1 << 26
_NO_RANK = np.iinfo(np.int32).max
_SPACE = 0x20
#: First letter of chunks that are one word, or a special token, as they stand; other chunks hold no white space.
_WORD, _SPECIAL = "\t", "\n"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _gather(lengths: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat) of the picked rows of a ragged table."""
    ends = np.cumsum(lengths)
    own = lengths[rows]
    shift = np.repeat(ends[rows] - np.cumsum(own), own)
    return own, flat[shift + np.arange(len(shift))]


def _summed(lengths: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of lengths between consecutive cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(lengths)])[cuts])


class ForcedBoundaryBpe:
    """A byte-level vocabulary with its merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.library = path, None
        self.ids: dict[str, int] = dict(model["vocab"])
        suffix = model.get("end_of_word_suffix") or ""
        self.chars = _byte_chars()
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.width = max(self.tokens) + 1
        self.names = pa.array([str(i) for i in range(self.width)])
        self.strings = pa.array([self.tokens.get(i, "") for i in range(self.width)])
        # Ids of bytes, inside a word and at its end.
        self.byte_ids = np.array([[self.ids[c + s] for c in self.chars] for s in ("", suffix)], np.int32)
        # Byte pairs inside tokens; the end of a word always belongs to its last byte.
        self.inside = np.zeros((256, 256), bool)
        self.inside[:, _SPACE] = True
        for token in self.ids:
            body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            own = [self.bytes[c] for c in body if c in self.bytes]
            self.inside[own[:-1], own[1:]] = True
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        pairs = np.array([self.ids[a] * self.width + self.ids[b] for a, b in merges], np.int64)
        self.order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.order]
        self.merged = np.array([self.ids[a + b] for a, b in merges], np.int32)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\t-\r\x85\p{Z}")
        self.words = regex.compile(pattern).findall
        self.words_and_ends = regex.compile(pattern + "|\n").findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _NO_RANK where they do not merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], _NO_RANK).astype(np.int32)

    def normal(self, text: str) -> str:
        # Letter by letter: no rule for a sigma at the end of a word.
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _odd_chunks(self, text: str) -> list[str]:
        """Chunks of a text with special tokens, unknown letters or control characters that only Python takes for space."""
        out = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(_SPECIAL + part)
            elif not part.isascii() and any(c > "՗" and unicodedata.category(c) == "Cn" for c in set(part)):
                # Letters that Python's tables do not know yet may be classed otherwise by the library: it cuts these texts.
                from tokenizers import Tokenizer

                own = self.library = self.library or Tokenizer.from_file(self.path)
                found = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(part))
                out += [_WORD + bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in found]
            else:
                out += [_WORD + w for w in self.words(self.normal(part))]
        return out

    def _is_odd(self, text: str) -> bool:
        if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return True
        return not text.isascii() and any(c > "՗" and unicodedata.category(c) == "Cn" for c in set(text))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """First bytes of the fragments of some words, each followed by a space."""
        new = np.ones(len(data), bool)
        new[1:] = (data[:-1] == _SPACE) | ~self.inside[data[:-1], data[1:]]
        return np.flatnonzero(new)

    def cut(self, word: bytes) -> list[bytes]:
        """Fragments of a word, cut where no token can reach across."""
        data = word + b" "
        at = [*self.cuts(np.frombuffer(data, np.uint8)).tolist(), len(data) - 1]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Merges of one fragment, with a heap of pairs over a linked list."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[i]), i) for i in np.flatnonzero(first != _NO_RANK)]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def rank(i: int, j: int) -> int:
            pair = (ids[i], ids[j])
            if pair not in known:
                known[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            return known[pair]

        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(i, j) != r:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(a, b)) != _NO_RANK:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def merge(self, fragments: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each fragment, all ids). A space at the end of a fragment marks the end of its word."""
        begins = np.frombuffer(fragments.buffers()[1], np.int32)[fragments.offset : fragments.offset + len(fragments) + 1].astype(np.int64)
        data = np.frombuffer(fragments.buffers()[2], np.uint8)
        last = data[begins[1:] - 1] == _SPACE
        sizes = np.diff(begins) - last
        out_owner, out_size, out_ids = [], [], []

        def start(rows: np.ndarray, size: int) -> np.ndarray:
            own = data[begins[rows][:, None] + np.arange(size)]
            ids = self.byte_ids[0][own]
            ids[:, -1] = np.where(last[rows], self.byte_ids[1][own[:, -1]], ids[:, -1])
            return ids

        def emit(rows: np.ndarray, ids: np.ndarray) -> None:
            if len(rows):
                out_owner.append(rows)
                out_size.append(np.full(len(rows), ids.shape[1]))
                out_ids.append(ids.reshape(-1))

        for row in np.flatnonzero(sizes > LONG):
            ids = np.array(self._merge_long(start(np.array([row]), int(sizes[row]))[0].tolist()), np.int32)
            emit(np.array([row]), ids[None, :])
        by_size = np.argsort(sizes, kind="stable")
        edges = np.searchsorted(sizes[by_size], np.arange(LONG + 2))
        largest = int(sizes[sizes <= LONG].max(initial=1))
        owner, ids, ranks = np.empty(0, np.int64), np.empty((0, largest), np.int32), np.empty((0, largest - 1), np.int32)
        for size in range(largest, 0, -1):
            fresh = by_size[edges[size] : edges[size + 1]]
            if len(fresh):
                new = start(fresh, size)
                owner, ids = np.concatenate([owner, fresh]), np.concatenate([ids, new])
                ranks = np.concatenate([ranks, self.ranks(new[:, :-1], new[:, 1:])])
            if size == 1:
                emit(owner, ids)
                break
            rows = np.arange(len(owner))
            at = ranks.argmin(axis=1) if len(rows) else rows  # the leftmost pair of the least rank
            least = ranks[rows, at]
            done = least == _NO_RANK
            emit(owner[done], ids[done])
            owner, ids, ranks, at, least = (x[~done] for x in (owner, ids, ranks, at, least))
            rows = np.arange(len(owner))
            columns = np.arange(size - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            ids[rows, at] = self.merged[least]
            columns = np.arange(size - 2)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 2)
            ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])
        lengths = np.zeros(len(fragments), np.int64)
        if not out_owner:
            return lengths, np.empty(0, np.int32)
        owner, size = np.concatenate(out_owner), np.concatenate(out_size)
        lengths[owner] = size
        back = np.empty(len(owner), np.int64)
        back[owner] = np.arange(len(owner))
        return _gather(size, np.concatenate(out_ids), back)

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, all ids)."""
        whole = [k for k, c in enumerate(chunks) if c[:1] in (_WORD, _SPECIAL)]
        words: list[str] = []
        if len(whole) < len(chunks):
            words = self.words_and_ends("\n".join([c for c in chunks if c[:1] not in (_WORD, _SPECIAL)]) + "\n")
        for k in whole:
            words += [chunks[k][1:], "\n"] if chunks[k][0] == _WORD else ["\n"]
        data = np.frombuffer((" ".join(words) + " ").encode() if words else b"", np.uint8)
        ends = data == 0x0A
        chunk_of = np.cumsum(ends)
        kept = ~ends
        kept[1:] &= ~ends[:-1]
        data, chunk_of = data[kept], chunk_of[kept]
        begins = self.cuts(data)
        edges = pa.array(np.append(begins, len(data)).astype(np.int32))
        fragments = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, edges.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        lengths, ids = _gather(*self.merge(fragments.dictionary), fragments.indices.to_numpy()) if len(begins) else (np.empty(0, np.int64), np.empty(0, np.int32))
        order = [k for k, c in enumerate(chunks) if c[:1] not in (_WORD, _SPECIAL)] + whole
        cuts = np.searchsorted(chunk_of[begins], np.arange(len(chunks) + 1))
        counts = _summed(lengths, cuts)
        special = [(place, k) for place, k in enumerate(order) if chunks[k][:1] == _SPECIAL]
        if special:
            ids = np.insert(ids, np.cumsum(counts)[[p for p, _ in special]], [self.special[chunks[k][1:]] for _, k in special]).astype(np.int32)
            counts[[p for p, _ in special]] = 1
        back = np.empty(len(chunks), np.int64)
        back[order] = np.arange(len(chunks))
        return _gather(counts, ids, back)

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        texts = [t or "" for t in texts]
        odd = [k for k, t in enumerate(texts) if self._is_odd(t)]
        plain = pc.utf8_split_whitespace(pa.array([self.normal(t) for t in (texts if not odd else [t for t, o in zip(texts, np.isin(np.arange(len(texts)), odd)) if not o])], pa.string()))
        lists = pa.concat_arrays([plain, pa.array([self._odd_chunks(texts[k]) for k in odd], pa.list_(pa.string()))])
        if not len(lists):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        chunks = lists.flatten().dictionary_encode()
        lengths, ids = self.of_chunks(chunks.dictionary.to_pylist())
        lengths, ids = _gather(lengths, ids, chunks.indices.to_numpy())
        counts = _summed(lengths, np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]))
        if not odd:
            return counts, ids
        order = np.concatenate([np.setdiff1d(np.arange(len(texts)), odd), odd]).astype(np.int64)
        back = np.empty(len(texts), np.int64)
        back[order] = np.arange(len(texts))
        return _gather(counts, ids, back)

    def joined(self, names: pa.Array, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The names of the ids of each text, joined by one space."""
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(ends, names.take(pa.array(ids))), " ")

    def digests(self, names: pa.Array, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """SHA-256 of `joined`; a text of very many ids is joined in pieces."""
        if len(ids) <= PIECE_IDS:
            return pa.array([hashlib.sha256(x).hexdigest() for x in self.joined(names, counts, ids).cast(pa.binary()).to_pylist()], pa.string())
        out, ends = [], np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            digest = hashlib.sha256()
            for at in range(a, b, PIECE_IDS):
                own = ids[at : min(b, at + PIECE_IDS)]
                digest.update((b" " if at > a else b"") + self.joined(names, np.array([len(own)]), own)[0].as_py().encode())
            out.append(digest.hexdigest())
        return pa.array(out, pa.string())

    def encode(self, text: str | None) -> list[int]:
        return self.of_texts([text])[1].tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def loaded(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: number of tokens, and digests of the ids and of the decoded text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            counts, ids = bpe.of_texts(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), *(bpe.digests(x, counts, ids) for x in (bpe.names, bpe.strings))]
            yield pa.RecordBatch.from_arrays(columns, schema=_DIGEST)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, lang, source, the token ids, and the text decoded from them."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            counts, ids = bpe.of_texts(batch.column("text").to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [
                *(batch.column(c) for c in ("doc_id", "lang", "source")), pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), bpe.joined(bpe.strings, counts, ids),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    own = {c.lower() for c in docs.columns}
    picked = docs.select(F.col("doc_id").cast("long"), *((F.col(c) if c in own else F.lit(None)).cast("string").alias(c) for c in ("text", "lang", "source")))
    return picked.mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, token_ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds `decoded`, the text of the column token_ids."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def decoded(ids):  # noqa: ANN001, ANN202
        bpe = loaded(path)
        return ids.map(lambda x: bpe.decode(list(x)) if x is not None else "")

    return encoded.withColumn("decoded", decoded("token_ids"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
