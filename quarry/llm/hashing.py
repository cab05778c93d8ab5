"""Vectorised hashes of byte windows and words, in bounded pieces."""

from __future__ import annotations

import numpy as np

_GEN = np.random.RandomState(20240601)
#: A random 64-bit value for each byte, and an odd multiplier with its inverse modulo 2**64.
BYTE_VALUES = _GEN.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
#: Other values, for a second hash of the same bytes.
CHECK_VALUES = np.random.RandomState(20240602).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(3)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"up": _powers(BASE, 1), "down": _powers(BASE_INVERSE, 1)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, PIECE + (1 << 16))
        _POWERS["up"], _POWERS["down"] = _powers(BASE, size), _powers(BASE_INVERSE, size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Sums from which the hash of any window follows; one longer than data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:-1], out=out[1:])
    return out


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand."""
    _, down = powers(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, read in pieces cut between words."""
    if len(text) <= PIECE:
        return _piece_words(text)
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        if to < len(text):
            cut = max(text.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut < 0 and to < len(text):  # a word longer than a piece
                to = min(len(text), to + PIECE)
                cut = max(text.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            to = cut + 1 if to < len(text) or cut >= 0 and to < len(text) else len(text)
        out.append(_piece_words(text[at:to]))
        at = to
    return np.concatenate(out)


def _piece_words(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    return mix(window_hashes(prefix_sums(data), starts, ends) + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of `size` consecutive words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k]
    return np.unique(mix(out))
