"""Vectorised text primitives for Arrow batches.

A chunk of texts becomes one array of code points. Words, lines and word
windows are then index arrays, and their identities 64-bit hashes, so that the
per-row cost in Python is a handful of calls however long the texts are.
Chunks are bounded by characters: memory follows ``CHUNK_CHARS``, or the one
text that is longer than it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

CHUNK_CHARS = 1 << 18
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` characters, or of one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def decode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a newline after each, and where each text starts."""
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=starts[1:])
    return cp, starts


@cache
def ascii_space() -> np.ndarray:
    """True at the characters that part words: blank and tab to carriage return."""
    table = np.zeros(0x110000, bool)
    table[[0x20, *range(9, 14)]] = True
    return table


@cache
def lower_table() -> np.ndarray:
    """Lower case code point by code point; what would change length stays."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1E944):
        c = chr(i).lower()
        if len(c) == 1:
            table[i] = ord(c)
    return table


@cache
def class_table() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x32400):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
        elif kind == "Z":
            table[i] = SPACE
    table[[*range(9, 14), 0x85]] = SPACE
    return table


@cache
def word_table() -> np.ndarray:
    """True at letters, marks and digits: the word characters of shingles."""
    table = np.isin(class_table(), (LETTER, NUMBER))
    for i in range(0x1E000):
        if unicodedata.category(chr(i))[0] == "M":
            table[i] = True
    return table


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS.get(base, (np.ones(0, np.uint64),) * 2)
    if len(up) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = up, down = np.cumprod(up), np.cumprod(down)
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span, alike wherever the span stands."""
    n = len(values)
    up, down = _powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where ``mask`` is true."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def window_hashes(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one text, and where they start."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    return span_hashes(words, at, at + k, _WORD_BASE), at


def words_of(cp: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text index and hash of each run of word characters."""
    s, e = runs(is_word[cp])
    return s, e, np.searchsorted(starts, s, "right") - 1, span_hashes(cp, s, e)


def ragged(flat_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices that lay the slices ``flat_start[i] : flat_start[i] + length[i]`` end to end."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(flat_start - (ends - length), length)


class WordCache:
    """Token ids by word hash, filled through ``encode`` and bounded in entries."""

    def __init__(self, encode, limit: int = 300_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def lookup(self, text: str, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct words end to end, their first place for each word, their count for each word)."""
        # As np.unique has it, but any place of a word serves, so the sort need not be stable.
        order = np.argsort(h)
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[order][1:] != h[order][:-1]
        uniq, first, back = h[order[fresh]], order[fresh], np.empty(len(h), np.int64)
        back[order] = np.cumsum(fresh) - 1
        if len(self.known) > self.limit:
            self.known.clear()
        known, keys = self.known, uniq.tolist()
        if new := [i for i, x in enumerate(keys) if x not in known]:
            s, e = start[first[new]].tolist(), end[first[new]].tolist()
            for i, ids in zip(new, self.encode([text[a:b] for a, b in zip(s, e)])):
                known[keys[i]] = np.asarray(ids, np.uint16).tobytes()
        parts = [known[x] for x in keys]
        n = np.fromiter(map(len, parts), np.int64, len(parts)) >> 1
        flat = np.frombuffer(b"".join(parts), np.uint16)
        at = np.cumsum(n) - n
        return flat, at[back], n[back]
