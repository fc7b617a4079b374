"""Whole batches of texts as numpy arrays: word bounds, word hashes and hashes of word windows, without a Python step per word.

Words are maximal runs of bytes outside space and tab..carriage return. All separators are ASCII, so working on UTF-8 bytes
gives the same words as working on code points. A word's hash is a polynomial over its bytes modulo 2**64 with a final mix; a
window's hash is a polynomial over its words' hashes with a final mix. All hashes are fixed, so every task computes the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[65:91] += np.uint64(32)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a well-known public hash (murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; kept per process and grown by doubling."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for b in (_BASE, inverse):
            t = np.ones(size, np.uint64)
            k = 1
            while k < size:
                t[k : 2 * k] = t[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            _powers.append(t)
    return _powers[0], _powers[1]


class Words:
    """starts, ends: byte bounds of all words of a batch; first: word index at which each text begins (n + 1 of them)."""

    def __init__(self, texts: pa.Array):
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.bytes = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(off) > 1 else np.zeros(0, np.uint8)
        self.offsets = off - off[0] if len(off) else np.zeros(1, np.int64)
        n = len(self.bytes)
        space = np.ones(n + 1, bool)
        np.take(_SPACE, self.bytes, out=space[:n])
        word = ~space[:n]
        cut = self.offsets[:-1][self.offsets[:-1] < n]
        edge = np.ones(n, bool)
        edge[1:] = space[: n - 1]
        edge[cut] = True
        self.starts = np.flatnonzero(word & edge)
        edge = space[1:].copy()
        cut = self.offsets[1:]
        edge[cut[(cut > 0)] - 1] = True
        self.ends = np.flatnonzero(word & edge) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def of(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False, block: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z."""
        value = _LOWER if lower else _SAME
        out = np.empty(len(self), np.uint64)
        i = 0
        while i < len(self):  # in blocks of whole words, so that the power tables stay small
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + block)))
            part = value[self.bytes[at : self.ends[j - 1]]]
            up, down = _tables(len(part) + 1)
            part *= up[: len(part)]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            out[i:j] = (total[e] - total[s]) * down[s]
            i = j
        return mix(out)

    def windows(self, words: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words that begin at each word, and whether the window ends inside its text."""
        n = len(words)
        out = np.zeros(n, np.uint64)
        ok = np.zeros(n, bool)
        m = n - k + 1
        if m > 0:
            for j in range(k):
                out[:m] += words[j : j + m] * np.uint64(pow(_BASE + 2 * salt, j + 1, 1 << 64))
            left = np.repeat(self.first[1:], np.diff(self.first))  # where the word's text ends
            ok = np.arange(n) + k <= left
        return mix(out ^ np.uint64((k * 0xD6E8FEB86659FD93 + salt) & _MASK)), ok


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)
