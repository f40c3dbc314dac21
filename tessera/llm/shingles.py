"""Word hashes, shingles and MinHash signatures, computed on the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.common import mix64

SHINGLE, _CHUNK, _TEXT_CHUNK = 5, 1 << 13, 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.cumprod(out)  # wraps


class _Powers:
    up, down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)


def word_hashes(data: np.ndarray, breaks: np.ndarray = _SPACE, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a byte array: a word is a run of bytes that are not ``breaks``.

    A running sum of value x base^position gives every word's polynomial by one subtraction;
    multiplying with base^-position makes it independent of where the word stands."""
    gap = np.concatenate([[True], breaks[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    _Powers.upto(len(data) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * _Powers.up[:len(data)])])
    h = (run[last] - run[first]) * _Powers.down[first]
    return mix64(h + (last - first).astype(np.uint64)), first


def chunks(texts: list[bytes], limit: int = _TEXT_CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together (a longer text stands alone)."""
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > limit:
            yield lo, i
            lo, held = i, 0
        held += len(t) + 1
    if texts:
        yield lo, len(texts)


def words_by_text(texts: list[bytes], breaks: np.ndarray = _SPACE, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin (texts + 1 numbers)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    h, first = word_hashes(data, breaks, values)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(first, starts)


def grams(h: np.ndarray, at: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of n words that lies in one text; ``short``: a text of fewer words is one run."""
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out, ok = np.zeros(max(0, len(h) - n + 1), np.uint64), None
    for i in range(n):
        out = out * _BASE + h[i:len(h) - n + 1 + i] if len(out) else out
    out = mix64(out)
    ok = owner[:len(out)] == owner[n - 1:] if len(out) else np.zeros(0, bool)
    out, who = out[ok], owner[:len(ok)][ok]
    if short and (few := np.flatnonzero((sizes > 0) & (sizes < n))).size:
        add = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            there = np.flatnonzero(sizes[few] > k)
            add[there] = add[there] * _BASE + h[at[few[there]] + k]
        out, who = np.concatenate([out, mix64(add + np.uint64(1))]), np.concatenate([who, few])
        order = np.argsort(who, kind="stable")
        out, who = out[order], who[order]
    return out, who


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingles of each text, one after the other, and where each text's begin."""
    g, who = grams(*words_by_text(texts), n, short=True)
    order = np.lexsort((g, who))
    g, who = g[order], who[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (who[1:] != who[:-1])])
        g, who = g[new], who[new]
    return g, np.searchsorted(who, np.arange(len(texts) + 1))


def seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of k hash functions, fixed for ever."""
    x = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:k] | np.uint64(1), x[k:]


def signatures(g: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """(texts, k) minima over each text's shingles (all ones where it has none), in bounded chunks."""
    a, b = seeds(k)
    out = np.full((len(at) - 1, k), np.iinfo(np.uint64).max)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for lo in range(0, len(g), _CHUNK):
        part, who = g[lo:lo + _CHUNK], owner[lo:lo + _CHUNK]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        h = part[:, None] * a + b
        h ^= h >> np.uint64(32)
        low = np.minimum.reduceat(h, first, axis=0)
        own = who[first]
        out[own] = np.minimum(out[own], low)
    return out
