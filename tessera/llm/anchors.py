"""Content-defined anchors: every run of ``length`` bytes holds one, and equal runs hold equal ones.

The anchor of a window is its k-byte gram with the smallest hash (the rightmost of ties),
which depends on the window's bytes alone.  Neighbouring windows mostly share an anchor,
so a text has about 2 / (length - k + 2) anchors a byte, and all windows of one anchor
are one stretch of the text."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import mix64, ragged

_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BASE = 0x9E3779B97F4A7C15
#: Windows are taken in blocks whose arrays stay in a core's cache; positions in a block take the low bits of a key.
_BLOCK, _LOW = 1 << 15, np.uint64((1 << 21) - 1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on (k a sum of powers of two, by doubling)."""
    part, size, out, done = _BYTES[data], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = part
            else:  # out covers ``done`` bytes, part the next ``size``
                n = len(part) - done
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done:done + n]
            done += size
        if done == k:
            return mix64(out[:len(data) - k + 1])
        n = len(part) - size
        part = part[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2


def stretches(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(anchor hash, text, first byte, end byte) of each stretch, and the joined texts.

    Bytes count from the joined texts' start; the windows of a stretch start at first,
    .., end - length."""
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    empty = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return np.zeros(0, np.uint64), empty, empty, empty, joined
    data = np.frombuffer(joined, np.uint8)
    # which bytes begin a window that ends in the same text
    inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([np.maximum(sizes - length + 1, 0), np.minimum(sizes, length - 1)], 1).reshape(-1))
    width, last = length - k + 1, -1
    begins, hashes = [], []
    for x in range(0, len(data) - length + 1, _BLOCK):
        h = gram_hashes(data[x:x + _BLOCK + length - 1], k)
        key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[:len(key) - (width - span)], key[width - span:])
        here = inside[x:x + len(key)]
        new = here.copy()
        new[1:] &= (key[1:] != key[:-1]) | ~here[:-1]
        new[0] &= x + int(_LOW - (key[0] & _LOW)) != last or not inside[x - 1]
        last = x + int(_LOW - (key[-1] & _LOW))
        new = np.flatnonzero(new)
        at = (_LOW - (key[new] & _LOW)).astype(np.int64)
        begins.append(new + x)
        hashes.append(h[at])
    lo = np.concatenate(begins)
    text = np.searchsorted(ends, lo, side="right")
    hi = np.minimum(np.append(lo[1:] - 1, len(data)), ends[text] - length) + length
    return np.concatenate(hashes), text, lo, hi, joined


def kin(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> np.ndarray:
    """Which stretches (different ones, that begin and end at ``ends`` in ``data``) may share a window with another.

    The anchor of a shared window stands at one place in it, so on one side of the anchor at least half
    of the rest is shared too: those bytes and the anchor, by their hash, must occur in two stretches."""
    starts, sizes = ends[:-1], np.diff(ends)
    spare, half = sizes - length, (length - k) // 2
    h = gram_hashes(data, k)
    n = length - k - spare + 1  # grams that all windows of the stretch hold
    begin = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(begin, n)
    key = (h[ragged(starts + spare, n)] & ~_LOW) | (_LOW - place.astype(np.uint64))
    at = spare + (_LOW - (np.minimum.reduceat(key, begin) & _LOW)).astype(np.int64)
    left, right = np.flatnonzero(at >= half), np.flatnonzero(spare > at - half)
    before = gram_hashes(data, k + half)
    behind = before if k + half == length - half else gram_hashes(data, length - half)
    side = np.concatenate([before[(starts + at)[left] - half], ~behind[(starts + at)[right]]])
    order = np.argsort(side)
    same = side[order][1:] == side[order][:-1]
    out = np.zeros(len(sizes), bool)
    out[np.concatenate([left, right])[order[np.append(same, False) | np.append(False, same)]]] = True
    return out
