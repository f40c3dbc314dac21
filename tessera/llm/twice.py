"""Two Bloom filters, for hashes seen once and seen twice, over all rows.

``twice`` returns a filter that holds every hash which two documents share.  Each
task sends the bits it sets, sorted, as steps in segments of 65,536 bits (about one byte
a bit after Spark's compression, instead of 8 a hash); a bit set by two documents is set in the
"twice" filter.  Segments merge independently and at once, so no task sees more than its share;
the driver gets them compressed.

The filter's size is a parameter.  A fuller filter lets more hashes through as
suspects, and every caller confirms suspects exactly, so the size decides the
traffic and never the result.  ``MAX_BITS`` bounds what is broadcast (128 MB).
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions
from tessera.session import cut_lineage

SEGMENT, MAX_BITS = 1 << 16, 1 << 30
_HOLD, _FETCHES = 1 << 21, 8


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.uint32), ((hashes >> np.uint64(32)) & mask).astype(np.uint32)


def _steps(at: np.ndarray, segments: np.ndarray) -> pa.Array:
    """Sorted positions as one value a segment: 16-bit offsets as differences, all low bytes before all high bytes (mostly zeros)."""
    starts = np.searchsorted(at, segments.astype(np.uint64) << np.uint64(16))
    n = np.diff(np.append(starts, len(at)))
    d = np.diff(at, prepend=at[:1]).astype(np.uint16)
    d[starts[n > 0]] = at[starts[n > 0]] & 0xFFFF
    low = np.arange(len(at)) + np.repeat(starts, n)
    out = np.empty(2 * len(at), np.uint8)
    out[low] = d & 0xFF
    out[low + np.repeat(n, n)] = d >> 8
    offsets = 2 * np.append(starts, len(at)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(segments), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _offsets(steps: pa.Array) -> np.ndarray:
    """The offsets in all values of ``steps``, one value after the other."""
    if not len(steps):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(steps.buffers()[1], np.int32)[steps.offset:steps.offset + len(steps) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(0, np.int64)
    data = np.frombuffer(steps.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    starts, n = (ends[:-1] - ends[0]) // 2, np.diff(ends) // 2
    low = np.arange(len(data) // 2) + np.repeat(starts, n)
    d = data[low] | data[low + np.repeat(n, n)].astype(np.int64) << 8
    run = np.concatenate([[0], np.cumsum(d)])
    return run[1:] - np.repeat(run[starts], n)


def _sender(hashes_of, bits: int):
    def run(batches):
        held, n = [], 0

        def flush():
            at = np.concatenate(held)
            at.sort()
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            many, at = np.diff(np.append(first, len(at))) > 1, at[first]
            segments = (at >> 16).astype(np.int32)
            segments = segments[np.concatenate([[True], segments[1:] != segments[:-1]])]
            return pa.RecordBatch.from_arrays([pa.array(segments), _steps(at, segments), _steps(at[many], segments)], ["segment", "once", "again"])

        for batch in batches:
            for hashes in hashes_of(batch):
                for p in positions(hashes, bits):
                    held.append(p)
                    n += len(p)
                if n >= _HOLD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
    return run


def _merge(batches):
    now, counts = None, None

    def packed():
        bits = np.packbits(counts > 1, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(bits, 1)], pa.binary())], ["segment", "bits"])

    for batch in batches:
        segments = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]])) if len(segments) else segments
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(segments)).tolist()):
            if segments[lo] != now:
                if now is not None:
                    yield packed()
                now, counts = int(segments[lo]), np.zeros(SEGMENT, np.int64)
            counts += np.bincount(_offsets(batch.column(1).slice(lo, hi - lo)), minlength=SEGMENT)
            counts[_offsets(batch.column(2).slice(lo, hi - lo))] = 2
    if now is not None:
        yield packed()


class Filter:
    """A filter as it is broadcast: compressed by segment, opened once in each worker."""

    _open: dict = {}

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.key, self.bits, self.segments = uuid.uuid4().hex, bits, segments

    def bitmap(self) -> np.ndarray:
        if self.key not in self._open:
            self._open.clear()
            out = np.zeros((self.bits // SEGMENT, SEGMENT // 8), np.uint8)
            for segment, data in self.segments.items():
                out[segment] = np.frombuffer(zlib.decompress(data), np.uint8)
            self._open[self.key] = out.reshape(-1)
        return self._open[self.key]


def twice(docs: DataFrame, hashes_of, bits: int) -> Filter:
    """``hashes_of(batch)`` yields an array of different 64-bit hashes per document.
    Returns the "twice" filter (bits / 8 bytes, whatever the input)."""
    if bits > MAX_BITS or bits % SEGMENT or bits & (bits - 1):
        raise ValueError(f"bits must be a power of two from {SEGMENT} to {MAX_BITS}")
    sent = docs.mapInArrow(_sender(hashes_of, bits), "segment int, once binary, again binary")
    merged = sent.repartition(partitions(docs.sparkSession), "segment").sortWithinPartitions("segment") \
        .mapInArrow(_merge, "segment int, bits binary")
    # merged by all tasks at once, then fetched in a few parts: at most bits / 65,536 rows of 8 KB
    fetched = cut_lineage(merged).coalesce(_FETCHES).toLocalIterator(prefetchPartitions=True)
    return Filter(bits, {row["segment"]: bytes(row["bits"]) for row in fetched})


def seen_twice(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for p in positions(hashes, 8 * len(bitmap)):
        out &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out
