"""Removal of repeated byte strings through a run-length compressed suffix index.

Contract: every byte covered by a string of ``length`` bytes that also starts in a
document with a smaller id goes.  Matches are judged on the input and stay inside a
document.

0. Documents that equal one with a smaller id are covered whole; the rest is searched.
1. Anchors (``anchors``) cut each text into stretches such that equal strings of
   ``length`` bytes lie in stretches with equal anchors.  The "twice" filter keeps the
   anchors that two places share; only those stretches, 50 to 84 bytes each, are shuffled,
   by anchor.
2. A stretch that shares half its surroundings with no other one (``anchors.kin``) is a class
   of its own. The others a task indexes in blocks of whole anchor groups: suffix array by
   prefix doubling, Burrows-Wheeler transform, its runs, and the text positions sampled at
   run heads.  Matching statistics against the suffix before are computed by comparing
   bytes at the sampled run heads only and stream from there: along the text they fall by
   one per byte until the next sampled position.  Where they stay below ``length`` a new
   class of equal strings begins; its smallest document decides.
3. The covered ranges go to their documents, which lose those bytes.

Hot anchors, found on all documents of ``long_text`` bytes or more and one in ``hot_sample``
of the others, take another route to the same result: their occurrences are first reduced to
different stretches with the smallest id (partial aggregation) and only those are indexed.
A stretch that occurs once gets its ranges there.  The verdicts on the others are broadcast
in blocks of ``VERDICT_BLOCK``; the scan that sends the stretches of other anchors looks up
each stretch of a hot one and sends merged ranges a document, so no occurrence is ever a
row of a join, and the texts are read once however many blocks there are.  More than
``VERDICT_BLOCKS`` blocks of verdicts are joined by a shuffle instead.
The sample only decides the route, never the result.

A row is known by its doc_id and the 64-bit hash of its text.

Defined cases: a null text is empty; documents shorter than ``length`` keep everything;
rows under one doc_id do not match each other; a null doc_id is the smallest; repeated rows
lose the same bytes; removal may cut through a UTF-8 character, so what is left is binary; a long
text is cut into stretches alone; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import kin, stretches
from tessera.llm.common import binary, partitions, ragged, text_of
from tessera.llm.shingles import chunks
from tessera.llm.twice import MAX_BITS, seen_twice, twice
from tessera.session import cut_lineage

LENGTH, GRAM, BLOCK_BYTES = 50, 16, 1 << 21
#: A list of at most this many copies, about 40 MB, is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Anchors with about this many occurrences or more are hot; at most ``HOT_LIST`` (8 MB), the most frequent first.
HOT, HOT_SAMPLE, HOT_LIST, LONG_TEXT = 100_000, 100, 1_000_000, 1 << 18
#: Verdicts on this many hot stretches, about 30 MB, are broadcast at once, and so many times at most.
VERDICT_BLOCK, VERDICT_BLOCKS = 100_000, 8
_NO_ID = -(1 << 63)
_SPAN, _SPREAD = (1 << 31) - 1, (1 << 62) - 1
_END = 0xFF  # ends a stretch; no byte of UTF-8


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number (zeros behind the end)."""
    key = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        key = (key[:-size] << np.uint64(8 * size)) | key[size:]
    return key[:len(data)]


def suffix_array(data: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Start positions of all suffixes in order: 8 bytes at once, then prefix doubling of what is still tied."""
    n = len(data)
    key = _words(data) if words is None else words
    sa = np.argsort(key)
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    rank[n] = 0
    single = new & np.append(new[1:], True)
    todo = np.flatnonzero(~single)
    step, bits = 8, np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    while len(todo):
        pos = sa[todo]
        key = (rank[pos].astype(np.uint64) << bits) | rank[np.minimum(pos + step, n)].astype(np.uint64)
        if 3 * int(bits) <= 64:  # with its place a key is one number, whose sort is faster
            key = (key << bits) | np.arange(len(key), dtype=np.uint64)
            key.sort()
            pos, key = pos[(key & low).astype(np.int64)], key >> bits
        else:
            order = np.argsort(key)
            pos, key = pos[order], key[order]
        sa[todo] = pos
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[pos] = np.maximum.accumulate(np.where(new, todo + 1, 0))
        single = new & np.append(new[1:], True)
        todo = todo[~single]
        step *= 2
    return sa


class RunIndex:
    """Runs of the Burrows-Wheeler transform with the text position sampled at each run's head."""

    def __init__(self, data: np.ndarray):
        self.data, self.words = data, _words(data)
        self.sa = suffix_array(data, self.words)
        bwt = data[self.sa - 1]  # position 0 wraps to the last byte
        head = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        head |= self.sa == 0
        head[1:] |= self.sa[:-1] == 0
        self.runs = np.flatnonzero(head)
        self.symbols, self.samples = bwt[self.runs], self.sa[self.runs]

    def matching_statistics(self, limit: int) -> np.ndarray:
        """For each text position, how many bytes (up to ``limit``) its suffix shares with the suffix before it in order."""
        at, before = self.samples, self.sa[np.maximum(self.runs - 1, 0)]
        length = np.zeros(len(at), np.int64)
        later, n = self.runs > 0, len(self.data)
        length[later] = self._common(at[later], before[later], np.full(int(later.sum()), limit))
        # a full match at a head says "limit or more"; what follows it may not be derived from it
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        sampled = np.flatnonzero(place >= 0)
        order = place[sampled]
        value = length[order]
        stretch = np.diff(np.append(sampled, n))
        full = value >= limit
        out = np.repeat(sampled + value, stretch) - np.arange(n)
        if full.any():
            self._exact(out, sampled[full], stretch[full], limit, before[order][full])
        return np.minimum(np.maximum(out, 0), limit)

    def _exact(self, out: np.ndarray, sampled: np.ndarray, stretch: np.ndarray, limit: int, before: np.ndarray) -> None:
        """Heads whose match passes the limit: measure it on until it ends or its stretch is decided."""
        length = self._common(sampled, before, stretch + limit)
        at = ragged(sampled, stretch)
        out[at] = np.repeat(sampled + length, stretch) - at

    def _common(self, one: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes, up to ``most``, the suffixes at ``one`` and ``other`` share: 8 at once."""
        room = np.minimum(most, len(self.data) - np.maximum(one, other))
        length, live = np.zeros(len(one), np.int64), np.flatnonzero(room > 0)
        while len(live):
            differ = self.words[one[live] + length[live]] ^ self.words[other[live] + length[live]]
            same = np.full(len(live), 8)
            some = np.flatnonzero(differ)
            same[some] = sum((differ[some] < np.uint64(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8))
            length[live] += same
            live = live[(same == 8) & (length[live] < room[live])]
        return np.minimum(length, np.maximum(room, 0))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary array as one array of bytes, and where they begin and end in it."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def first_documents(parts: pa.Array, docs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest document with each window of stretches (all different, cut at anchors), as runs of windows of a stretch:
    where each stretch's runs begin and end, then the document, the first and the last window of each run."""
    text, ends = _bytes_of(parts)
    sizes = np.diff(ends)
    near = kin(text, ends, length, k)
    count, rows = np.ones(len(parts), np.int64), np.flatnonzero(near)
    if len(rows):
        part, *runs = _indexed(parts.take(pa.array(rows)), docs[rows], length)
        count[rows] = np.bincount(part)
    bounds = np.concatenate([[0], np.cumsum(count)])
    first, low, high = np.repeat(docs, count), np.zeros(bounds[-1], np.int64), np.repeat(sizes - length, count)  # alone: a class of its own
    if len(rows):
        first[np.repeat(near, count)], low[np.repeat(near, count)], high[np.repeat(near, count)] = runs
    return bounds, first, low, high


def _indexed(parts: pa.Array, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By the index of stretches, the runs of windows that have one smallest document: stretch, document, first and last window."""
    sizes = np.diff(_bytes_of(parts)[1])
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(bytes([_END]).join(parts.to_pylist()) + bytes([_END]), np.uint8)
    index = RunIndex(data)
    shared = index.matching_statistics(length)
    fresh = np.flatnonzero(shared[index.sa] < length)  # in suffix order, where a class begins
    low = np.minimum.reduceat(np.repeat(docs, sizes + 1)[index.sa], fresh)
    found = np.empty(len(data), np.int64)
    found[index.sa] = np.repeat(low, np.diff(np.append(fresh, len(data))))
    n = sizes - length + 1
    window = ragged(starts, n)
    first, part = found[window], np.repeat(np.arange(len(parts)), n)
    start = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (first[1:] != first[:-1])]))
    end = np.append(start[1:], len(part)) - 1
    return part[start], first[start], (window - starts[part])[start], (window - starts[part])[end]


def _covered(ids: np.ndarray, at: np.ndarray, part: np.ndarray, runs, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (``part`` of ``runs``, begun at ``at`` in document ``ids``) to what smaller documents cover of them: row, first byte, end byte."""
    bounds, first, low, high = runs
    n = bounds[part + 1] - bounds[part]
    run, row = ragged(bounds[part], n), np.repeat(np.arange(len(part)), n)
    keep = first[run] < ids[row]
    run, row = run[keep], row[keep]
    if not len(run):
        return row, row, row
    joins = np.concatenate([[False], (row[1:] == row[:-1]) & (run[1:] == run[:-1] + 1)])  # neighbouring runs are one range
    s, e = np.flatnonzero(~joins), np.flatnonzero(np.append(~joins[1:], True))
    return row[s], at[row[s]] + low[run[s]], at[row[s]] + high[run[e]] + length


def _anchors(length: int, k: int, long_text: int, weight: int):
    """Anchors of each chunk of texts with their number, times ``weight`` for sampled (short) texts."""
    def run(batches):
        for batch in batches:
            texts = binary(batch.column(1))
            for lo, hi in chunks(texts):
                h, text, _, _, _ = stretches(texts[lo:hi], length, k)
                times = np.where(np.array([len(t) for t in texts[lo:hi]]) >= long_text, 1, weight)[text]
                anchor, own = np.unique(_tag(h), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.bincount(own, times, len(anchor)).astype(np.int64))], ["anchor", "n"])
    return run


def _tag(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(24)).astype(np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _suspects(bitmap, length: int, k: int, hot=None, only_hot: bool = False, verdicts=()):
    """Stretches that the filter suspects: those of hot anchors (sorted array ``hot``), or all others.

    Beside the others go the ranges that ``verdicts`` cover, merged in each text, as rows without a part:
    both ends in ``at``, a negative anchor that follows the text's tag."""
    def run(batches):
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            texts = binary(batch.column(1))
            for lo, hi in chunks(texts):
                h, text, a, b, joined = stretches(texts[lo:hi], length, k)
                begin = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])]).astype(np.int64)
                keep = np.flatnonzero(seen_twice(h, bitmap.value.bitmap()))
                if hot is not None:
                    often = _among(_tag(h[keep]), hot.value)
                    found = keep[often]
                    keep = keep[often == only_hot]
                    if verdicts and len(found):
                        row, start, end = _merged(*_look_up(verdicts, ids[lo:hi][text[found]], a[found], b[found], joined, length), text[found])
                        if len(row):
                            none = pa.nulls(len(row), pa.binary())
                            start, end = start - begin[row], end - begin[row]
                            yield pa.RecordBatch.from_arrays([pa.array(-1 - (tags[lo:hi][row] & _SPREAD)), pa.array(ids[lo:hi][row]), pa.array(tags[lo:hi][row]),
                                                              pa.array(start << 31 | end), none], ["anchor", "id", "tag", "at", "part"])
                h, text, a, b = h[keep], text[keep], a[keep], b[keep]
                part = pa.array([joined[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_tag(h)), pa.array(ids[lo:hi][text]), pa.array(tags[lo:hi][text]), pa.array(a - begin[text]), part],
                                                 ["anchor", "id", "tag", "at", "part"])
    return run


def _look_up(verdicts, ids: np.ndarray, a: np.ndarray, b: np.ndarray, joined: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What blocks of verdicts cover of stretches a .. b: row, first byte, end byte."""
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[x:y]) for x, y in zip(a.tolist(), b.tolist())), "<u8").reshape(-1, 2)
    out = []
    for block in verdicts:
        part = block.value.find(digests)
        row = np.flatnonzero(part >= 0)
        hit, start, end = _covered(ids[row], a[row], part[row], block.value.runs, length)
        out.append((row[hit], start, end))
    return tuple(np.concatenate(c) for c in zip(*out))


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of a chunk's bytes, merged where they touch in one text: text, first byte, end byte."""
    order = np.argsort(start)
    own, start, end = text[row][order], start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > end[:-1])]) if len(own) else np.zeros(0, bool)
    return own[new], start[new], end[np.append(np.flatnonzero(new)[1:], len(own)) - 1] if len(own) else end


class Verdicts:
    """Verdicts on different stretches, found by their 128-bit hashes."""

    def __init__(self, parts: list[bytes], runs: list[list]):
        key = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<u8").reshape(-1, 2)
        order = np.lexsort((key[:, 1], key[:, 0]))
        self.low, self.high = key[order, 0], key[order, 1]
        self.ties = int(np.unique(self.low, return_counts=True)[1].max(initial=0))
        flat = np.array([r for i in order.tolist() for r in runs[i]], np.int64).reshape(-1, 3)
        self.runs = (np.concatenate([[0], np.cumsum([len(runs[i]) for i in order.tolist()])]).astype(np.int64), *flat.T.copy())

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 for none."""
        out = np.full(len(digests), -1)
        at = np.searchsorted(self.low, digests[:, 0])
        for step in range(self.ties):
            place = np.minimum(at + step, len(self.low) - 1)
            same = (self.low[place] == digests[:, 0]) & (self.high[place] == digests[:, 1])
            out[same] = place[same]
        return out


def _ranges(length: int, k: int, block_bytes: int):
    """Sorted rows (anchor, id, tag, at, part) to covered ranges (id, tag, a, b), a block of whole anchor groups at a time."""
    def cover(anchor, ids, tags, at, parts):
        out = []
        settled = int(np.searchsorted(anchor, 0))  # ranges without a part
        if settled:
            out.append((ids[:settled], tags[:settled], at[:settled] >> 31, at[:settled] & _SPAN))
            anchor, ids, tags, at, parts = (c[settled:] for c in (anchor, ids, tags, at, parts))
        if len(anchor):
            group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
            known = parts.dictionary_encode()
            own, different = known.indices.to_numpy().astype(np.int64), known.dictionary
            low = np.full(len(different), np.iinfo(np.int64).max)
            np.minimum.at(low, own, ids)
            # a stretch that shares its anchor with no other one is its own class
            of = np.zeros(len(different), np.int64)
            of[own] = group
            many = np.bincount(of, minlength=int(group[-1]) + 1)[of] > 1
            size = np.diff(_bytes_of(parts)[1])
            whole = ~many[own] & (ids > low[own])
            out.append((ids[whole], tags[whole], at[whole], (at + size)[whole]))
            listed = np.flatnonzero(many)
            if len(listed):
                place = np.full(len(different), -1)
                place[listed] = np.arange(len(listed))
                rows = np.flatnonzero(many[own])
                row, start, end = _covered(ids[rows], at[rows], place[own[rows]], first_documents(different.take(pa.array(listed)), low[listed], length, k), length)
                out.append((ids[rows[row]], tags[rows[row]], start, end))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "tag", "a", "b"])

    return lambda batches: _by_anchor(batches, block_bytes, cover)


def _by_anchor(batches, block_bytes: int, work):
    """``work`` on blocks of whole anchor groups; rows are sorted by anchor, the last column holds the stretches."""
    held: list = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size < block_bytes:
            continue
        rows = pa.Table.from_batches(held)
        anchor = rows.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
        if cut:
            yield work(*_columns(rows.slice(0, cut)))
        held = rows.slice(cut).combine_chunks().to_batches()
        size = sum(b.column(b.num_columns - 1).slice(0).nbytes for b in held) if cut else size
    rows = pa.Table.from_batches(held) if held else None
    if rows is not None and rows.num_rows:
        yield work(*_columns(rows))


def _columns(rows: pa.Table) -> list:
    return [*(c.to_numpy() for c in rows.columns[:-1]), pa.concat_arrays(rows.columns[-1].chunks)]


def _verdicts(length: int, k: int, block_bytes: int):
    """Sorted rows (anchor, n, id, tag, at, stretch), all stretches different, to the first document of every window:
    runs (first, a, b) of windows a .. b of the stretch. A stretch that occurs once keeps what is covered of it."""
    def judge(anchor, n, ids, tags, at, parts):
        bounds, first, low, high = first_documents(parts, ids, length, k)
        count = np.diff(bounds)
        keep = (first < np.repeat(ids, count)) | np.repeat(n > 1, count)
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        runs = pa.StructArray.from_arrays([pa.array(c[keep]) for c in (first, low, high)], ["first", "a", "b"])
        out = pa.RecordBatch.from_arrays([*map(pa.array, (anchor, n, ids, tags, at)), parts, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs)],
                                         ["anchor", "n", "id", "tag", "at", "part", "runs"])
        return out.filter(pa.array(np.diff(bounds) > 0))
    return lambda batches: _by_anchor(batches, block_bytes, judge)


def _hot_verdicts(spots: DataFrame, length: int, k: int, block_bytes: int) -> DataFrame:
    """Different stretches among ``spots`` (anchor, id, tag, at, part), how often they occur, and their runs; ids, tags and places hold for those that occur once."""
    different = spots.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("id", "tag", "at"))) \
        .select("anchor", "n", "id", "tag", "at", "part")
    verdicts = different.repartition(partitions(spots.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(
        _verdicts(length, k, block_bytes), "anchor bigint, n bigint, id bigint, tag bigint, at bigint, part binary, runs array<struct<first:bigint,a:bigint,b:bigint>>")
    return cut_lineage(verdicts)


def _runs_to_ranges(stretches: DataFrame, length: int) -> DataFrame:
    """Rows (id, tag, at, runs) to the ranges that smaller documents cover."""
    return stretches.select("id", "tag", "at", F.explode(F.filter("runs", lambda r: r["first"] < F.col("id"))).alias("r")) \
        .select("id", "tag", (F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b") + length).alias("b"))


def _blocks(verdicts: DataFrame, blocks: int) -> list:
    """Verdicts, broadcast in blocks; whole anchors go to a block, by their hash."""
    out = []
    for i in range(blocks):
        part = verdicts.filter(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == i) if blocks > 1 else verdicts
        held = part.select("part", F.transform("runs", lambda r: F.array(r["first"], r["a"], r["b"])).alias("runs")).collect()
        out.append(verdicts.sparkSession.sparkContext.broadcast(Verdicts([bytes(r["part"]) for r in held], [r["runs"] for r in held])))
    return out


def hot_anchors(rows: DataFrame, length: int, gram: int, hot: int, hot_sample: int, long_text: int = LONG_TEXT) -> np.ndarray:
    """Sorted anchors that occur about ``hot`` times or more, from all long texts and one other in ``hot_sample``."""
    some = rows.filter((F.pmod(F.xxhash64("id", "tag"), F.lit(hot_sample)) == 0) | (F.octet_length("text") >= long_text))
    counts = some.mapInArrow(_anchors(length, gram, long_text, hot_sample), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") >= hot).orderBy(F.desc("n"), "anchor").limit(HOT_LIST)
    return np.sort(np.array([r["anchor"] for r in often.select("anchor").collect()], np.int64))


def _remove(batches):
    for batch in batches:
        data, ends = _bytes_of(batch.column(1).cast(pa.binary()))
        size, begin, ranges = np.diff(ends), ends[:-1], batch.column(2)
        row = np.repeat(np.arange(len(size)), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        a, b = (c.to_numpy(zero_copy_only=False) + begin[row] for c in ranges.flatten().flatten())
        row, a, b = _merged(np.arange(len(row)), a, b, row)
        gone, spans = np.bincount(row, b - a, len(size)).astype(np.int64), np.bincount(row, minlength=len(size))
        # what stays and what goes by turns
        edges = np.concatenate([[0], np.stack([a, b], 1).reshape(-1), [len(data)]])
        left = data[np.repeat(np.tile([True, False], len(a) + 1)[:-1], np.diff(edges))]
        offsets = np.concatenate([[0], np.cumsum(size - gone)]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(left.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(gone), pa.array(spans), kept], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def filter_bits(n_bytes: int, length: int, gram: int) -> int:
    """About 16 bits an anchor, from 2**22 to the filter's bound."""
    wanted = 16 * n_bytes * 2 // (length - gram + 2)
    return min(MAX_BITS, max(1 << 22, 1 << (wanted - 1).bit_length() if wanted > 1 else 0))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES,
                   id_col: str = "doc_id", text: str = "text", gram: int = GRAM, hot: int = HOT, hot_sample: int = HOT_SAMPLE,
                   long_text: int = LONG_TEXT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (what is left, binary) per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), text_of(text).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))  # with the id, the row: several texts under one id keep their own ranges
    # whole copies of a text with a smaller id are covered from end to end, and need no search
    facts = cut_lineage(rows.select("id", "tag", F.unhex(F.md5("text")).alias("h"), F.octet_length("text").cast("bigint").alias("n")))
    first = facts.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    copies = cut_lineage(facts.filter(F.col("n") >= length).join(first, "h").filter(F.col("id") > F.col("first")).select("id", "tag", "n"))
    n_copies, n_bytes = copies.count(), facts.agg(F.sum("n")).first()[0] or 0
    known = copies.select("id", "tag").distinct()
    fresh = rows.join(F.broadcast(known) if n_copies <= BROADCAST_ROWS else known, ["id", "tag"], "left_anti").select("id", "text", "tag")

    def hashes(batch):
        texts = binary(batch.column(1))
        for lo, hi in chunks(texts):
            yield stretches(texts[lo:hi], length, gram)[0]

    bitmap = spark.sparkContext.broadcast(twice(fresh, hashes, filter_bits(n_bytes, length, gram)))
    often = spark.sparkContext.broadcast(hot_anchors(fresh, length, gram, hot, hot_sample, long_text))
    schema = "anchor bigint, id bigint, tag bigint, at bigint, part binary"
    settled, blocks = None, []
    if len(often.value):
        spots = fresh.mapInArrow(_suspects(bitmap, length, gram, often, True), schema)
        verdicts = _hot_verdicts(spots, length, gram, block_bytes)
        settled, shared = _runs_to_ranges(verdicts.filter("n = 1"), length), verdicts.filter("n > 1")
        n_blocks = -(-shared.count() // VERDICT_BLOCK)
        if n_blocks > VERDICT_BLOCKS:
            settled = settled.unionByName(_runs_to_ranges(spots.join(shared.select("anchor", "part", "runs"), ["anchor", "part"]), length))
        else:
            blocks = _blocks(shared, n_blocks)
    parts = fresh.mapInArrow(_suspects(bitmap, length, gram, often, False, blocks), schema)
    ranges = parts.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor") \
        .mapInArrow(_ranges(length, gram, block_bytes), "id bigint, tag bigint, a bigint, b bigint")
    if settled is not None:
        ranges = ranges.unionByName(settled)
    lists = ranges.groupBy(F.col("id").alias("r"), F.col("tag").alias("s")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    both = fresh.join(lists, (F.col("id") == F.col("r")) & (F.col("tag") == F.col("s")), "left").select("id", "text", "ranges")
    out = both.mapInArrow(_remove, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    out = out.unionByName(copies.select("id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"),
                                        F.lit(b"").alias("kept")))
    return out.select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def brute_force(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, tuple[int, int, str]]:
    """(n_removed, n_spans, sha256) per document, by a table of all strings; for tests."""
    first: dict = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][p:p + length], i)
    out = {}
    for i, t in texts.items():
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < i:
                mark[p:p + length] = b"\x01" * length
        spans = sum(1 for p in range(len(t)) if mark[p] and not (p and mark[p - 1]))
        out[i] = (sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(t, mark) if not m)).hexdigest())
    return out
