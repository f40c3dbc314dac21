"""Packing of documents into sequences of a fixed number of tokens: bounded-space online best-fit.

1. Tasks encode whole texts and cut them into pieces: a document of more than ``limit`` tokens
   gives pieces of ``limit``, of which the first may be shorter.  Words with the white space
   before them are encoded apart, which changes nothing with a byte-level tokenizer that splits
   at white space, and each different one once per worker; texts with other white space than
   ASCII or with special tokens' brackets are encoded as they are.
2. Pieces (a few numbers each, no ids) are dealt evenly over tasks.  A task takes them in groups
   of about ``group`` sequences, the longest of a group first, and puts each into the open
   sequence that it fills best.  Open sequences are kept by their free space, and a bitset says
   which sizes of free space there are: the lowest set bit from the piece's length on is the best
   fit.  At most ``open_bins`` are open; if one more is needed the fullest closes.
3. ``sequences`` puts the ids of the pieces together, if they were asked for.

Defined cases: a null text is empty and has the end id alone; repeated rows and null ids are packed
each; ties go to the sequence opened last; a piece of ``limit`` tokens is a sequence of its own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binary, partitions, ragged, text_of
from tessera.llm.shingles import chunks
from tessera.session import cut_lineage

LIMIT, END_ID, OPEN_BINS, GROUP = 2048, 0, 4096, 4096
_CHUNK_BYTES, _CACHED_UNITS, _CACHED_BYTES = 1 << 22, 400_000, 1 << 24
_UNIT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Texts that are not cut into units: Unicode white space other than ASCII's, and special tokens' brackets.
_WHOLE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")


class UnitEncoder:
    """Texts to ids; the ids of a unit (white space and the word after it) are kept in a bounded cache."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self._reset()

    def _reset(self) -> None:
        encoder = self

        class Numbers(dict):
            def __missing__(self, unit):
                encoder.fresh.append(unit)
                self[unit] = n = len(self)
                return n

        self.numbers, self.fresh, self.held = Numbers(), [], 0
        self.numbers[None] = 0
        self.flat, self.sizes = np.array([self.end_id], np.uint32), np.array([1], np.int64)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, the end id after each text, and how many each text has."""
        units: list = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            units += [t] if _WHOLE.search(t) else _UNIT.findall(t)
            units.append(None)
            ends[i] = len(units)
        number = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        known, ids = len(self.sizes), len(self.flat)
        if self.fresh:
            flat, sizes = self._encoded(self.fresh)
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[number]
        out = self.flat[ragged(starts[number], size)]
        total = np.cumsum(size)[ends - 1]
        new = sum(map(len, self.fresh))
        if len(self.numbers) > _CACHED_UNITS or self.held + new > _CACHED_BYTES:
            if len(self.fresh) > 0.2 * len(units) and known > _CACHED_UNITS // 2:  # other texts than before
                self._reset()
            else:  # a full cache stays as it is
                for u in self.fresh:
                    del self.numbers[u]
                self.flat, self.sizes = self.flat[:ids], self.sizes[:known]
        else:
            self.held += new
        self.fresh.clear()
        return out, np.diff(total, prepend=0)


_ENCODERS: dict = {}


def _encoder(*key) -> UnitEncoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(*key)
    return _ENCODERS[key]


def cut(size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces of documents of ``size`` tokens: the first takes what is left over."""
    many = -(-size // limit)
    doc = np.repeat(np.arange(len(size)), many)
    piece = ragged(np.zeros(len(size), np.int64), many)
    first = size - (many - 1) * limit
    start = np.where(piece > 0, first[doc] + (piece - 1) * limit, 0)
    return doc, piece, start, np.where(piece > 0, limit, first[doc])


def _pieces(tokenizer: str, limit: int, end_id: int, with_ids: bool):
    def run(batches):
        encoder = _encoder(tokenizer, end_id)
        for batch in batches:
            texts = binary(batch.column(1))
            for lo, hi in chunks(texts, _CHUNK_BYTES):
                ids, size = encoder.encode(texts[lo:hi])
                doc, piece, start, length = cut(size, limit)
                data, at = ids.astype("<u4").tobytes(), (start + (np.cumsum(size) - size)[doc]).tolist()
                crc = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(at, length.tolist())]
                cols = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:  # the pieces lie one after another
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False,
           id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    return cut_lineage(rows.mapInArrow(_pieces(tokenizer, limit, end_id, with_ids), schema))


class OpenBins:
    """Online best-fit with at most ``most`` open bins of ``limit``, by free space; bit f of ``there`` is set if a bin has f left."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most, self.there = limit, most, 0
        self.bins: list[list[int]] = [[] for _ in range(limit + 1)]
        self.n_open = self.opened = 0

    def _take(self, free: int) -> int:
        out = self.bins[free].pop()
        if not self.bins[free]:
            self.there ^= 1 << free
        self.n_open -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes the piece, and what was in it."""
        fitting = self.there >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = self._take(free)
        else:
            if length < self.limit and self.n_open == self.most:
                self._take((self.there & -self.there).bit_length() - 1)  # the fullest closes
            own, free = self.opened, self.limit
            self.opened += 1
        left = free - length
        if left:
            if not self.bins[left]:
                self.there ^= 1 << left
            self.bins[left].append(own)
            self.n_open += 1
        return own, self.limit - free


def _place(limit: int, open_bins: int):
    def run(batches):
        bins, base = OpenBins(limit, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                                             [*batch.schema.names, "sequence_id", "offset"])
    return run


def place(rows: DataFrame, limit: int = LIMIT, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """``rows`` (pieces with their length, a written or checkpointed table) with sequence_id and offset."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (limit * group)))
    tasks = min(groups, partitions(spark))
    # row numbers of a written table are the same in every attempt; so are groups and order
    dealt = rows.withColumn("_n", F.monotonically_increasing_id()).repartition(tasks)
    dealt = dealt.withColumn("_g", F.pmod(F.xxhash64("_n"), F.lit(-(-groups // tasks)))).sortWithinPartitions("_g", F.desc("length"), "_n")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.select(rows.columns).mapInArrow(_place(limit, open_bins), f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, open_bins: int = OPEN_BINS, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return place(pieces(docs, tokenizer, limit, **options), limit, open_bins)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids of every sequence, from placed pieces with their ids (a sequence has ``limit`` ids at most)."""
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten(F.col("rows.ids")).alias("ids"))
