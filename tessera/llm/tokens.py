"""Token ids in fixed-width packed blocks.

File format: a Parquet table, one row per block, parts in ascending document
order.  Columns ``part``, ``block``, ``start`` (ids of the part before the block),
``n_ids`` and ``payload``.  The payload is little-endian:

    4 bytes  magic "TSB1"        1 byte  id width in bits (the minimum for the vocabulary)
    4 bytes  number of documents 8 bytes number of ids
    documents x (1 byte id is there, 8 bytes doc_id)
    (documents + 1) x 8 bytes    offsets: ids before each document, in the block
    ids, ``width`` bits each, lowest bit first, padded to whole groups of 64 ids

Id k of a block is at bit k x width, so ``unpack`` reads any range of ids with a
few vector operations, and ``block`` / ``start`` let a reader fetch one block.
A block closes at 65,536 ids; a longer document has a block of its own.

The tokenizer sees each different word once per worker.  With the vocabulary file used
here (lower case, words apart, marks apart from letters) the ids of a text are those of
its words, in lower case and without a full stop or comma behind a letter, which is a
word of its own; only texts with special tokens' brackets or combining marks are split
as they are.  ``split_words=False`` encodes whole texts, for any other tokenizer.

Defined cases: a null text is empty and has the end id alone; rows are ordered by
doc_id (null first), then by text hash, so ties and repeated rows keep a fixed
order; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import binary, partitions, ragged, shared_path, text_of
from tessera.llm.shingles import chunks

BLOCK_IDS, END_ID, MAGIC = 65536, 1, b"TSB1"
_CACHED_WORDS, _CHUNK_BYTES = 500_000, 1 << 22
_HEAD = struct.Struct("<4sBIQ")
BLOCK_SCHEMA = "part int, block int, start bigint, n_ids bigint, payload binary"


_MARK = re.compile(rb"(?<=[A-Za-z])([.,])(?=[ \t-\r]|\Z)")


def words_of(text: bytes) -> list[bytes]:
    if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
        return text.split()
    return _MARK.sub(rb" \1", text.lower()).split()


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width as groups of 64: ``width`` little-endian words a group."""
    n = -(-len(ids) // 64)
    grid = np.zeros(n * 64, np.uint64)
    grid[:len(ids)] = ids
    grid = grid.reshape(n, 64)
    out = np.zeros((n, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= grid[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, width: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from number ``first`` on; only the groups that hold them are read."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    count = len(words) * 64 - first if count is None else count
    lo, hi = first // 64, -(-(first + count) // 64)
    words = words[lo:hi]
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[first - lo * 64:][:count]


def to_block(doc_ids: list, ids: np.ndarray, lens: np.ndarray, width: int) -> bytes:
    there = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype("<u8")
    return b"".join([_HEAD.pack(MAGIC, width, len(doc_ids), len(ids)), there.tobytes(), numbers.tobytes(),
                     offsets.tobytes(), pack(ids, width)])


def from_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, offsets and all ids of a block."""
    magic, width, docs, n = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    there = np.frombuffer(payload, np.uint8, docs, at)
    numbers = np.frombuffer(payload, "<i8", docs, at + docs)
    offsets = np.frombuffer(payload, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
    ids = unpack(payload[at + 17 * docs + 8:], width, 0, n)
    return [int(d) if t else None for d, t in zip(numbers, there)], offsets, ids


class Encoder:
    """Texts to ids through a word cache of bounded size; each text ends with ``end_id``."""

    def __init__(self, path: str, end_id: int = END_ID, split_words: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.width = width_for(self.tokenizer.get_vocab_size())
        self.end_id, self.split_words = end_id, split_words
        self._reset()

    def _reset(self) -> None:
        encoder = self

        class Index(dict):
            def __missing__(self, word):
                encoder.fresh.append(word)
                self[word] = n = len(self)
                return n

        self.index, self.fresh = Index(), []
        self.flat, self.lens = np.array([self.end_id], np.uint32), np.array([1], np.int64)
        self.index[None] = 0

    def _learn(self) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in self.fresh], add_special_tokens=False)
        ids = [e.ids for e in found]
        self.lens = np.concatenate([self.lens, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32)])

    def _forget(self, words: int, ids: int, looked_up: int) -> None:
        """A full cache stays as it is: words beyond it are dropped again.  It starts anew once they are many."""
        if len(self.fresh) > 0.2 * looked_up and words > _CACHED_WORDS:
            return self._reset()
        if len(self.index) > _CACHED_WORDS:
            for w in self.fresh:
                del self.index[w]
            self.lens, self.flat = self.lens[:words], self.flat[:ids]
        self.fresh = []

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        if not self.split_words:
            ids = [e.ids + [self.end_id] for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        known, flat = len(self.lens), len(self.flat)
        words: list = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            words += words_of(t)
            words.append(None)
            ends[i] = len(words)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self._learn()
        starts = np.cumsum(self.lens) - self.lens
        per_word = self.lens[numbers]
        upto = np.cumsum(per_word)[ends - 1]
        out = self.flat[ragged(starts[numbers], per_word)]
        self._forget(known, flat, len(words))
        return out, np.diff(upto, prepend=0)


_ENCODERS: dict = {}


def _encoder(*key) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def _blocks(path: str, end_id: int, split_words: bool, block_ids: int):
    def run(batches):
        encoder = _encoder(path, end_id, split_words)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs, kept, lens, held = [], [], [], 0

        def flush():
            nonlocal docs, kept, lens, held, block, start
            ids = np.concatenate(kept)
            payload = to_block(docs, ids, np.array(lens, np.int64), encoder.width)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                                              pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                                             ["part", "block", "start", "n_ids", "payload"])
            block, start, docs, kept, lens, held = block + 1, start + len(ids), [], [], [], 0
            return out

        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), binary(batch.column(1))
            for lo, hi in chunks(texts, _CHUNK_BYTES):
                ids, n = encoder.encode(texts[lo:hi])
                ends = np.cumsum(n)
                for k, (doc, size) in enumerate(zip(numbers[lo:hi], n.tolist())):
                    if docs and held + size > block_ids:
                        yield flush()
                    docs.append(doc)
                    kept.append(ids[ends[k] - size:ends[k]])
                    lens.append(size)
                    held += size
        if docs:
            yield flush()
    return run


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID,
          split_words: bool = True, block_ids: int = BLOCK_IDS) -> str:
    """Encode ``docs`` in ascending id order and write the blocks to ``path``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_blocks(tokenizer, end_id, split_words, block_ids), BLOCK_SCHEMA).write.parquet(path)
    return path


def _documents(batches):
    for batch in batches:
        for base, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            numbers, offsets, ids = from_block(payload)
            data, at = ids.astype("<u4").tobytes(), offsets.tolist()
            crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)),
                                              pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the file: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row per part: bounded by the number of parts, not by the ids
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("base") + F.col("start")).alias("base"), "payload")
    return placed.mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write to a new path in the shared folder, and read the files back."""
    spark = docs.sparkSession
    return read(spark, write(docs, shared_path(spark, "tokens"), tokenizer, **options))
