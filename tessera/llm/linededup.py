"""Line dedup: lines that occur in many documents lose all their occurrences.

1. One scan sets each line key's bits in the filter for keys that two documents
   share (``twice``).  2. A second scan sends only suspected keys, as 128-bit
   hashes with their document: grouping them counts documents exactly (with map
   side partial counts, so a line in a third of all documents is no hot task) and
   picks the first document.  3. The documents that have such keys get them by a
   join on the row, and lose those lines.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
``keep_first`` leaves the first line of the first document (smallest id, then text
hash) in place.

Defined cases: a null or empty text is one empty line; empty keys are shorter than
``min_chars`` and always stay; a document is a row, so repeated rows count each;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, binary, text_of
from tessera.llm.twice import seen_twice, twice
from tessera.session import cut_lineage

_STRIP = SPACE.encode()
_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # of bytes: A-Z only


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.translate(None, _CONTINUATION)) >= min_chars)


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = set(map(line_key, text.split(b"\n")))
    keys.discard(b"")
    return keys if min_chars <= 1 else {k for k in keys if _long_enough(k, min_chars)}


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _suspects(bitmap, min_chars: int):
    def run(batches):
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(binary(batch.column(2))):
                own = list(_keys(text, min_chars))
                for k in np.flatnonzero(seen_twice(_hashes(own), bitmap.value.bitmap())).tolist():
                    rows.append(i)
                    keys.append(xxhash.xxh3_128_digest(own[k]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())], ["doc_id", "h", "key"])
    return run


def _cut(min_chars: int):
    def run(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, dropped, first in zip(binary(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if dropped:
                    gone, once, out = set(dropped), set(first or ()), []
                    for line in lines:
                        key = line_key(line)
                        h = xxhash.xxh3_128_digest(key) if _long_enough(key, max(1, min_chars)) else None
                        if h not in gone or h in once:
                            out.append(line)
                            once.discard(h)
                    n_dropped.append(len(lines) - len(out))
                    text = b"\n".join(out)
                else:
                    n_dropped.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])
    return run


def drop_frequent(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, bits: int = 1 << 28,
                  id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is left) per row of ``docs``."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    t = text_of(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("text"))
    bitmap = twice(rows, lambda b: (_hashes(_keys(x, min_chars)) for x in binary(b.column(2))), bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # bits / 8 bytes
    id_type = docs.schema[id_col].dataType.simpleString()
    found = cut_lineage(rows.mapInArrow(_suspects(shared, min_chars), f"doc_id {id_type}, h bigint, key binary"))
    often = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h")).alias("first")).filter(F.col("n") >= min_docs)
    hits = found.join(often, "key")
    is_first = F.col("first").eqNullSafe(F.struct("doc_id", "h")) & F.lit(keep_first)
    lists = hits.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(
        F.collect_set("key").alias("dropped"), F.collect_set(F.when(is_first, F.col("key"))).alias("first"))
    both = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return both.select("doc_id", "text", "dropped", "first").mapInArrow(
        _cut(min_chars), f"doc_id {id_type}, n_lines bigint, n_dropped bigint, text string")
