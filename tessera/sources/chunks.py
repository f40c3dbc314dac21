"""Column-chunk files of a matrix, read once, with a report of each file beside its cells.

``scan_chunks`` reads files whole (``binaryFile``, one row a file); ``parse_chunks`` turns
(path, content) rows into long cells.  A task checks a file to its end before it gives
any cell, so a damaged one gives none, and says why in its report row.  Cells and reports come
from one read: ``cells_of`` and ``report_of`` split the same written rows.

Memory of a task: one file as it is stored, one line, and ``BLOCK`` cells; lines and widths
may be of any size (files up to 2 GB, the limit of the reader).
"""

from __future__ import annotations

import csv
import gzip
import io
import sys
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage, ship_package

BLOCK = 1 << 16
SCHEMA = "path string, reason string, n_rows bigint, n_features bigint, n_bad bigint, patient_id string, feature string, beta double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
ARROW = [TYPES[c.split()[1]] for c in SCHEMA.split(", ")]
#: Cells that stand for a missing number.
MISSING = frozenset(("", "NA", "N/A", "NaN", "nan", "NULL", "null"))


def _lines(content: bytes, encoding: str, delimiter: str):
    """Records of a file; gzip is known by its first two bytes."""
    raw = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        raw = gzip.GzipFile(fileobj=raw)
    return csv.reader(io.TextIOWrapper(raw, encoding=encoding, newline=""), delimiter=delimiter, strict=True)


def _number(text: str) -> tuple[float | None, bool]:
    """The value, and whether the text is neither a number nor a mark of a missing one."""
    text = text.strip()
    if text in MISSING:
        return None, False
    try:
        return float(text), False
    except ValueError:
        return None, True


def check(content: bytes, encoding: str = "utf-8", delimiter: str = ",") -> tuple[str | None, list[str], int]:
    """(why the file cannot be used or None, features, rows), having read it to its end."""
    csv.field_size_limit(sys.maxsize)
    n = 0
    try:
        lines = _lines(content, encoding, delimiter)
        header = next(lines, None)
        if header is None:
            return "empty file", [], 0
        if len(header) < 2:
            return "no features", [], 0
        if len(set(header[1:])) < len(header) - 1:
            return "repeated feature", [], 0
        for line in lines:
            if not line:
                continue
            n += 1
            if len(line) > len(header):
                return f"row {n}: {len(line)} fields, {len(header)} expected", [], 0
            if not line[0]:
                return f"row {n}: no key", [], 0
    except UnicodeDecodeError:
        return f"not {encoding}", [], 0
    except (OSError, EOFError, zlib.error):
        return "damaged compression", [], 0
    except csv.Error as e:
        return f"row {n + 1}: {e}", [], 0
    return None, header[1:], n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW)], NAMES)


def _parse(encoding: str, delimiter: str):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                reason, features, n = check(content or b"", encoding, delimiter)
                bad, rows = 0, []
                if reason is None:
                    lines = _lines(content, encoding, delimiter)
                    next(lines)
                    for line in lines:
                        if not line:
                            continue
                        for j, name in enumerate(features):
                            value, wrong = _number(line[j + 1]) if j + 1 < len(line) else (None, False)
                            bad += wrong
                            rows.append((path, None, None, None, None, line[0], name, value))
                            if len(rows) == BLOCK:
                                yield _batch(rows)
                                rows = []
                rows.append((path, reason, n, len(features), bad, None, None, None))
                yield _batch(rows)
    return run


def parse_chunks(files: DataFrame, path: str = "path", content: str = "content", encoding: str = "utf-8", delimiter: str = ",") -> DataFrame:
    """Rows of cells and of reports (see ``cells_of``, ``report_of``), written once.

    A file holds a header (key column, features) and one line a patient.  Lines shorter than the
    header lack their last values (null); a value that is no number is null and counted in
    ``n_bad``.  A file is refused whole (reason, no cell) if it is empty (or null),
    damaged, not in ``encoding``, without features or with a repeated one, or if a line is longer than
    the header, lacks its key or leaves a quote open."""
    ship_package(files.sparkSession)
    return cut_lineage(files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(_parse(encoding, delimiter), SCHEMA))


def cells_of(parsed: DataFrame) -> DataFrame:
    """path, patient_id, feature, beta of the files that could be used."""
    return parsed.filter("n_rows is null").select("path", "patient_id", "feature", "beta")


def report_of(parsed: DataFrame) -> DataFrame:
    """One row a file: path, reason (null: used), n_rows, n_features, n_bad."""
    return parsed.filter("n_rows is not null").select("path", "reason", "n_rows", "n_features", "n_bad")


def scan_chunks(spark: SparkSession, folder: str, names: Sequence[str] | None = None, **options) -> DataFrame:
    """``parse_chunks`` of a folder's files, a task a file at most; contents are not shuffled.

    Of ``names`` those that the folder lacks are reported; the reader does not list files without
    a byte, so they count as lacking."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "content")
    if names is None:
        return parse_chunks(files, **options)
    parsed = parse_chunks(files.filter(F.col("path").isin(list(names))), **options)
    lacking = spark.createDataFrame([(n,) for n in sorted(set(names))], "path string").join(report_of(parsed), "path", "left_anti")
    zero = F.lit(0).cast("bigint")
    return parsed.unionByName(lacking.select("path", F.lit("no such file, or empty").alias("reason"), zero.alias("n_rows"), zero.alias("n_features"),
                                             zero.alias("n_bad")), allowMissingColumns=True)
