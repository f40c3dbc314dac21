"""The corpus pipeline on awkward tables: null, repeated and clashing ids, extra columns, no rows."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

PATH = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, node int, id bigint, tag string, seed double"


def _texts(n):
    rnd = random.Random(17)
    word = lambda: rnd.choice(["the", "of", "and", "to"] + ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(9)])
    return [" ".join(word() for _ in range(120 + 10 * i)) for i in range(n)]


def _run(spark, docs):
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, PATH), name)
        seen.append(docs)
    return seen, corpus_pipeline.STAGES[-1][1](spark, docs, PATH)


def test_awkward_ids_and_columns(spark):
    a, b, c, d, e = _texts(5)
    item = next(r.text for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    rows = [(None, a), (None, b), (7, a + " more"), (7, c), (8, c), (8, c), (9, d), (9, d), (9, e), (None, f"{e} {item} {d}"), (10, None), (None, ""), (11, "too short")]
    docs = spark.createDataFrame([(i, t, "en", "s" if k % 2 else None, len(t or ""), "h", 1, 2, "t", 0.5) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    (quality, deduped, clean, mixed), out = _run(spark, docs)
    assert all(x.columns == docs.columns for x in (quality, deduped, clean, mixed))
    of = lambda x: sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in x.select("doc_id", "text").collect()))
    long = [(i, t) for i, t in rows if t and len(t.split()) > 50]
    assert of(quality) == sorted((i is None, i or 0, t) for i, t in long)
    # one row of each different text; the near copy of a goes with it
    assert {x[2] for x in of(deduped)} >= {a, b, c, d, e} and len(of(deduped)) == 6
    assert {(x[1], x[2]) for x in of(deduped) if not x[0]} == {(7, c), (9, d), (9, e)}
    assert [x[2] for x in of(clean)] == [x[2] for x in of(deduped) if item not in x[2]]
    assert {x[2] for x in of(mixed)} <= {x[2] for x in of(clean)}
    assert out.count() == mixed.count() > 0


def test_no_rows(spark):
    seen, out = _run(spark, spark.createDataFrame([], SCHEMA))
    assert [x.count() for x in seen] == [0, 0, 0, 0] and out.count() == 0


def test_stages_take_no_notice_of_partitioning(spark):
    docs = spark.createDataFrame([(i % 7, t, "en", "s", 1, "h", 1, 2, "t", 0.5) for i, t in enumerate(_texts(12) * 3)], SCHEMA)
    key = lambda x: sorted(map(str, x.select("doc_id", F.md5("text").alias("t")).collect()))
    one, many = (_run(spark, docs.repartition(n))[0] for n in (1, 6))
    assert [key(x) for x in one] == [key(x) for x in many]
