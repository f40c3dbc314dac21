"""The landed-feed stream processes every file once and matches the batch path."""
import json
import os

from tessera.sources import files as SRC
from tessera.streaming import feed as FS
from tessera.operators import text as TO


def test_feed_stream_matches_batch(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "landing")
    os.makedirs(land)
    for f in range(3):
        arts = [{"doc_id": f * 10 + i, "title": f"t{f}{i}", "content": "" if i == 2 else f"Body {f} {i}. More text."}
                for i in range(4)]
        with open(os.path.join(land, f"resp{f}.json"), "w") as fh:
            fh.write(json.dumps({"articles": arts}) + "\n")
    out, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    q = FS.write_stream(FS.tokenized_feed(spark, land, 16), out, ckpt)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    batch = TO.tokenize_pad(TO.nonempty(SRC.read_feed(spark, land, FS.FEED_SCHEMA)), "content", 16)
    assert got.count() == 9
    assert sorted((r.doc_id, tuple(r.input_ids)) for r in got.collect()) == \
        sorted((r.doc_id, tuple(r.input_ids)) for r in batch.collect())
