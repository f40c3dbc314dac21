"""Shards against a brute-force k-d tree over sorted rows; spans added by the labelers."""

import collections
import math
import random
import zlib

from tessera.llm import kdtree, pii
from tessera.session import ship_package


def _brute(rows, shards, whole_group=0.02):
    """Shard of each row (dicts of kdtree.points), by sorting each node."""
    dims = sorted(c for c in rows[0] if c[0] == "c" and c[1:].isdigit())
    total = sum(r["size"] for r in rows)
    slack, near = max(whole_group * total / shards, max(r["size"] for r in rows)) / 2, total / shards / 1000
    out = {}

    def split(part, k, first):
        if k == 1 or not part:
            out.update({id(r): first for r in part})
            return
        spans = [(min(r[d] for r in part), max(r[d] for r in part)) for d in dims]
        d = max(range(len(dims)), key=lambda i: (spans[i][1] - spans[i][0], -i))
        lo, hi = spans[d]

        def place(r):
            b = min(max(math.floor((r[dims[d]] - lo) * (4096 / (hi - lo) if hi > lo else 0.0)), 0), 4095)
            return b, math.floor(r["at"] * 4096), math.floor(r["at"] * 4096 ** 2) % 4096, math.floor(r["row_at"] * 4096)

        part = sorted(part, key=place)
        keys = [place(r) for r in part]
        goal, best = sum(r["size"] for r in part) * (k // 2) / k, (math.inf, 0)
        for depth in range(1, 5):
            run, ends = 0, [(goal, 0)]
            for i, r in enumerate(part):
                run += r["size"]
                if i + 1 == len(part) or keys[i][:depth] != keys[i + 1][:depth]:
                    ends.append((abs(run - goal), i + 1))
            best = min(best, min(ends))
            if best[0] <= (slack if depth == 3 else near):
                break
        split(part[:best[1]], k // 2, first)
        split(part[best[1]:], k - k // 2, first + k // 2)

    split(rows, shards, 0)
    return [out[id(r)] for r in rows]


def _table(spark, hot):
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 300)))
    rows = [(i, text(), rnd.choice(["en", "de", None]), rnd.choice(["web", "web", "book", "code", None]), "x", 1, 2.0) for i in range(400)]
    rows += [(400 + i, "hot text " * 20, "en", "web" if i % 2 else "book", "x", 1, 2.0) for i in range(hot)]
    rows += [(900, None, None, None, "x", 1, 2.0), (901, "", "en", "web", "x", 1, 2.0), (5, "twice", "en", "web", "x", 1, 2.0), (5, "twice", "en", "web", "x", 1, 2.0),
             (None, "no id", "en", "web", "x", 1, 2.0), (902, "long " * 3000, "fr", "book", "x", 1, 2.0)]
    # further columns named like the operator's own
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, node string, c0 int, at double").repartition(5)


def test_shards_equal_a_brute_force_tree(spark):
    for hot, shards in ((30, 3), (300, 12)):
        docs = _table(spark, hot)
        pts = kdtree.points(docs, ["lang", "source"], "doc_id", "text")
        rows = [r.asDict() for r in pts.collect()]
        want = sorted(zip(((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows), _brute(rows, shards)))
        got = kdtree.shard(docs, shards).collect()
        assert sorted(((r.doc_id or -1, r.size, r.text_crc32), r.shard) for r in got) == want
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_metadata_of_equal_texts_is_the_smallest(spark, monkeypatch):
    docs = _table(spark, 40)
    want = None
    for hot in (1, 16, 10 ** 9):  # all groups by shuffle, the large one by broadcast, all by broadcast
        monkeypatch.setattr(kdtree, "HOT", hot)
        got = sorted((str(r.doc_id), r.size, r.c1, r.c2) for r in kdtree.points(docs, ["lang", "source"], "doc_id", "text").collect())
        assert len(got) == docs.count() and (want is None or got == want)
        want = got
    assert len({x[2:] for x in got if x[1] == 196 and 400 <= int(x[0]) < 440}) == 1


def test_groups_of_equal_texts_are_cut_only_at_shard_borders(spark):
    got = kdtree.shard(_table(spark, 300), 12).collect()
    hot = [r for r in got if r.text_crc32 == zlib.crc32(("hot text " * 20).encode())]
    assert len(hot) == 300
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    own = collections.Counter(r.shard for r in hot)
    # the group fills whole shards; it shares at most the two at its ends
    assert sum(size[s] > n * 196 for s, n in own.items()) <= 2


def test_the_root_is_split_by_metadata(spark):
    docs = spark.createDataFrame([(i, f"text {i:05d}", "en", "ab"[i % 2]) for i in range(1000)], "doc_id bigint, text string, lang string, source string")
    source = {i: "ab"[i % 2] for i in range(1000)}
    sides = collections.defaultdict(set)
    for r in kdtree.shard(docs, 2).collect():
        sides[r.shard].add(source[r.doc_id])
    assert sorted(map(sorted, sides.values())) == [["a"], ["b"]]


def test_spans_of_further_kinds_are_found_and_decoys_left(spark):
    rnd = random.Random(4)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    up = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    mixed = lambda n: "".join(rnd.choice("abcdefghijkXYZ0123456789") for _ in range(n))
    good, bad = [], []
    for i in range(30):
        good += [("access_key", "AKIA" + up(16), "the {} here"), ("access_key", "ghp_" + mixed(36), "use {} now"), ("secret", hexes(40), 'token = "{}" and'),
                 ("secret", "Zq7" + mixed(12), "my password: {} ok"), ("name", rnd.choice(["Mary Miller", "Hans Meier", "José García"]), "Dear Dr. {} wrote"),
                 ("street", f"{i + 3} Old Mill Road", "we live at {} since"), ("street", f"Gartenstraße {i + 1}", "wohnt {} in")]
        bad += ["token = the word after it", "password: changeme", "at 5 o'clock the road was long", f"page {i} of the secret: nothing much", f"version 1.{i}.0 = release"]
    texts, want = [], []
    for kind, value, around in good:
        t = f"some words {around.format(value)} and more words"
        texts.append(t)
        want.append(f"{kind}:{t.index(value)}:{t.index(value) + len(value)}")
    rows = [(i, t, "x", i) for i, t in enumerate(texts + bad)] + [(None, texts[0], "x", 1), (0, texts[0], "x", 1), (7777, None, "x", 1)]
    ship_package(spark)
    got = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string, base string, n_ip int").repartition(4)).collect()
    assert len(got) == len(rows)
    added = collections.defaultdict(list)
    for r in got:
        added[r.doc_id].append(r.added)
    assert sum(w in added[i][0] for i, w in enumerate(want)) >= 0.9 * len(want)
    assert not any(added[i][0] for i in range(len(texts), len(texts) + len(bad)))
    assert added[None] == [added[0][0]] and len(added[0]) == 2 and added[7777] == [[]]


def test_spans_apart_equal_all_comparisons():
    rnd = random.Random(9)
    for _ in range(2000):
        spans = lambda n: [("k", a, a + rnd.randint(1, 9)) for a in (rnd.randint(0, 60) for _ in range(n))]
        more, base = [(*x, True) for x in spans(6)], spans(rnd.randint(0, 5))
        assert pii._apart(more, base) == [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]
