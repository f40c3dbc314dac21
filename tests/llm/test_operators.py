"""The corpus operators against brute force, on hand-made rows with every awkward case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import anchors, decontam, forest, graph, kdtree, linededup, mixing, pii, quality, queries, rindex, shingles, tokens, twice, urls
from tessera.session import ship_package

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, row string, size int, node int, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)] + ["the", "of", "and"] * 20
    line = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, passage = line(120), line(40)
    out = [base, base, base + " tail", "x " + base, base.replace(" ", "  ", 3), passage + "\n" + line(80), line(30) + "\n" + passage + "\n" + line(30)]
    words = base.split()
    words[60] = "edited"
    out += [" ".join(words), " ".join(words[:60]), line(4000) + "\n" + passage, "", "   \n\t", None, "one", "one", "a b c d", "É é \u0130 naïve\n" * 30]
    out += ["the same line\n" * 5 + line(20) for _ in range(12)] + [" The SAME line \t\n" + line(60)] + [line(rnd.randint(1, 200)) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 1, "r", 2, 3, "x") for i, t in enumerate(_texts())]
    return out + [out[5], out[5]] + [(None, "no id here " * 20, "en", "s1", 1, 1, "r", 2, 3, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer
    path = queries.word_tokenizer()
    tok = Tokenizer.from_file(path)
    want, start = [], 0
    for i, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for options in ({}, {"block_ids": 50}, {"split_words": False}):
        got = [tuple(r) for r in tokens.encode(docs, path, **options).collect()]
        assert sorted(got, key=lambda r: r[1]) == want


def test_words_are_encoded_like_texts():
    from tokenizers import Tokenizer
    path, rnd = queries.word_tokenizer(), random.Random(2)
    tok, own = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["".join(rnd.choice("aAbZéÉßİΣσ.,'’…!?- \n\u0331\u0301hH<|endoftext|>1\x1c\u00a0 ") for _ in range(30)) for _ in range(2000)]
    ids, n = own.encode([t.encode() for t in texts])
    for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert part.tolist() == tok.encode(t, add_special_tokens=False).ids + [1], repr(t)


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_pack_random_access(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    data = tokens.pack(x, width)
    assert len(data) == 8 * width * 16 and (tokens.unpack(data, width, 0, 1000) == x).all()
    assert (tokens.unpack(data, width, 333, 77) == x[333:410]).all()
    doc_ids, offsets, ids = tokens.from_block(tokens.to_block([3, None], x[:10], np.array([4, 6]), width))
    assert doc_ids == [3, None] and offsets.tolist() == [0, 4, 10] and (ids == x[:10]).all()


def test_kdtree_is_balanced_gapless_and_keeps_copies(docs, rows):
    out = kdtree.shard(docs, 4).collect()
    size = {r[0]: len((r[1] or "").encode()) + 16 for r in rows}
    assert len(out) == len(rows) and all(r.size == size[r.doc_id] for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert sorted(by) == [0, 1, 2, 3]
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    total = sum(r.size for r in out)
    assert max(sum(r.size for r in x) for x in by.values()) <= total / 4 + max(size.values())
    crc = collections.defaultdict(set)
    for r in out:
        crc[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in crc.values())
    assert {r.text_crc32 for r in out if r.doc_id == 12} == {0}  # the null text


def test_line_dedup(docs, rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    n = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    for min_docs, min_chars in ((2, 1), (10, 1), (2, 4)):
        got = {r.doc_id: r for r in linededup.drop_frequent(docs, min_docs, min_chars, bits=1 << 16).collect()}
        for r in rows:
            lines = (r[1] or "").split("\n")
            kept = [x for x in lines if not (len(key(x)) >= min_chars and n[key(x)] >= min_docs)]
            assert (got[r[0]].n_lines, got[r[0]].n_dropped, got[r[0]].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    first = {r.doc_id: r.text for r in linededup.drop_frequent(docs, 10, keep_first=True).collect()}
    assert sum(t.lower().count("the same line") for t in first.values()) == 1


def _pii_brute(t):
    def luhn(d):
        v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in v) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = []
    for kind, p, ok in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
                        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
                        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
                        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])]
    return out


def test_personal_data_base_equals_the_patterns():
    rnd = random.Random(1)
    for _ in range(5000):
        t = "".join(rnd.choice("a1.@-+ 2(9)5_%é") for _ in range(40))
        base = sorted(pii.spans_of(t)[0], key=lambda x: (pii.BASE.index(x[0]), x[1]))
        assert [f"{k}:{a}:{b}" for k, a, b in base] == _pii_brute(t)


def test_personal_data_adds_likely_spans_and_is_linear(spark):
    good = ["call me, phone (415) 555-2671 today", "my iban is DE89370400440532013000", "mail jane.doe [at] example [dot] com", "ssn 219-09-9999"]
    text = [f"{g} number {i}" for i in range(20) for g in good] + ["reach a@b.org ip 10.0.0.1 card 4111 1111 1111 1111 or +1 415 555 2671"] * 20
    text += ["version 12.300.4.5 and 1234 5678 9012 3456", "a" * 300_000, "1" * 300_000, "+" * 1000, "a@" * 50_000, None, ""]
    out = pii.find(spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")).collect()
    added = collections.Counter(s.split(":")[0] for r in out for s in r.added)
    assert added == {"phone_local": 20, "iban": 20, "email_text": 20, "ssn": 20}
    assert all(r.base == _pii_brute(text[r.doc_id]) for r in out if text[r.doc_id] and len(text[r.doc_id]) < 1000)
    assert not any(r.base or r.added for r in out if r.doc_id >= len(text) - 7 and len(text[r.doc_id] or "") < 1000)


def test_votes_recover_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    right = [0.95, 0.8, 0.7, 0.6]
    votes = np.array([np.where(rng.random(20000) < q, np.where(truth, 1, -1), np.where(truth, -1, 1)) for q in right]).T
    p, rates, share = pii.fit_votes(votes, np.ones(len(votes)))
    assert abs(share - 0.4) < 0.05 and ((p > 0.5) == truth).mean() > 0.9
    assert rates[1, 0, 0] > rates[1, 1, 0] > rates[1, 3, 0]


def test_url_rules_and_trees(spark):
    base = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2#f", "http://x.com/fr/1", "http://x.com/de/1", "http://org",
            "ftp:nothing", None, "http://notorg/x", "x://y.org?p=/de/", "", "http://example.org:80/es/"]
    many = [f"http://www.casino-win-{i % 9}.example.net/p/{i}?a={i}&b=1" for i in range(200)] + [f"https://news{i % 9}.example.org/fr/{i}" for i in range(200)]
    new = [f"http://www.free-lotto-{i}.example.net/p/{i}?a={i}&b=1" for i in range(30)] + [f"https://news{i}.example.info/fr/{i}" for i in range(30)]
    urls_ = base + many + new
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string")).collect()}
    assert [got[i].rule for i in range(12)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, None]
    assert (got[0].host, got[0].path, got[7].host, got[6].path, got[9].host, got[9].path) == ("a.example.org", "/es/1", "", "", "y.org", "")
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    held_out = [got[len(base) + len(many) + i].verdict == ("block" if i < 30 else "allow") for i in range(60)]
    assert sum(held_out) >= 57
    none = urls.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")).collect()
    assert [(r.verdict, r.score) for r in none] == [("allow", None)]


def test_url_statistics_cover_all_labels_and_a_hot_url_leaves_the_sample_whole(spark, monkeypatch):
    pages = [(100 * s + i, f"http://h{i}.s{s:02d}/p/{i}") for s in range(40) for i in range(10)]
    labels = [(p, s % 2, 0) for p, _ in pages for s in [p // 100]]  # even suffixes are of low quality
    # half of the rows are one URL, whose hash is the lowest
    order = spark.createDataFrame([(f"http://hot{i}.s00/p/1",) for i in range(5000)], "u string").orderBy(F.xxhash64("u")).first()[0]
    pages += [(10_000 + i, order) for i in range(400)]
    labels += [(10_000 + i, 0, 0) for i in range(400)]
    new = [(20_000 + s, f"http://hx.s{s:02d}/p/x") for s in range(40)]
    df = spark.createDataFrame(pages + new, "page_id bigint, url string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for limit in (32 << 20, -1):  # rates broadcast, and joined by shuffle
        monkeypatch.setattr(urls, "BROADCAST_BYTES", limit, raising=False)
        got = {r.page_id: r.verdict for r in urls.judge(df, marks, sample=60).collect()}
        assert len(got) == len(pages + new)
        assert [got[20_000 + s] for s in range(40)] == ["allow" if s % 2 else "block" for s in range(40)]


def test_url_labels_do_not_reach_their_own_features(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(8))
    # random labels: nothing to learn, so labelled URLs are not reproduced
    pages = [(i, f"http://{word()}.net/{word()}/{word()}") for i in range(2000)]
    labels = [(i, rnd.randint(0, 1), 0) for i in range(2000)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string"), marks).collect()}
    assert sum(got[i] == ("allow" if q else "block") for i, q, _ in labels) < 1400
    # a clean signal (many digits) with 10 % wrong labels, each in a segment of its own
    def url(bad):
        return f"http://{word()}.net/{word()}/" + ("".join(rnd.choice("0123456789") for _ in range(12)) if bad else word() + word())
    kinds = [rnd.random() < 0.5 for _ in range(2400)]
    pages = [(i, url(b)) for i, b in enumerate(kinds)]
    labels = [(i, int(b if rnd.random() < 0.1 else not b), 0) for i, b in enumerate(kinds[:2000])]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string"), marks).collect()}
    right = [got[i] == ("block" if b else "allow") for i, b in enumerate(kinds)]
    assert sum(right[2000:]) > 360 and sum(right[:2000]) > 1800


def test_url_entropy_is_of_the_whole_host(spark):
    rnd = random.Random(1)
    hosts = ["", "a", "aab", "é" * 5 + "x", "".join(rnd.choice("abcdefghij") for _ in range(3000)) + "z" * 500]
    df = spark.createDataFrame([(f"http://{h}/p",) for h in hosts], "u string").selectExpr("u", "'' as path", "regexp_extract(u, '^http://([^/]*)', 1) as host")
    for h, r in zip(hosts, urls.lexical(df).collect()):
        n = collections.Counter(h)
        assert abs(r.entropy - -sum(c / len(h) * np.log2(c / len(h)) for c in n.values())) < 1e-9


def _classes(texts):
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for t in texts]
    return sets


def test_forest_join_equals_brute_force(docs, rows):
    first = {}
    for r in sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        first.setdefault(r[1] or "", r[0])
    texts = list(first)
    sets, n, root = _classes(texts), collections.Counter(), {t: t for t in texts}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(texts):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                n[a] += 1
                n[texts[j]] += 1
                x, y = sorted((find(a), find(texts[j])), key=lambda t: (first[t] is not None, first[t] or 0))
                root[y] = x
    copies = collections.Counter(r[1] or "" for r in rows)
    for block in (256, 2):  # in one block, and block against block
        for r in forest.classes(docs, block=block).collect():
            t = next(x[1] or "" for x in rows if x[0] == r.doc_id)
            assert (r.class_id, r.copy_id, r.n_copies, r.n_links) == (first[find(t)], first[t], copies[t], n[t])
    kept = forest.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({first[find(t)] for t in texts}, key=str)


def test_near_duplicates_go_by_text_not_by_id(spark):
    rnd = random.Random(6)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    x, y, z = text(), text(), text()
    near = x + " more"
    rows = [(None, x), (None, y), (7, near), (7, z), (8, z), (7, z), (9, None), (10, "")]
    df = spark.createDataFrame([(i, t, 1, "g", 2, b"h") for i, t in rows], "doc_id bigint, text string, node int, grp string, id int, h binary").repartition(3)
    got = sorted((str(r.doc_id), r.text or "") for r in forest.keep(df).collect())
    assert got == sorted([("None", x), ("None", y), ("7", z), ("9", "")])
    assert forest.keep(df).columns == df.columns
    links = {(r.doc_id, r.class_id, r.copy_id, r.n_copies, r.n_links) for r in forest.classes(df).collect()}
    assert links == {(None, None, None, 1, 1), (7, None, 7, 1, 1), (None, None, None, 1, 0), (7, 7, 7, 3, 0), (8, 7, 7, 3, 0), (9, 9, 9, 2, 0), (10, 9, 9, 2, 0)}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {i: 1 for i in range(2, 61)} | {i: 1000 for i in range(1001, 1100)}


def test_depth_meets_the_recall():
    assert forest.depth_for(0.8, 18, 8, 0.9999) == 4 and forest.depth_for(0.8, 64, 8, 0.9999) > 4
    with pytest.raises(ValueError):
        forest.depth_for(0.1, 2, 8, 0.9999)


def test_decontamination_finds_exact_and_edited_passages(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(90, None), (91, "too short"), (92, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for i, t in items[:20]:
        w = t.split()
        for _ in range(4):
            w[rnd.randrange(30)] = "swap"
        del w[rnd.randrange(30)]
        docs += [(3 * i, f"{filler(40)}\n{t.upper()}. {filler(9)}"), (3 * i + 1, f"{filler(5000)} {' '.join(w)}, {filler(3)}"), (3 * i + 2, f"{filler(60)} {' '.join(t.split()[:9])}")]
        want |= {(3 * i, i), (3 * i + 1, i)}
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block_words in (2_000_000, 50):
        got = [(r.doc_id, r.item_id) for r in decontam.contaminated(df, it, block_words=block_words).collect()]
        assert set(got) == want and got.count((0, 0)) == 2
    assert {r.doc_id for r in decontam.keep(df, it).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.contaminated(df, it.limit(0)).count() == 0


def test_decontamination_finds_one_edited_copy_in_many_documents(spark):
    item = [f"w{i}" for i in range(40)]
    edited = " ".join("swap" if i % 5 == 4 else w for i, w in enumerate(item))  # 16 of 38 3-grams are left; (32 - 3.5) / 40
    short = [f"s{i}" for i in range(8)]
    lone = " ".join("swap" if i in (3, 6) else w for i, w in enumerate(short))  # one 3-gram is left
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id bigint, text string")
    docs = [(i, f"{'before ' * i}{edited} after {lone}") for i in range(25)] + [(100 + i, f"only w{i} w{i + 1} w{i + 2} stands here") for i in range(30)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == sorted((i, *x) for i in range(25) for x in ((1, 0.7125), (2, 0.625)))


def test_decontamination_finds_copies_with_long_insertions(spark):
    item = [f"w{i}" for i in range(40)]
    before, foreign = ["before"] * 10, [f"x{i}" for i in range(40)]
    docs = [(n, " ".join(before + item[:20] + foreign[:n] + item[20:] + before)) for n in (0, 25, 36, 37)]
    docs += [(100, " ".join(["w0 w1 w2"] * 500 + item[:10] + foreign[:8] + item[10:30] + foreign[:8] + item[30:]))]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    assert sorted((r.doc_id, r.score, r.start_word, r.end_word) for r in got) == [
        (0, 1.0, 10, 50), (25, 0.6875, 10, 75), (36, 0.55, 10, 86), (100, 0.8, 1500, 1556)]


def test_decontamination_equals_all_alignments(spark):
    rnd = random.Random(21)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [words(n) for n in (1, 2, 3, 4, 5, 8, 10, 11, 12, 13, 20, 20, 40, 41)]
    docs = [words(rnd.randint(0, 120)) for _ in range(60)]
    for item in items[2:]:
        broken = [x for i, w in enumerate(item) for x in ([w, "foreign"] if i % 2 else [w])]  # a foreign word after every two
        sparse = [x for i, w in enumerate(item) for x in ([w, "odd"] if rnd.random() < 0.8 else [w])]
        docs += [words(20) + broken + words(5), words(3) + sparse, [w for w in item if rnd.random() < 0.8] + words(9), words(4) + item * 2]
    docs += [docs[-1], []]
    df = spark.createDataFrame([(i, " ".join(d), "x", 1) for i, d in enumerate(docs)], "doc_id bigint, text string, item_id string, seed int").repartition(3)
    it = spark.createDataFrame([(i, " ".join(t), "d") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    number = {w: i for i, w in enumerate({w for d in docs + items for w in d})}
    code = lambda ws: np.array([number[w] for w in ws], np.int64)
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            score = decontam.smith_waterman(code(t), code(d))[0] / len(t) if d else 0
            if len(t) >= 3 and score >= 0.55:
                want[i, j] = score
    for block_words in (2_000_000, 90):
        got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, it, block_words=block_words).collect()}
        assert got == want and len(want) > 40


def test_decontamination_keeps_rows_by_id_and_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(None, "null id " + item), (None, "null id, clean"), (1, "bad " + item), (1, "clean, shares its id"), (1, None), (2, "clean"), (2, "clean")]
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontam.keep(df, items)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, docs[1:2] + docs[3:]))


def test_smith_waterman_equals_the_table():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
        assert abs(decontam.smith_waterman(a, b)[0] - h.max()) < 1e-9


def test_mix_meets_targets_and_repeats_rows(docs, rows):
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by = collections.defaultdict(list)
    for r in plan:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    assert abs(sum(x[0].target for x in by.values()) - sum(r.size for r in plan)) < 1e-6
    for x in by.values():
        assert x[0].source_size == sum(r.size for r in x) and x[0].target <= 3 * x[0].source_size + 1e-9
        assert abs(sum(r.taken for r in x) - x[0].target) <= 2 * max(r.size for r in x)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    level = {by[s][0].target / (1 + i % 3) for i, s in enumerate(order) if by[s][0].target < 3 * by[s][0].source_size - 1e-6}
    assert max(level) - min(level) < 1e-6
    out = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    times = collections.Counter()
    for r in plan:
        times[r.doc_id] += r.times
    assert out == {k: v for k, v in times.items() if v}
    assert mixing.mix(docs).columns == docs.columns


def test_quality_counts_and_rules(docs, rows):
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    for r in rows:
        t = r[1] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        rep = len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep)
        assert g.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and not (g.base_failed and g.kept)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g.kept}


def test_run_index_equals_brute_force(docs, rows, monkeypatch):
    texts = {-1 if r[0] is None else r[0]: (r[1] or "").encode() for r in rows}
    want = rindex.brute_force(texts)
    # with and without hot anchors: none, all (broadcast, then shuffled), and only the frequent ones
    hot = len(rindex.hot_anchors(docs.selectExpr("doc_id as id", "coalesce(text, '') as text", "0L as tag"), 50, 16, 3, 1))
    assert 0 < hot < len(rindex.hot_anchors(docs.selectExpr("doc_id as id", "coalesce(text, '') as text", "0L as tag"), 50, 16, 1, 1))
    for block_bytes, options in ((1 << 21, {}), (3000, {}), (1 << 21, {"hot": 1, "hot_sample": 1}), (3000, {"hot": 1, "hot_sample": 1}),
                                 (3000, {"hot": 3, "hot_sample": 1})):
        monkeypatch.setattr(rindex, "VERDICT_BLOCKS", 0 if block_bytes == 3000 and options.get("hot") == 1 else 1000)  # joined by a shuffle
        monkeypatch.setattr(rindex, "VERDICT_BLOCK", 40 if options.get("hot") == 3 else 100_000)  # in several blocks
        got = rindex.remove_repeats(docs, block_bytes=block_bytes, **options).collect()
        assert len(got) == len(rows)
        for r in got:
            i = -1 if r.doc_id is None else r.doc_id
            assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == (len(texts[i]), *want[i])


def test_run_index_keeps_rows_apart_by_id_and_text(spark):
    a, b = "the same long text stands here, " * 5, "another long text of the same document, " * 5
    rows = [(1, a), (5, a), (5, b), (5, b), (None, b), (6, "x" * 400), (7, "x" * 400 + "y")]
    df = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], "doc_id bigint, text string, id int, part string, tag int").repartition(3)
    for options in ({}, {"hot": 1, "hot_sample": 1}, {"hot": 100, "hot_sample": 1_000_000, "long_text": 100}):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in rindex.remove_repeats(df, **options).collect())
        assert got == sorted([("1", len(a), 0), ("5", len(a), len(a)), ("5", len(b), len(b)), ("5", len(b), len(b)), ("None", len(b), 0), ("6", 400, 0), ("7", 401, 400)])


def test_filter_is_merged_by_all_tasks_at_once(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.randrange(-(1 << 63), 1 << 63) if rnd.random() < 0.7 else k << 20 for k in range(rnd.choice([0, 1, 60]))]) for i in range(90)]
    sets = [sorted({h % (1 << 64) for h in x}) for _, x in rows]
    docs = spark.createDataFrame([(i, b"".join(h.to_bytes(8, "little") for h in x)) for (i, _), x in zip(rows, sets)], "i int, h binary").repartition(3)
    before, bits = spark.conf.get("spark.sql.shuffle.partitions"), 1 << 20
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.sparkContext.setJobGroup("merge", "merge")
    try:
        found = twice.twice(docs, lambda batch: (np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()), bits)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("merge")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20  # not one after the other for each partition
    n = collections.Counter(p for x in sets for h in x for p in (h % bits, (h >> 32) % bits))
    assert np.flatnonzero(np.unpackbits(found.bitmap(), bitorder="little")).tolist() == sorted(p for p, times in n.items() if times > 1)


def test_run_index_scans_texts_as_often_whatever_the_verdicts(docs, monkeypatch):
    scans = set()
    for block in (100_000, 20):
        monkeypatch.setattr(rindex, "VERDICT_BLOCK", block)
        monkeypatch.setattr(rindex, "VERDICT_BLOCKS", 1000)
        scans.add(rindex.remove_repeats(docs, hot=2, hot_sample=1)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
    assert len(scans) == 1


def test_first_documents_of_stretches_equal_brute_force():
    rnd, settled = random.Random(5), 0

    def some(n):
        return bytes(rnd.choice(letters) for _ in range(n))

    for length, k in ((50, 16), (20, 8), (21, 8), (9, 4), (8, 8)) * 12:
        letters = rnd.choice([b"ab", b"abcdefgh", b"abcdefghijklm\0"])
        pool = [some(rnd.choice([length - 3, length + 7, 2 * length])) for _ in range(4)]
        texts = [b"".join(rnd.choice([*pool, some(rnd.randint(1, length))]) for _ in range(rnd.randint(1, 5))) for _ in range(12)]
        _, text, a, b, joined = anchors.stretches(texts, length, k)
        low, first = {}, {}
        for i, x, y in zip(text.tolist(), a.tolist(), b.tolist()):
            low.setdefault(joined[x:y], i)  # texts come in order
            for p in range(x, y - length + 1):
                first.setdefault(joined[p:p + length], i)
        if not low:
            continue
        parts = pa.array(list(low), pa.binary())
        bounds, docs, begin, end = rindex.first_documents(parts, np.array(list(low.values())), length, k)
        settled += (~anchors.kin(*rindex._bytes_of(parts), length, k)).sum()
        for i, part in enumerate(low):
            got = [docs[r] for r in range(bounds[i], bounds[i + 1]) for _ in range(begin[r], end[r] + 1)]
            assert begin[bounds[i]] == 0 and got == [first[part[p:p + length]] for p in range(len(part) - length + 1)]
    assert settled


def test_suffix_array_and_statistics():
    rnd = random.Random(3)
    for _ in range(60):
        s = bytes(rnd.choice(rnd.choice([b"a", b"ab", b"abcdefgh"])) for _ in range(rnd.choice([1, 2, 30, 300])))
        s += s[:len(s) // 2] + s
        index = rindex.RunIndex(np.frombuffer(s, np.uint8))
        sa = sorted(range(len(s)), key=lambda i: s[i:])
        assert index.sa.tolist() == sa
        for limit in (3, 50):
            found = index.matching_statistics(limit)
            for a, b in zip(sa, sa[1:]):
                n = next((k for k in range(limit) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), limit)
                assert found[b] == n


def test_shingles_equal_sets_of_tuples():
    texts = [(t or "").encode() for t in _texts()]
    g, at = shingles.shingle_sets(texts)
    own = [frozenset(g[a:b].tolist()) for a, b in zip(at, at[1:])]
    want = _classes([t.decode() for t in texts])
    assert [len(x) for x in own] == [len(x) for x in want]
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 5):
            assert len(own[i] & own[j]) == len(want[i] & want[j])


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string")
    for out in (tokens.encode(empty, queries.word_tokenizer()), kdtree.shard(empty), linededup.drop_frequent(empty), pii.find(empty), urls.judge(pages),
                forest.classes(empty), forest.keep(empty), decontam.contaminated(empty, items), mixing.plan(empty), mixing.mix(empty),
                quality.report(empty), rindex.remove_repeats(empty)):
        assert out.count() == 0


def test_pipeline_stages_by_brute_force(spark, rows):
    import corpus_pipeline
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append([r.doc_id for r in docs.select("doc_id").collect()])
    quality_, deduped, clean, mixed = out
    assert set(quality_) >= set(deduped) >= set(clean) >= set(mixed) and len(deduped) == len(set(deduped))
    test = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert {i for i in deduped if any(t in text[i] for t in test)} == set(deduped) - set(clean)
    sets = dict(zip(deduped, _classes([text[i] for i in deduped])))
    assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in deduped for b in deduped if a < b)
    final = corpus_pipeline.run(spark, path).select(F.count(F.lit(1)), F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert final[0] == len(mixed) and final[1] == final[2]
