"""Filter audit, vector codes and packing against brute force, with every awkward case."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import filteraudit, packing, queries, vectorcodes
from tessera.session import ship_package

DOCS = "doc_id bigint, text string, source string, h string, fails int, part string, label int, rows int, id string, l bigint, t string, first int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    long = text(260)
    texts = [long, long, long + " AAAAAAAAAAAAAAA BBBBBB", "same " * 300, "same " * 300 + "$", text(10), "", None, "  \t\n", "ÀÉ" * 400, text(400) + " #", text(30000)]
    texts += [rnd.choice([long, text(rnd.randint(1, 500)), (word() + "\x0b") * rnd.randint(1, 400), text(210).upper(), "a|b " * rnd.randint(1, 250)]) for _ in range(60)]
    out = [(i, t, rnd.choice(["x", "y", None, ""]), "h", 1, "p", 2, 3, "id", 4, "t", 5) for i, t in enumerate(texts)]
    return out + [out[0], out[3], (None, long, "x", *out[0][3:]), (None, None, "only", *out[0][3:]), (4, long, "y", *out[0][3:])]


def test_positional_popcount():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 17, 1000, 12345):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert (filteraudit.positional_popcount(words) == ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0)).all()


def test_filter_audit_equals_brute_force(spark):
    ship_package(spark)
    rows = _docs()
    labels = [(i, i % 2, int(i % 5 == 0), "x") for i in range(0, 60, 2)] + [(3, None, None, "x"), (5, 0, 1, "x"), (5, 1, None, "x"), (None, 1, 1, "x"), (999, 1, 1, "x")]
    got = filteraudit.audit(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, part string"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}
    key = lambda i: -math.inf if i is None else i
    first: dict = {}
    for r in rows:
        first[r[1] or ""] = min(first.get(r[1] or "", math.inf), key(r[0]))
    docs = collections.defaultdict(list)
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                               re.search(r"[#$%&*|]", t), key(r[0]) > first[t])) if bad}
        mine = [x for x in labels if x[0] is not None and x[0] == r[0]]
        docs[r[2] or ""].append((fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    want = {}
    for part, own in docs.items():
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone, stay = [d for d in left if c in d[0]], [d for d in left if c not in d[0]]
                total[c] += len(gone)
                want[part, order, step] = [len(stay), len(gone), sum(c in d[0] for d in own) - len(gone), sum(d[0] == {c} for d in own),
                                           sum(d[1] for d in gone), sum(d[2] for d in gone)]
                left = stay
        for (p, order, step), x in want.items():
            if p == part:
                x.append(total[order[step - 1]])
    assert set(docs) == {"x", "y", "", "only"} and got == {k: tuple(v) for k, v in want.items()}


def test_filter_audit_empty_and_hot(spark, monkeypatch):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filteraudit.audit(spark.createDataFrame([], DOCS), labels).collect() == []
    monkeypatch.setattr(filteraudit, "_HOLD", 7)  # several sums in a task
    hot = spark.createDataFrame([(i, "one text", "s") for i in range(500)], "doc_id bigint, text string, source string").repartition(5)
    got = {(r.filter_order, r.step): r for r in filteraudit.audit(hot, labels).collect()}
    assert len(got) == 600 and (got["EABCD", 1].removed, got["EABCD", 1].kept, got["EABCD", 2].removed, got["AEBCD", 2].redundant) == (499, 1, 1, 499)


def _lloyd(vectors, parts, entries, rounds, scale=4096):
    """(code, error) by row and the digest, with Python's integers."""
    good = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    widths = collections.Counter(len(v) for _, _, v in good if v and len(v) % parts == 0)
    width = max(widths, key=lambda w: (widths[w], w))
    own = [r for r in good if len(r[2]) == width]
    step = width // parts
    cut = lambda v: [v[j * step:(j + 1) * step] for j in range(parts)]
    first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v)[j] for _, _, v in first] for j in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda i: (away(x, book[i]), i))
    for _ in range(rounds):
        for j in range(parts):
            held = collections.defaultdict(list)
            for _, _, v in own:
                held[near(cut(v)[j], books[j])].append(cut(v)[j])
            books[j] = [[sum(c) // len(held[i]) for c in zip(*held[i])] if held[i] else e for i, e in enumerate(books[j])]
    out = []
    for i, lab, v in good:
        if len(v) == width:
            code = [near(x, b) for x, b in zip(cut(v), books)]
            out.append((i, lab, "".join(f"{c:02x}" for c in code), min(sum(away(x, b[c]) for x, b, c in zip(cut(v), books, code)), (1 << 63) - 1)))
        else:
            out.append((i, lab, None, None))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v int, l int, code int"


def _vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)).astype(np.float32)
    x = (centres[rng.integers(0, 5, n)] * spread + rng.normal(size=(n, width)).astype(np.float32) * 0.1).astype(np.float32)
    x[rng.random(n) < 0.3] = x[0]  # a hot vector
    ids = rng.permutation(n).tolist()
    out = [(ids[i], [float(a) for a in x[i]], [None, 1, 2][i % 3]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    out += [(-5, None, 1), (-4, [nan] + [0.0] * (width - 1), 1), (-3, [inf] + [0.0] * (width - 1), 1), (-2, [None] + [0.0] * (width - 1), 2), (-1, [1.0] * (width + 1), 1), (-6, [], None)]
    return out + [out[0], (out[1][0], out[2][1], 9), (None, out[3][1], None)]


@pytest.mark.parametrize("n,width,parts,entries,block_rows,spread", [(400, 8, 2, 16, 7, 1.0), (700, 12, 4, 5, 300, 1.0), (5, 8, 8, 16, 100, 1.0), (60, 4, 2, 4, 9, 1e30)])
def test_vector_codes_equal_brute_force(spark, n, width, parts, entries, block_rows, spread):
    rows = _vectors(n, width, n, spread)
    df = spark.createDataFrame([(i, v, lab, "x", 1, 2, 3) for i, v, lab in rows], VECTORS).repartition(3)
    got = vectorcodes.compress(df, parts=parts, entries=entries, rounds=3, block_rows=block_rows).collect()
    want, digest = _lloyd([(i, lab, v and [None if x is None else np.float32(x).item() for x in v]) for i, v, lab in rows], parts, entries, 3)
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2] or "")
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got), key=order) == sorted(want, key=order)
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = collections.Counter()
    for _, lab, _, e in want:
        sums[lab] += e or 0
    assert all(r.label_error == min(sums[r.label], (1 << 63) - 1) for r in got if r.error is not None)


def test_vector_codes_without_rows(spark):
    assert vectorcodes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    odd = vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 9, 1, "x", 1, 2, 3), (2, None, 1, "x", 1, 2, 3)], VECTORS)).collect()
    assert [(r.vec_id, r.code, r.error) for r in odd] == [(1, None, None)]


def test_dual_tree_assigns_like_all_distances():
    rng = np.random.default_rng(1)
    compared = 0
    for t in range(60):
        n, d, k = int(rng.integers(1, 2000)), int(rng.integers(1, 9)), int(rng.integers(1, 17))
        x = (rng.normal(size=(n, d)) * rng.choice([2, 50, 4000])).astype(np.int32)
        if t % 2:
            x = (rng.normal(size=(k, d)) * 4000).astype(np.int32)[rng.integers(0, k, n)] + rng.integers(-9, 9, (n, d)).astype(np.int32)
        book = x[rng.integers(0, n, k)].astype(np.int64)
        tree = vectorcodes.PartTree(x)
        for b in (book, vectorcodes._exact(book, np.dtype(object))):
            code, count, sums, one_by_one = vectorcodes.assign(tree, b)
            want = ((tree.x[:, None, :].astype(np.int64) - book[None]) ** 2).sum(-1).argmin(1)
            assert (code == want).all() and (count == np.bincount(want, minlength=k)).all()
            total = np.zeros(book.shape, np.int64)
            np.add.at(total, want, tree.x.astype(np.int64))
            assert (sums == total).all()
    far = np.repeat(np.array([[0, 0], [9000, 0], [0, 9000], [9000, 9000]]), 4000, axis=0).astype(np.int32) + rng.integers(-50, 50, (16000, 2)).astype(np.int32)
    compared = vectorcodes.assign(vectorcodes.PartTree(far), far[[0, 4000, 8000, 12000]].astype(np.int64))[3]
    assert compared == 0  # whole nodes by their sums


def _pack_docs():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopé") for _ in range(rnd.randint(1, 9)))
    texts = ["", None, " ", "\n\n\n", "one", "  two  spaces ", "it's we'll 3rd x's", "a b   c　d", "<|endoftext|> x <|endoftext|>", "日本語 テキスト", "x" * 5000]
    texts += [" ".join(word() for _ in range(n)) for n in (1, 10, 127, 128, 129, 600, 3000)]
    texts += [" ".join(word() + rnd.choice(["", ",", "."]) for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    return [(i, t, 1, 2, 3, "x") for i, t in enumerate(texts)] + [(4, "one", 1, 2, 3, "x"), (4, "one", 1, 2, 3, "x"), (None, "no id", 1, 2, 3, "x"), (None, None, 1, 2, 3, "x")]


PACK = "doc_id bigint, text string, piece int, start int, length int, sequence_id string"


def test_units_are_encoded_like_texts():
    from tokenizers import Tokenizer
    path, rnd = queries.byte_tokenizer(), random.Random(2)
    tok, own = Tokenizer.from_file(path), packing.UnitEncoder(path)
    texts = ["".join(rnd.choice("aAbé ß\n\t 's ll.,1٣́ \u0085  　\x1c\x0b -…日<|>") for _ in range(25)) for _ in range(4000)] + [r[1] or "" for r in _pack_docs()]
    ids, n = own.encode([t.encode() for t in texts])
    for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert part.tolist() == tok.encode(t, add_special_tokens=False).ids + [0], repr(t)


def test_a_full_cache_changes_nothing(monkeypatch):
    path, texts = queries.byte_tokenizer(), [(r[1] or "").encode() for r in _pack_docs()]
    want = packing.UnitEncoder(path).encode(texts)
    for most in (3, 50, 1000):
        monkeypatch.setattr(packing, "_CACHED_UNITS", most)
        own = packing.UnitEncoder(path)
        for _ in range(2):
            got = [own.encode([t]) for t in texts]
            assert (np.concatenate([i for i, _ in got]) == want[0]).all() and (np.concatenate([n for _, n in got]) == want[1]).all()


@pytest.mark.parametrize("limit,open_bins", [(128, 4096), (128, 3), (2048, 64)])
def test_packing(spark, limit, open_bins):
    from tokenizers import Tokenizer
    ship_package(spark)
    rows, tok = _pack_docs(), Tokenizer.from_file(queries.byte_tokenizer())
    got = packing.pack(spark.createDataFrame(rows, PACK).repartition(4), queries.byte_tokenizer(), limit, open_bins, with_ids=True)
    out = got.collect()
    want = []
    for r in rows:
        ids, start = tok.encode(r[1] or "", add_special_tokens=False).ids + [0], 0
        many = -(-len(ids) // limit)
        for piece in range(many):
            part = ids[start:start + (len(ids) - (many - 1) * limit if piece == 0 else limit)]
            want.append((r[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
            start += len(part)
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in out), key=key) == sorted(want, key=key)
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length, r.ids))
    for x in held.values():
        x.sort()
        assert [o for o, _, _ in x] == [sum(n for _, n, _ in x[:i]) for i in range(len(x))] and x[-1][0] + x[-1][1] <= limit
    if open_bins == 4096:
        assert len(held) <= math.ceil(sum(r[3] for r in want) / limit) * 1.02 + 1
    made = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert made == {k: [i for _, _, ids in x for i in ids] for k, x in held.items()}
    assert packing.pack(spark.createDataFrame([], PACK), queries.byte_tokenizer()).collect() == []


def test_open_bins_are_best_fit_and_bounded():
    rnd = random.Random(4)
    for most in (1, 2, 5, 100):
        bins, left = packing.OpenBins(50, most), {}
        for _ in range(3000):
            n = rnd.randint(1, 50)
            own, at = bins.put(n)
            fits = [f for f in left.values() if f >= n]
            if fits:
                assert left[own] == min(fits) == 50 - at
            else:
                assert at == 0 and own not in left
                if n < 50 and len(left) == most:  # one of the fullest has closed
                    closed, = set(left) - set(sum(bins.bins, []))
                    assert left[closed] == min(left.values())
                    del left[closed]
            left[own] = 50 - at - n
            if not left[own]:
                del left[own]
            assert sorted(left) == sorted(sum(bins.bins, [])) and len(left) <= most and bins.n_open == len(left)
            assert bins.there == sum(1 << f for f in set(left.values()))
