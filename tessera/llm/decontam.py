"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are read in blocks of at most ``block_words`` words, and each block is
matched against the whole corpus, which joins document passages to items by seed, inside
the task that holds the text.

1. A first scan counts the items' words and pairs of words in the whole corpus.
2. Seeds are the rarest of them, as many as no passing alignment can do without.  An alignment
   that scores ``threshold`` of an item of L words has at most E = (1 - threshold) L / gap errors,
   so it holds at least L - E - 1 of the item's L - 1 pairs intact, and threshold x L of its words:
   all but so many, less one, of the most common are dropped.  Each item takes words or pairs,
   whichever the corpus holds fewer times.  The counts decide the work, never the result: a pair
   that many copies of an item hold is dropped only where rarer ones are left in each copy.
3. In a second scan an item hit by a seed, of which fewer words occur in the text than the
   threshold needs, is skipped; its score could not reach it.  For the others a running bound
   (1 for each word of the text that the item has, less the gap for any other) shows where an
   alignment that passes can end; the words before, as many as it can span, are its passage, if
   a seed is there.  It is aligned with the item by Smith-Waterman (match 1, mismatch and gap
   -0.5, over normalised words), and the score is divided by the item's length.

Words are runs of bytes other than ASCII white space and punctuation, A-Z lower-cased.  Texts are
scanned whole; nothing but an item block is broadcast, one at a time.

Defined cases: a null or empty text matches nothing; an item with fewer than ``min_words``
words has no seed and matches nothing; long texts are read in the task that holds them; other
columns are ignored; an item so short that a common phrase of its own
reaches the threshold is found wherever the phrase stands; equal items are reported each; repeated rows
are reported each; of several passages for one item the best is reported, ties to the
first; an empty corpus or benchmark gives an empty result.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import binary, ragged, text_of
from tessera.session import cut_lineage

MIN_WORDS, THRESHOLD, GAP, BLOCK_WORDS = 3, 0.55, 0.5, 2_000_000
#: Bytes that separate words: white space and punctuation.
_BREAKS = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>*_-"))
_LOWER = shingles.BYTE_VALUES[np.frombuffer(bytes(range(256)).lower(), np.uint8)]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's begin."""
    return shingles.words_by_text(texts, _BREAKS, _LOWER)


def smith_waterman(item: np.ndarray, passage: np.ndarray, gap: float = GAP) -> tuple[float, int, int]:
    """Best local score, and the passage word and the item word after its end (ties to the first in
    the passage).  A row at a time: gaps along the passage are a running maximum."""
    drift = gap * np.arange(len(passage) + 1)
    row, best, end, used = np.zeros(len(passage) + 1), 0.0, 0, 0
    for i, word in enumerate(item):
        step = np.where(passage == word, 1.0, -gap)
        new = np.empty_like(row)
        new[0] = 0.0
        new[1:] = np.maximum(np.maximum(row[:-1] + step, row[1:] - gap), 0.0)
        row = np.maximum.accumulate(new + drift) - drift
        k = int(row.argmax())
        if row[k] > best or (row[k] == best and k < end):
            best, end, used = float(row[k]), k, i + 1
    return best, end, used


def _words_back(item: np.ndarray, passage: np.ndarray, gap: float = GAP) -> int:
    """Passage words of the best alignment that ends where both end."""
    passage = passage[::-1]
    drift = gap * np.arange(len(passage) + 1)
    row, best, at = -drift, 0.0, 0
    for word in item[::-1]:
        new = row - gap
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, 1.0, -gap), new[1:])
        row = np.maximum.accumulate(new + drift) - drift
        k = int(row.argmax())
        if row[k] > best:
            best, at = float(row[k]), k
    return at


def _joined(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [first, last), those that meet as one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
    return first[new], last[np.append(new[1:], len(first)) - 1]


def _number(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that are in the sorted ``of``, and their numbers there."""
    if not len(of) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(of, values), len(of) - 1)
    at = np.flatnonzero(of[k] == values)
    return at, k[at]


def needless(size: int, threshold: float, kind: int) -> int:
    """How many of an item's words (kind 0) or pairs (kind 1) a passing alignment holds for certain, less one."""
    errors = math.floor((1 - threshold) * size / GAP + 1e-9)
    return (math.ceil(threshold * size - 1e-9) if kind == 0 else size - errors - 1) - 1


class Block:
    """Items with their seeds, for one pass over the corpus."""

    def __init__(self, ids: list[int], texts: list[bytes], min_words: int):
        words, begin = words_of(texts)
        self.ids, self.items = ids, np.split(words, begin[1:-1])
        self.begin, self.sizes, self.min_words = begin[:-1], np.diff(begin), min_words
        self.vocab, self.word = np.unique(words, return_inverse=True)
        pairs, self.pair_of = shingles.grams(words, begin, 2)
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)

    def occurrences(self, texts: list[bytes]) -> np.ndarray:
        """How often the items' words, and then their pairs, stand in the texts."""
        words, begin = words_of(texts)
        out = np.zeros(len(self.vocab) + len(self.pairs), np.int64)
        out[:len(self.vocab)] = np.bincount(_number(words, self.vocab)[1], minlength=len(self.vocab))
        out[len(self.vocab):] = np.bincount(_number(shingles.grams(words, begin, 2)[0], self.pairs)[1], minlength=len(self.pairs))
        return out

    def choose(self, counts: np.ndarray, threshold: float) -> None:
        """Seeds of each item: its rarest words or pairs, whichever are fewer in the corpus."""
        seed, owner, v = [], [], len(self.vocab)
        pair_begin = np.searchsorted(self.pair_of, np.arange(len(self.ids) + 1))
        for i, (a, n) in enumerate(zip(self.begin.tolist(), self.sizes.tolist())):
            best = None
            for kind in (0, 1) if n >= self.min_words else ():
                own = self.word[a:a + n] if kind == 0 else v + self.pair[pair_begin[i]:pair_begin[i + 1]]
                spare = needless(n, threshold, kind)
                if spare < 0 or not len(own):
                    continue
                kept = own[np.lexsort((own, counts[own]))][:len(own) - spare]
                cost = int(counts[kept].sum())
                if best is None or cost < best[0]:
                    best = cost, np.unique(kept)
            if best:
                seed.append(best[1])
                owner.append(np.full(len(best[1]), i))
        s, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seed, owner))
        values, self.seed = np.unique(s, return_inverse=True)  # words first, then pairs
        split = int(np.searchsorted(values, v))
        self.seed_of_word = np.full(v + 1, -1)
        self.seed_of_word[values[:split]] = np.arange(split)
        self.first_pair, self.seed_pairs = split, self.pairs[values[split:] - v]
        self.of = np.searchsorted(owner, np.arange(len(self.ids) + 1))
        order = np.argsort(self.seed, kind="stable")
        self.owner = owner[order]
        self.starts = np.searchsorted(self.seed[order], np.arange(len(values) + 1))
        del self.pairs, self.pair, self.pair_of  # not sent again

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Seeds found: number of the text, of the word, of the seed; all words, their numbers among
        the items' words (their count for any other), and where each text's words begin."""
        words, begin = words_of(texts)
        number = np.full(len(words), len(self.vocab))
        at, k = _number(words, self.vocab)
        number[at] = k
        k = self.seed_of_word[number]
        at = np.flatnonzero(k >= 0)
        owner = np.repeat(np.arange(len(texts)), np.diff(begin))
        pairs, who = shingles.grams(words, begin, 2)
        at2, k2 = _number(pairs, self.seed_pairs)
        text = np.concatenate([owner[at], who[at2]])
        p = np.concatenate([at - begin[owner[at]], at2 - np.searchsorted(who, who[at2])])
        k = np.concatenate([k[at], k2 + self.first_pair])
        order = np.argsort(text, kind="stable")
        return text[order], p[order], k[order], words, number, begin

    def possible(self, number: np.ndarray, k: np.ndarray, threshold: float) -> np.ndarray:
        """Items hit by seeds ``k`` of which the text holds enough words to reach the threshold."""
        k = np.unique(k)
        items = np.unique(self.owner[ragged(self.starts[k], self.starts[k + 1] - self.starts[k])])
        here = self._scratch()
        here[number] = True
        here[-1] = False
        sizes = self.sizes[items]
        held = np.add.reduceat(here[self.word[ragged(self.begin[items], sizes)]].astype(np.int64), np.cumsum(sizes) - sizes)
        here[number] = False
        return items[held / sizes >= threshold]

    def _scratch(self) -> np.ndarray:
        """One flag for each of the items' words, all down, and a last one for any other word."""
        if "flags" not in self.__dict__:
            self.flags = np.zeros(len(self.vocab) + 1, bool)
        return self.flags

    def passages(self, item: int, number: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """Word ranges that hold every alignment that passes.  In an alignment a word of the text counts 1 if the
        item has it and costs the gap if not, at best; so it ends where that sum, over some words before, passes."""
        own, size = self.word[self.begin[item]:self.begin[item] + self.sizes[item]], int(self.sizes[item])
        flags = self._scratch()
        flags[own] = True
        total = np.cumsum(np.where(flags[number], 1.0, -GAP))
        flags[own] = False
        best = total - np.minimum(np.minimum.accumulate(np.append(0.0, total[:-1])), 0.0)
        end = np.flatnonzero(best >= threshold * size - 1e-9)
        if len(end):
            span = size + math.ceil((1 - threshold) / GAP * size)
            for a, z in zip(*_joined(np.maximum(end + 1 - span, 0), end + 1)):
                if np.searchsorted(at, z) > np.searchsorted(at, a):
                    yield a, z

    def matches(self, words: np.ndarray, number: np.ndarray, p: np.ndarray, k: np.ndarray, threshold: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, end word, seeds hit) for the best passage of each item found."""
        items = self.possible(number, k, threshold)
        if not len(items):
            return []
        order = np.argsort(k, kind="stable")
        p, k = p[order], k[order]
        out = []
        for item in items.tolist():
            own, mine = self.items[item], self.seed[self.of[item]:self.of[item + 1]]
            lo = np.searchsorted(k, mine)
            at = np.sort(p[ragged(lo, np.searchsorted(k, mine, "right") - lo)])
            best = (0.0, 0, 0)
            for lo_, hi_ in self.passages(item, number, at, threshold):
                score, end, used = smith_waterman(own, words[lo_:hi_])
                score /= len(own)
                if score >= threshold and score > best[0]:
                    back = _words_back(own[:used], words[max(lo_, lo_ + end - 3 * len(own)):lo_ + end])
                    best = (score, int(lo_ + end - back), int(lo_ + end))
            if best[0]:
                out.append((item, *best, len(at)))
        return out


def _count(block):
    def run(batches):
        total = None
        for batch in batches:
            texts = binary(batch.column(1))
            for lo, hi in shingles.chunks(texts):
                found = block.value.occurrences(texts[lo:hi])
                total = found if total is None else total + found
        at = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at] if len(at) else at)], ["seed", "n"])
    return run


def _align(block, threshold: float):
    def run(batches):
        b = block.value
        for batch in batches:
            rows, found = [], []
            texts = binary(batch.column(1))
            for lo, hi in shingles.chunks(texts):
                who, p, k, words, number, begin = b.hits(texts[lo:hi])
                hit, first = np.unique(who, return_index=True)
                for i, x, y in zip(hit.tolist(), first, np.append(first[1:], len(who))):
                    own = slice(begin[i], begin[i + 1])
                    for m in b.matches(words[own], number[own], p[x:y], k[x:y], threshold):
                        rows.append(lo + i)
                        found.append(m)
            cols = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([b.ids[i] for i in cols[0]], pa.int64()), pa.array(cols[1], pa.float64()),
                 *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])
    return run


def _blocks(items: DataFrame, id_col: str, text: str, min_words: int, block_words: int) -> Iterator[Block]:
    ids, texts, held = [], [], 0
    for row in items.select(F.col(id_col).alias("i"), text_of(text).alias("t")).orderBy("i", "t").toLocalIterator():
        t = row["t"].encode()
        size = len(t.split())
        if ids and held + size > block_words:
            yield Block(ids, texts, min_words)
            ids, texts, held = [], [], 0
        ids.append(row["i"])
        texts.append(t)
        held += size
    if ids:
        yield Block(ids, texts, min_words)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS,
                 id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score, start_word, end_word, n_seeds."""
    sc = docs.sparkSession.sparkContext
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id bigint, score double, start_word bigint, end_word bigint, n_seeds bigint"
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    blocks = _blocks(items, item_id, item_text, min_words, block_words)
    block = next(blocks, None)
    while block:
        sent = sc.broadcast(block)
        counted = rows.mapInArrow(_count(sent), "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).collect()  # block_words x 2 at most
        sent.unpersist()
        counts = np.zeros(len(block.vocab) + len(block.pairs), np.int64)
        counts[[r["seed"] for r in counted]] = [r["n"] for r in counted]
        block.choose(counts, threshold)
        sent = sc.broadcast(block)
        found = rows.mapInArrow(_align(sent, threshold), schema)
        block = next(blocks, None)
        if block:  # one block is out at a time
            found = cut_lineage(found)
            sent.unpersist()
        out = out.unionByName(found)
    return out


def keep(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose own text holds no test item, with their own columns.  Rows go by id
    and text together: one with a null id goes too, one that only shares the id of another stays."""
    key = F.struct(F.col(id_col).alias("id"), F.sha2(text_of(text), 256).alias("text"))
    keyed = docs.select(key.alias("key"), text_of(text).alias("text"))
    bad = contaminated(keyed, items, id_col="key", **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, key.eqNullSafe(bad["_bad"]), "left_anti")
