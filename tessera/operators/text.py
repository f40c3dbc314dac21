"""Text preparation and scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as TX
from tessera.session import cut_lineage


def explode_articles(feed: DataFrame, col: str = "articles", keep: Sequence[str] = ()) -> DataFrame:
    """Feed responses ``articles: ARRAY<STRUCT<...>>`` -> one row per article."""
    return feed.select(*keep, F.explode(col).alias("_a")).select(*keep, "_a.*")


def nonempty(df: DataFrame, col: str = "content") -> DataFrame:
    """Keep rows whose text is non-empty (blank-only text is kept: it is truthy)."""
    return df.filter(F.length(col) > 0)


def tokenize_pad(df: DataFrame, col: str, max_length: int = 512, labels_from: str | None = None,
                 label_length: int | None = None) -> DataFrame:
    """``chunk_no``, ``input_ids``, ``attention_mask`` and ``labels`` (a copy of the ids, or the
    encoding of ``labels_from`` as in question/answer pairs).

    The whole text is encoded: pieces beyond ``max_length`` go on in rows with
    ``chunk_no`` 1, 2, ...; chunk 0 is the row a truncating tokeniser gives."""
    lengths = [max_length] if labels_from is None else [max_length, label_length or max_length]
    out = df.withColumn("_tok", TX.tokens(col))          # whole text tokenised once
    if labels_from is not None:
        out = out.withColumn("_lab", TX.tokens(labels_from))
    toks = ["_tok", "_lab"][:len(lengths)]
    n = F.greatest(F.lit(1), *[F.ceil(F.size(t) / (k - 2)).cast("int") for t, k in zip(toks, lengths)], F.lit(1))

    def part(i):
        return F.struct(*[F.slice(F.col(t), i * (k - 2) + 1, k - 2).alias(t) for t, k in zip(toks, lengths)])

    out = out.select(*df.columns, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), part)).alias("chunk_no", "_part"))
    out = out.withColumn("input_ids", TX.encode_tokens(F.col("_part._tok"), max_length)) \
             .withColumn("attention_mask", TX.mask_tokens(F.col("_part._tok"), max_length))
    if labels_from is None:
        return out.drop("_part").withColumn("labels", F.col("input_ids"))
    return out.withColumn("labels", TX.encode_tokens(F.col("_part._lab"), lengths[1])).drop("_part")


def _grams(words_col: str, n: int):
    """n-grams of a materialised word-array column (joined with single spaces)."""
    w = F.col(words_col)
    if n == 1:
        return w
    idx = F.sequence(F.lit(0), F.size(w) - n)
    return F.when(F.size(w) >= n, F.transform(idx, lambda i: F.array_join(F.slice(w, i + 1, n), " "))) \
            .otherwise(F.array().cast("array<string>"))


def _by_key(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key is theirs alone, and the others (None if there are none).

    Keys are counted first (one flag comes to the driver).  Where none repeats, which is the rule,
    every row is worked on in the task that read it and no text is shuffled."""
    more = rows.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_again")
    if not more.limit(1).count():
        return rows, None
    more = cut_lineage(more)
    same = rows[key].eqNullSafe(more["_again"])
    return rows.join(more, same, "left_anti"), rows.join(more, same, "left_semi")


def _common(a, b):
    """How many grams two arrays share, each as often as both hold it: one pass over the grams of both in order."""
    def side(of_ref):
        return lambda g: F.struct(g.alias("g"), F.lit(of_ref).alias("r"))

    def step(at, x):
        left = F.when(at["g"] == x["g"], at["left"]).otherwise(F.lit(0))
        met = x["r"] & (left > 0)
        return F.struct(x["g"].alias("g"), F.when(met, left - 1).when(x["r"], left).otherwise(left + 1).alias("left"),
                        (at["hit"] + F.when(met, 1).otherwise(0)).alias("hit"))

    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("left"), F.lit(0).alias("hit"))
    both = F.sort_array(F.concat(F.transform(a, side(False)), F.transform(b, side(True))))
    return F.aggregate(both, start, step)["hit"]


def rouge_n(df: DataFrame, key: str, pred: str, ref: str, ns: Sequence[int] | int = (1, 2)) -> DataFrame:
    """ROUGE-n precision/recall/F1 per key for every n in ``ns``.

    Both texts are tokenised once and the clipped overlap of their n-grams is found in the row
    itself, so a task holds the grams of one pair of texts.  The grams of rows that share a key are
    counted together: only those are exploded and shuffled, by gram.
    """
    ns = [ns] if isinstance(ns, int) else list(ns)
    own, shared = _by_key(df.select(key, pred, ref), key)

    def grams(rows):
        w = rows.select(key, TX.words(pred).alias("_wp"), TX.words(ref).alias("_wr"))
        return w.select(key, *[_grams(c, n).alias(f"{c}{n}") for c in ("_wp", "_wr") for n in ns])

    counts = F.struct(*[x for n in ns for x in (_common(F.col(f"_wp{n}"), F.col(f"_wr{n}")).alias(f"_hit{n}"),
                                                F.size(f"_wp{n}").alias(f"_np{n}"), F.size(f"_wr{n}").alias(f"_nr{n}"))])
    # inline: a later filter on several scores must not count the grams again for each
    s = grams(own).select(key, F.inline(F.array(counts)))
    if shared is not None:
        s = s.unionByName(_shared_grams(grams(shared), key, ns))
    out = [key]
    for n in ns:
        hit = F.col(f"_hit{n}").cast("double")
        prec = F.coalesce(F.try_divide(hit, F.col(f"_np{n}")), F.lit(0.0))
        rec = F.coalesce(F.try_divide(hit, F.col(f"_nr{n}")), F.lit(0.0))
        f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        out += [prec.alias(f"rouge{n}_p"), rec.alias(f"rouge{n}_r"), f1.alias(f"rouge{n}_f")]
    return s.select(*out)


def _shared_grams(grams: DataFrame, key: str, ns: Sequence[int]) -> DataFrame:
    """Clipped overlap and sizes per key, summed over its rows.  One empty marker per n keeps rows without grams."""
    def tag(n, side):
        return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(side).alias("p"), F.lit(1 - side).alias("r"))

    parts = []
    for n in ns:
        parts += [F.transform(f"{col}{n}", tag(n, side)) for col, side in (("_wp", 1), ("_wr", 0))]
        parts.append(F.array(F.struct(F.lit(n).alias("n"), F.lit(None).cast("string").alias("g"), F.lit(0).alias("p"), F.lit(0).alias("r"))))
    c = grams.select(key, F.explode(F.concat(*parts)).alias("_e")).select(key, "_e.*") \
        .groupBy(key, "n", "g").agg(F.sum("p").alias("cp"), F.sum("r").alias("cr"))
    aggs = []
    for n in ns:
        on = F.col("n") == n
        aggs += [F.sum(F.when(on, F.least("cp", "cr"))).alias(f"_hit{n}"),
                 F.sum(F.when(on, F.col("cp"))).alias(f"_np{n}"), F.sum(F.when(on, F.col("cr"))).alias(f"_nr{n}")]
    return c.groupBy(key).agg(*aggs)


def _lcs(a: list, b: list) -> int:
    """Longest common subsequence, bit-parallel: one big integer holds a row of the table."""
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    masks = {x: sum(1 << i for i in at) for x, at in where.items()}
    full = row = (1 << len(a)) - 1
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")


def rouge_l(df: DataFrame, key: str, pred: str, ref: str) -> DataFrame:
    """ROUGE-L (longest common subsequence) per row; the LCS dynamic programme runs
    in an Arrow-batched pandas UDF over the tokenised pair (per-row work only)."""
    from tessera.session import ship_package
    ship_package(df.sparkSession)                 # workers import the LCS helper by module reference
    w = df.select(key, TX.words(pred).alias("_p"), TX.words(ref).alias("_r"))
    w = w.withColumn("_l", _lcs_udf("_p", "_r"))
    prec = F.coalesce(F.try_divide(F.col("_l").cast("double"), F.size("_p")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("_l").cast("double"), F.size("_r")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return w.select(key, F.col("_l").alias("lcs"), prec.alias("rougeL_p"), rec.alias("rougeL_r"), f1.alias("rougeL_f"))


SENTENCE_END = r"([.!?])\s+"     # a sentence ends at . ! ? followed by white space
SENTENCE_SEP = "[\u0001\n]+"      # ... or at a line break


def sentences(text):
    """Sentences of the whole text (posexplode-able array, may hold blanks)."""
    marked = F.regexp_replace(F.coalesce(text if not isinstance(text, str) else F.col(text), F.lit("")),
                              SENTENCE_END, "$1\u0001")
    return F.split(marked, SENTENCE_SEP)


def token_blocks(words: pa.Array, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Texts given as arrays of sentences of words, in runs of about ``block`` words (whole texts): sentences
    of each text, words of each sentence, all words."""
    texts, inner = words.offsets.to_numpy(), words.values
    sents = inner.offsets.to_numpy()
    upto, at = sents[texts], 0                              # words before each text
    while at < len(texts) - 1:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + block, side="right")) - 1)
        first, last = texts[at], texts[end]
        yield np.diff(texts[at:end + 1]), np.diff(sents[first:last + 1]), inner.values.slice(upto[at], upto[end] - upto[at])
        at = end


def picks(counts: np.ndarray, sid: np.ndarray, take: np.ndarray) -> pa.Array:
    """Arrow array of one list of (sid, take) per text, from the number of picks in each and the picks in order."""
    at = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(sid, pa.int32()), pa.array(take, pa.int32())], ["sid", "take"]))


def _frequent(min_tokens: int, max_tokens: int):
    """Sentences of most frequent words, best first, within the budget."""
    def run(words: pa.Array) -> pa.Array:
        out = []
        for n_sents, size, word in token_blocks(words):
            n = len(size)
            doc = np.repeat(np.arange(len(n_sents)), n_sents)
            code, sent = word.dictionary_encode().indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), size)
            _, at, tf = np.unique(doc[sent] * (code.max(initial=0) + 1) + code, return_inverse=True, return_counts=True)
            # sum of word frequencies: an integer, so ranking is exact in any engine
            # (normalising by the text's top frequency does not change the order)
            score = np.bincount(sent, tf[at], n)
            order = np.lexsort((np.arange(n), -score, doc))
            order = order[size[order] > 0]
            used, d = np.cumsum(size[order]) - size[order], doc[order]
            used -= used[np.searchsorted(d, d)]             # words taken before the sentence
            keep = (used < min_tokens) | (used + size[order] <= max_tokens)
            order, take = order[keep], np.minimum(size[order], max_tokens - used)[keep]
            shown = np.argsort(order)
            order, take = order[shown], take[shown]
            first = np.cumsum(n_sents) - n_sents
            out.append(picks(np.bincount(doc[order], minlength=len(n_sents)), order - first[doc[order]], take))
        return pa.concat_arrays(out) if out else picks(*[np.zeros(0, np.int64)] * 3)
    return run


def picked_summary(df: DataFrame, key: str, text: str, pick) -> DataFrame:
    """``key``, ``summary`` and ``summary_tokens`` of each row of which ``pick`` takes a sentence.

    ``pick`` gets the sentences' words of a batch of texts and gives, per text, the sentences it takes and how many
    words of each.  A text is worked on in the task that reads it: nothing is shuffled."""
    from tessera.session import ship_package
    ship_package(df.sparkSession)                 # workers import the helpers by module reference
    pick = F.arrow_udf(pick, "array<struct<sid:int,take:int>>")
    parts = df.select(key, sentences(text).alias("_s"))
    picked = parts.withColumn("_w", F.transform("_s", lambda s: TX.words(s))).withColumn("_p", pick("_w")).filter(F.size("_p") > 0)

    def shown(p):
        s = F.col("_s")[p["sid"]]
        return F.when(p["take"] < F.size(F.col("_w")[p["sid"]]),
                      F.array_join(F.slice(F.regexp_extract_all(s, F.lit(TX.WORD_PATTERN), 0), F.lit(1), F.greatest(p["take"], F.lit(0))), " ")).otherwise(F.trim(s))

    total = F.aggregate("_p", F.lit(0).cast("bigint"), lambda a, p: a + p["take"])
    return picked.select(key, F.array_join(F.transform("_p", shown), " ").alias("summary"), total.alias("summary_tokens"))


def summarize(df: DataFrame, key: str, text: str, min_tokens: int = 30, max_tokens: int = 150) -> DataFrame:
    """Extractive summary: sentences scored by their words' document frequency
    (normalised by the most frequent word), taken best-first while the token
    budget allows (at least ``min_tokens``), then printed in document order.  A sentence
    that would pass ``max_tokens`` while there are too few is cut to its first words, so
    no summary has more than ``max_tokens``.

    Rows that share a key are one document, the only ones that are shuffled; rows without key are left out."""
    own, shared = _by_key(df.select(key, text).filter(F.col(key).isNotNull()), key)
    out = picked_summary(own, key, text, _frequent(min_tokens, max_tokens))
    return out if shared is None else out.unionByName(_shared_summary(shared, key, text, min_tokens, max_tokens))


def _shared_summary(docs: DataFrame, key: str, text: str, min_tokens: int, max_tokens: int) -> DataFrame:
    """Summaries of documents of several rows: words are counted and sentences ranked across them."""
    sent = docs.select(key, F.posexplode(sentences(text)).alias("sid", "s")).filter(F.length(F.trim("s")) > 0)
    wds = sent.select(key, "sid", F.explode(TX.words("s")).alias("w"))
    wtf = wds.withColumn("tf", F.count(F.lit(1)).over(Window.partitionBy(key, "w")))
    score = wtf.groupBy(key, "sid").agg(F.sum("tf").alias("score"), F.count(F.lit(1)).alias("ntok"))
    sent = sent.join(score, [key, "sid"])
    w = Window.partitionBy(key).orderBy(F.desc("score"), "sid")
    sent = sent.withColumn("cum", F.sum("ntok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = sent.filter(((F.col("cum") - F.col("ntok")) < min_tokens) | (F.col("cum") <= max_tokens))
    left = (F.lit(max_tokens) - (F.col("cum") - F.col("ntok"))).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("s", F.lit(TX.WORD_PATTERN), 0), F.lit(1), F.greatest(left, F.lit(0))), " ")
    keep = keep.withColumn("s", F.when(F.col("cum") > max_tokens, cut).otherwise(F.col("s"))).withColumn("ntok", F.least("ntok", left.cast("bigint")))
    out = keep.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sid", "s"))).alias("_ss"),
                                F.sum("ntok").alias("summary_tokens"))
    return out.select(key, F.array_join(F.transform("_ss", lambda x: F.trim(x["s"])), " ").alias("summary"),
                      "summary_tokens")
