"""URL filters: explicit host and path rules first, gradient-boosted trees for the rest.

The trees see lexical features only: length, depth, digit ratio, entropy, counts of
parameters, hyphens and host labels, and two suffix statistics (smoothed share of
blocked URLs by host suffix and by first path segment).  They are trained on the
labelled URLs: those whose host holds a word of the seed block list (block), those
that a rule decides, and those whose page is labelled (page_id is the doc_id of its
text): block if it is toxic or of low quality, allow if not.  The suffix statistics and
the prior are counted over all labelled rows, in ``FOLDS`` folds by the hash of the url: a URL,
fitted or scored, gets the share in the other folds, so its own label never reaches its features.
Only the fit is sampled: at most ``sample``
different labelled URLs, half of them of each class if there are as many, drawn by their
number of rows and the hash of the url (priority sampling) and weighted so that they stand
for all rows.  Every URL is scored.  All features are built-in expressions.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is scored like any other; with no labelled URL, or one class only, the
method's verdict is that class, or ``allow``; repeated rows get equal verdicts; a tie of the
trees (0.5) allows; long URLs are read whole; a null page_id has no label of a page; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let
from tessera.session import cut_lineage

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Host words that label a URL as blocked (seed list, a parameter).
BLOCK_WORDS = ("casino", "bets", "pills", "adult", "spam", "ads-")
FEATURES = ("length", "host_length", "labels", "hyphens", "depth", "digit_ratio", "entropy", "params", "segment_length",
            "suffix_rate", "segment_rate")
#: A suffix or segment table up to this size is broadcast, a larger one joined by shuffle.
BROADCAST_BYTES = 32 << 20
FOLDS, SMOOTHING = 5, 10
SAMPLE, _UPPER, _LOWER = 20_000, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))  # a null url has no position
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(tail, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: Column) -> Column:
    """Bits per character."""
    def of(chars: Column) -> Column:
        # over the sorted characters: the running character, its number so far, and the sum of n log n of those before
        start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
        done = lambda a: a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"])).otherwise(0.0)
        step = lambda a, x: F.when(x == a["c"], F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))) \
            .otherwise(F.struct(x.alias("c"), F.lit(1.0).alias("n"), done(a).alias("s")))
        n = F.size(chars).cast("double")
        return F.log2(n) - F.aggregate(chars, start, step, done) / n
    return F.when(F.char_length(s) == 0, F.lit(0.0)).otherwise(let(F.array_sort(F.split(s, "")), of))


def lexical(rows: DataFrame) -> DataFrame:
    """Feature columns from url, host and path (url not null)."""
    u, host, path = F.col("u"), F.col("host"), F.col("path")
    n = F.greatest(F.char_length(u), F.lit(1))
    count = lambda c, chars: (F.char_length(c) - F.char_length(F.translate(c, chars, ""))).cast("double")
    segment = F.regexp_extract(path, r"^/([^/]*)", 1)
    return rows.withColumns({
        "length": F.char_length(u).cast("double"), "host_length": F.char_length(host).cast("double"),
        "labels": count(host, "."), "hyphens": count(host, "-"), "depth": count(path, "/"),
        "digit_ratio": count(u, "0123456789") / n, "entropy": _entropy(host),
        "params": count(u, "=&"), "segment_length": F.char_length(segment).cast("double"),
        "suffix": F.substring_index(host, ".", -1), "segment": segment})


def _fold(u: Column) -> Column:
    return F.pmod(F.xxhash64(u, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _rates(labelled: DataFrame, key: str) -> DataFrame:
    """Labelled and blocked rows of each value of ``key``, by fold; broadcast if its measured size allows it."""
    by_fold = lambda x: F.array(*[F.sum(F.when(F.col("fold") == i, x).otherwise(0.0)) for i in range(FOLDS)])
    out = cut_lineage(labelled.groupBy(key).agg(by_fold(F.col("w").cast("double")).alias("n"), by_fold(F.col("w") * F.col("label")).alias("bad")))
    held = out.agg(F.sum(F.octet_length(key) + 16 * (FOLDS + 1))).first()[0]
    return F.broadcast(out) if held <= BROADCAST_BYTES else out


def _rate(prior: float) -> Column:
    """Smoothed share of blocked rows in the other folds."""
    others = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) - F.get(c, F.col("fold"))
    return F.coalesce((others(F.col("bad")) + SMOOTHING * F.lit(prior)) / (others(F.col("n")) + SMOOTHING), F.lit(prior))


def _sample(labelled: DataFrame, different: dict[float, int], sample: int) -> DataFrame:
    """u, label, w: different URLs of each label by priority w / uniform hash; the lowest weight is the
    priority of the first one left out, so the weights add up to all rows in expectation."""
    uniform = (F.xxhash64("u").bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    ranked = labelled.withColumn("priority", F.col("w") / uniform)
    out = None
    for label, n in different.items():
        k = min(n, max(sample // 2, sample - different[1.0 - label]))
        own = ranked.filter(F.col("label") == label).orderBy(F.desc("priority"), "u")
        floor = own.limit(k + 1).agg(F.min("priority")).first()[0] if n > k else 0.0
        part = own.limit(k).select("u", "label", F.greatest(F.col("w").cast("double"), F.lit(floor)).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


def judge(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url: str = "url", rules=RULES, block_words=BLOCK_WORDS,
          sample: int = SAMPLE, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block; null without a model)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("u"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    seeded = F.lit(False)
    for w in block_words:
        seeded = seeded | F.col("host").contains(w)
    label = F.when(seeded | (F.col("by_rule.verdict") == "block"), 1.0).when(F.col("by_rule.verdict") == "allow", 0.0)
    known = rows
    if labels is not None:
        bad = ((F.max(F.coalesce("toxic", F.lit(0))) > 0) | (F.min(F.coalesce("quality", F.lit(1))) < 1)).cast("double")
        known = rows.join(labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad")), "page_id", "left")
        label = F.coalesce(label, "bad")
    # one row per different labelled URL and label, w its rows
    labelled = cut_lineage(known.withColumn("label", label).filter("label is not null").groupBy("u", "label").agg(F.count(F.lit(1)).alias("w")))
    counts = {r["label"]: r for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("urls"), F.sum("w").alias("w")).collect()}
    n, blocked = sum(r["w"] for r in counts.values()), counts[1.0]["w"] if 1.0 in counts else 0
    out = [F.col(c) for c in ("page_id", "host", "path")] + [F.col("by_rule.rule").alias("rule")]
    if not n or blocked in (0, n):
        return rows.select(*out, F.coalesce("by_rule.verdict", F.lit("block" if n and blocked == n else "allow")).alias("verdict"),
                           F.lit(None).cast("double").alias("score"))
    prior = blocked / n
    split = lambda df: lexical(df.withColumns(dict(zip(("host", "path"), host_and_path(F.col("u"))))))
    keyed = split(labelled).select("suffix", "segment", _fold(F.col("u")).alias("fold"), "label", "w")
    rates = [(k, _rates(keyed, k)) for k in ("suffix", "segment")]

    def with_rates(df: DataFrame) -> DataFrame:
        df = df.withColumn("fold", _fold(F.col("u")))
        for key, table in rates:
            df = df.join(table, key, "left").withColumn(f"{key}_rate", _rate(prior)).drop("n", "bad")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    drawn = split(cut_lineage(_sample(labelled, {x: r["urls"] for x, r in counts.items()}, sample)))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, checkpointInterval=-1, weightCol="w") \
        .fit(with_rates(drawn).select("features", "label", "w"))
    scored = model.transform(with_rates(lexical(rows)))
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))
    return scored.select(*out, verdict.alias("verdict"), vector_to_array("probability")[1].alias("score"))
