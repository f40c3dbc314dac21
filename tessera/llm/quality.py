"""Quality rules as one projection: a threshold table over text statistics.

Each statistic is a built-in expression, each rule a bound on one statistic, and
the table of rules compiles to one boolean column.  There is no shuffle and no
Python; a text is read once, whatever its length.

Defined cases: a null text counts as the empty text; it has no word, so it
fails ``min_words``.  A statistic that is a ratio is 0 where its base is 0.
Repeated rows and ties get equal results, extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(dict.fromkeys((
    "the of and to in is that for with as was on are from be this it by "
    "de la le et les des un une que est dans pour par sur qui "
    "der die und das den von zu ist mit sich auf ein eine dem im "
    "el en y los se del las por con para es al lo como").split()))


@dataclass(frozen=True)
class Rule:
    """``low <= statistic <= high``; None leaves a side open."""

    statistic: str
    low: float | None = None
    high: float | None = None


#: Bounds that hold for prose in any of the four languages, with room to spare.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_ratio", high=0.5),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.5),
)


def _repeat_words(grams: Column) -> Column:
    """Words inside 3-word windows that occur more than once, from the window hashes in order."""
    none = F.lit(0).cast("bigint")

    def covered(pairs: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            before, after = F.get(pairs, i - 1), F.get(pairs, i + 1)
            return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(pairs, repeated), lambda x: x["i"]))
        start = F.struct(none.alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), none).otherwise(let(pairs, covered))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``quality_stats`` (whatever other columns are called)."""
    t = text_of(text)
    chars = F.char_length(F.translate(t, SPACE, ""))
    symbols = (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("bigint")

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    lines = let(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), of_lines)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        grams = F.when(n >= 3, F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(
            x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.cast("bigint").alias("n_words"), let(grams, _repeat_words).alias("n_repeat_words"),
                        F.size(F.filter(w, lambda x: (F.length(x) <= 5) & x.isin(*STOP_WORDS))).alias("n_stop"))

    raw = F.struct(let(words_of(t), of_words).alias("w"), lines.alias("l"), chars.cast("bigint").alias("c"), symbols.alias("s"))

    def named(r: Column) -> Column:
        n = r["w"]["n_words"]
        ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
        return F.struct(
            n.alias("n_words"), r["c"].alias("word_chars"), r["s"].alias("n_symbols"),
            r["l"]["dup"].cast("bigint").alias("n_dup_lines"), r["w"]["n_repeat_words"].alias("n_repeat_words"),
            ratio(r["c"], n).alias("mean_word_chars"), ratio(r["s"], n).alias("symbol_ratio"),
            ratio(r["w"]["n_stop"], n).alias("stop_ratio"), ratio(r["l"]["dup"], r["l"]["n"]).alias("dup_line_ratio"),
            ratio(r["w"]["n_repeat_words"], n).alias("repeat_ratio"))

    return docs.withColumn("quality_stats", let(raw, named))


def passes(stats: Column, rules=RULES) -> Column:
    """The rule table as one boolean column; true when every bound holds."""
    out = F.lit(True)
    for r in rules:
        x = stats[r.statistic]
        if r.low is not None:
            out = out & (x >= r.low)
        if r.high is not None:
            out = out & (x <= r.high)
    return out


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    tagged = statistics(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    return tagged.filter(passes(F.col("quality_stats"), rules)).select("row.*")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Per row: the counts, ``base_failed`` and ``kept``."""
    s = F.col("quality_stats")
    tagged = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    base = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return tagged.select("doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         base.alias("base_failed"), (~base & passes(s, rules)).alias("kept"),
                         s["symbol_ratio"].alias("symbol_ratio"), s["stop_ratio"].alias("stop_ratio"))
