"""HTML metric extraction and text preparation."""
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import extract as E
from tessera.operators import text as TO

PAGE = ("<table>\n<tr><td>Market Cap</td><td class=\"v\"><span>1.25T</span></td></tr>\n"
        "<tr><td>Trailing P/E</td><td><span>21,345.5</span></td></tr>\n"
        "<tr><td>Price/Sales</td><td><span>N/A</span></td></tr>\n"
        "<tr><td>Revenue</td><td><span>3.5B</span></td></tr>\n"
        "<tr><td>EBITDA</td><td><span>12.2%</span></td></tr>\n</table>")
BACKUP = "<tr><td>Revenue (ttm)</td><td><b>-</b></td></tr>\n<tr><td>Total Debt to Equity</td><td><b>45.1M</b></td></tr>\n"

def test_extract_and_clean(spark):
    pages = spark.createDataFrame([("AAA", PAGE)], "ticker string, html string")
    m = ["Market Cap", "Trailing P/E", "Price/Sales", "Revenue", "EBITDA", "Total Debt/Equity"]
    got = {r.metric: (r.raw, r.value) for r in
           E.extract_metrics(pages, m).withColumn("value", E.clean_number("raw")).collect()}
    assert got["Market Cap"][1] == pytest.approx(1.25e12)
    assert got["Trailing P/E"][1] == pytest.approx(21345.5)
    assert got["Price/Sales"] == ("N/A", None)
    assert got["Revenue"][1] == pytest.approx(3.5e9)
    assert got["EBITDA"][1] == pytest.approx(12.2)
    assert got["Total Debt/Equity"] == (None, None)


def test_fallback_and_status(spark):
    prim = spark.createDataFrame([("AAA", PAGE), ("BBB", "x " + E.NO_DATA_MARKER)], "ticker string, html string")
    back = spark.createDataFrame([("AAA", BACKUP + "no results")], "ticker string, html string")
    fb = {(r.ticker, r.metric): (r.value, r.source) for r in
          E.fallback(prim, back, ["Total Debt/Equity", "Revenue", "EBITDA"]).collect()}
    assert fb[("AAA", "Total Debt/Equity")] == (pytest.approx(45.1e6), "backup")
    assert fb[("AAA", "Revenue")] == (pytest.approx(3.5e9), "primary")
    assert ("BBB", "Revenue") not in fb       # a no-data page yields nothing
    st = {r.ticker: (r.primary_status, r.backup_status) for r in E.page_status(prim, back).collect()}
    assert st == {"AAA": ("ok", "bad"), "BBB": ("no_data", "missing")}


def test_sector_code(spark):
    df = spark.createDataFrame([('<a">Energy</span>',), ("<b>nothing</b>",)], "html string")
    assert [r.s for r in df.select(E.sector_code("html").alias("s")).collect()] == [9, None]


def test_tokenize_pad(spark):
    df = spark.createDataFrame([(1, "Hello, world! 42"), (2, "")], "id int, text string")
    t = {r.id: r for r in TO.tokenize_pad(df, "text", 8).collect()}
    assert len(t[1].input_ids) == 8 and t[1].input_ids[0] == TX.BOS
    assert t[1].input_ids[6] == TX.EOS and t[1].input_ids[7] == TX.PAD   # 5 pieces + BOS + EOS
    assert t[1].attention_mask == [1] * 7 + [0]
    assert t[2].input_ids == [TX.BOS, TX.EOS] + [TX.PAD] * 6
    assert t[1].labels == t[1].input_ids


def _rouge_py(pred, ref, n):
    import re
    from collections import Counter
    def grams(s):
        w = re.findall(r"[^\W_]+", s.lower())
        return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    p, r = grams(pred), grams(ref)
    hit = sum((p & r).values())
    pr = hit / sum(p.values()) if p else 0.0
    rc = hit / sum(r.values()) if r else 0.0
    return pr, rc, (2 * pr * rc / (pr + rc) if pr + rc else 0.0)


def test_rouge(spark):
    pairs = [(1, "the cat sat on the mat", "the cat is on the mat"), (2, "a b c", ""), (3, "x y", "x y")]
    df = spark.createDataFrame(pairs, "id int, pred string, ref string")
    both = {r.id: r for r in TO.rouge_n(df, "id", "pred", "ref", (1, 2)).collect()}
    for n in (1, 2):
        got = {r.id: r for r in TO.rouge_n(df, "id", "pred", "ref", n).collect()}
        assert all(getattr(both[i], f"rouge{n}_f") == getattr(got[i], f"rouge{n}_f") for i in got)
        for i, p, r in pairs:
            exp = _rouge_py(p, r, n)
            assert (getattr(got[i], f"rouge{n}_p"), getattr(got[i], f"rouge{n}_r"), getattr(got[i], f"rouge{n}_f")) \
                == pytest.approx(exp)
    rl = {r.id: r.lcs for r in TO.rouge_l(df, "id", "pred", "ref").collect()}
    assert rl == {1: 5, 2: 0, 3: 2}


def test_summarize_budget(spark):
    text = ". ".join(f"Sentence {i} about markets and stocks and rates" for i in range(40)) + "."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    s = TO.summarize(df, "id", "text", 30, 150).first()
    assert 30 <= s.summary_tokens <= 150
    assert s.summary.startswith("Sentence")


def test_feed_explode(spark):
    feed = spark.createDataFrame([(1, [("t1", "c1"), ("t2", "")])],
                                 "page int, articles array<struct<title:string,content:string>>")
    arts = TO.nonempty(TO.explode_articles(feed, keep=["page"]))
    assert [(r.title, r.content) for r in arts.collect()] == [("t1", "c1")]


def test_summaries_are_bounded(spark):
    word = re.compile(r"[^\W_]+")
    long = " ".join(f"Word{i}" for i in range(5000))
    rows = [(1, long), (2, "Short one. " + long + ". Another."), (3, "A b c. " * 200), (4, "tiny")]
    got = {r.id: r for r in TO.summarize(spark.createDataFrame(rows, "id int, text string"), "id", "text", 30, 150).collect()}
    assert all(len(word.findall(r.summary)) == r.summary_tokens <= 150 for r in got.values())
    assert got[1].summary == " ".join(f"Word{i}" for i in range(150)) and got[4].summary_tokens == 1 and got[2].summary_tokens == 150


def _texts(n):
    rnd = __import__("random").Random(4)
    return [(i, *[None if rnd.random() < 0.05 else "".join(rnd.choice("ab cd e.f\n !G") for _ in range(rnd.randrange(0, 400))) for _ in "pr"]) for i in range(n)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rouge_of_own_keys_shuffles_nothing_and_shared_keys_are_summed(spark):
    df = spark.createDataFrame(_texts(60), "id int, pred string, ref string")
    got = TO.rouge_n(df, "id", "pred", "ref", (1, 2, 3))
    assert "Exchange" not in _plan(got) and "Sort" not in _plan(got)
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, "a b b", "b"), (None, "b", "b c b"), (99, "x", "x")], df.schema))
    both = {r.id: r for r in TO.rouge_n(twice, "id", "pred", "ref", (1, 2, 3)).collect()}
    rows = got.collect()
    assert len(both) == len(rows) + 2 == 62 and all(both[r.id] == r for r in rows)      # doubled counts, equal shares
    assert (both[None].rouge1_p, both[None].rouge1_r) == (0.75, 0.75) and both[99].rouge1_f == 1.0


def test_summaries_of_own_keys_shuffle_nothing_and_equal_the_counts_by_key(spark):
    df = spark.createDataFrame([r[:2] for r in _texts(80)] + [(None, "no key"), (80, ""), (81, "... !")], "id int, text string")
    got = TO.summarize(df, "id", "text", 10, 25)
    assert "Exchange" not in _plan(got) and "Sort" not in _plan(got)
    want = TO._shared_summary(df.filter("id is not null"), "id", "text", 10, 25)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 60
    mixed = TO.summarize(df.unionByName(spark.createDataFrame([(5, "One more. Text here!")], df.schema)), "id", "text", 10, 25)
    assert {tuple(r) for r in mixed.collect() if r.id != 5} == {tuple(r) for r in got.collect() if r.id != 5}
    assert [r.summary_tokens <= 25 for r in mixed.collect() if r.id == 5] == [True]
