"""Query keys for text preparation and scoring
(SURVEY 2.1 S9/S14, 2.2 P27-P29, 2.4 G21, 2.9 M9/M10, 2.3 J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import rouge as RG
from tessera.operators import sentence_graph as SG
from tessera.operators import text as TO
from tessera.plans import fixtures as X
from tessera.plans.registry import register

FEED_PAGE = 20      # articles per feed response


def _feed(spark, sf):
    """Landed feed responses: pages of at most FEED_PAGE articles (nested)."""
    a = X.articles(spark, sf)
    return (a.groupBy((F.col("doc_id") / FEED_PAGE).cast("bigint").alias("page"))
             .agg(F.collect_list(F.struct("doc_id", "title", "content")).alias("articles")))


def _toks_sql(col: str) -> str:
    return f"regexp_extract_all(coalesce({col}, ''), '{TX.TOKEN_PATTERN}')"


def _ids_sql(col: str, n: int) -> str:
    ids = f"list_transform({_toks_sql(col)}, lambda t: CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {TX.VOCAB_SIZE - 3} + 3 AS INTEGER))"
    seq = f"list_concat([{TX.BOS}], ({ids})[chunk_no * {n - 2} + 1:(chunk_no + 1) * {n - 2}], [{TX.EOS}])"
    return f"list_concat({seq}, list_transform(range({n} - len({seq})), lambda x: {TX.PAD}))"


def _mask_sql(col: str, n: int) -> str:
    nreal = f"least(greatest(len({_toks_sql(col)}) - chunk_no * {n - 2}, 0) + 2, {n})"
    return f"list_concat(list_transform(range({nreal}), lambda x: 1), list_transform(range({n} - {nreal}), lambda x: 0))"


def _chunks_sql(src: str, *cols: tuple[str, int]) -> str:
    n = ", ".join(f"ceil(len({_toks_sql(c)}) / {k - 2})" for c, k in cols)
    return f"(SELECT *, unnest(range(CAST(greatest(1, {n}) AS BIGINT))) AS chunk_no FROM {src}) c"


def _join(c):
    return F.array_join(c, " ")


@register("articles_explode", "SELECT CAST(doc_id // 20 AS BIGINT) AS page, doc_id, title, content FROM articles")
def q_articles_explode(spark, sf):
    return TO.explode_articles(_feed(spark, sf), keep=["page"])


@register("nonempty_text", "SELECT doc_id, title, content FROM articles WHERE length(content) > 0")
def q_nonempty_text(spark, sf):
    return TO.nonempty(X.articles(spark, sf))


@register("qa_pairs", "SELECT conv_id, turn, question, answer FROM qa")
def q_qa_pairs(spark, sf):
    return X.qa(spark, sf)


@register("tokenize_pad", f"""
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, array_to_string({_ids_sql('content', 512)}, ' ') AS input_ids,
       array_to_string({_mask_sql('content', 512)}, ' ') AS attention_mask,
       array_to_string({_ids_sql('content', 512)}, ' ') AS labels
FROM {_chunks_sql('articles WHERE length(content) > 0', ('content', 512))}""")
def q_tokenize_pad(spark, sf):
    t = TO.tokenize_pad(TO.nonempty(X.articles(spark, sf)), "content", 512)
    return t.select("doc_id", "chunk_no", _join("input_ids").alias("input_ids"), _join("attention_mask").alias("attention_mask"),
                    _join("labels").alias("labels"))


@register("tokenize_pairs", f"""
SELECT conv_id, turn, CAST(chunk_no AS INTEGER) AS chunk_no, array_to_string({_ids_sql('question', 128)}, ' ') AS input_ids,
       array_to_string({_mask_sql('question', 128)}, ' ') AS attention_mask,
       array_to_string({_ids_sql('answer', 128)}, ' ') AS labels FROM {_chunks_sql('qa', ('question', 128), ('answer', 128))}""")
def q_tokenize_pairs(spark, sf):
    t = TO.tokenize_pad(X.qa(spark, sf), "question", 128, labels_from="answer", label_length=128)
    return t.select("conv_id", "turn", "chunk_no", _join("input_ids").alias("input_ids"),
                    _join("attention_mask").alias("attention_mask"), _join("labels").alias("labels"))


def _words_sql(col):
    return f"regexp_extract_all(lower(coalesce({col}, '')), '{TX.WORD_PATTERN}')"


def _grams_sql(n: int) -> str:
    if n == 1:
        gp, gr = "unnest(wp)", "unnest(wr)"
    else:
        gp = "unnest(list_transform(range(0, len(wp) - 1), lambda i: wp[i + 1] || ' ' || wp[i + 2]))"
        gr = "unnest(list_transform(range(0, len(wr) - 1), lambda i: wr[i + 1] || ' ' || wr[i + 2]))"
    return f"""
p{n} AS (SELECT pair_id, gram, count(*) AS cp FROM (SELECT pair_id, {gp} AS gram FROM w) x GROUP BY ALL),
r{n} AS (SELECT pair_id, gram, count(*) AS cr FROM (SELECT pair_id, {gr} AS gram FROM w) x GROUP BY ALL),
h{n} AS (SELECT pair_id, sum(least(coalesce(cp, 0), coalesce(cr, 0))) AS hit, sum(coalesce(cp, 0)) AS np,
                sum(coalesce(cr, 0)) AS nr FROM p{n} FULL JOIN r{n} USING (pair_id, gram) GROUP BY pair_id),
s{n} AS (SELECT pair_id, coalesce(hit / nullif(np, 0), 0.0) AS p, coalesce(hit / nullif(nr, 0), 0.0) AS r FROM h{n})"""


ROUGE_SQL = f"""
WITH w AS (SELECT conv_id * 1000 + turn AS pair_id, {_words_sql('answer')} AS wp, {_words_sql('question')} AS wr FROM qa),
{_grams_sql(1)}, {_grams_sql(2)}
SELECT w.pair_id,
  coalesce(s1.p, 0.0) AS rouge1_p, coalesce(s1.r, 0.0) AS rouge1_r,
  CASE WHEN coalesce(s1.p, 0) + coalesce(s1.r, 0) > 0 THEN 2.0 * s1.p * s1.r / (s1.p + s1.r) ELSE 0.0 END AS rouge1_f,
  coalesce(s2.p, 0.0) AS rouge2_p, coalesce(s2.r, 0.0) AS rouge2_r,
  CASE WHEN coalesce(s2.p, 0) + coalesce(s2.r, 0) > 0 THEN 2.0 * s2.p * s2.r / (s2.p + s2.r) ELSE 0.0 END AS rouge2_f
FROM w LEFT JOIN s1 USING (pair_id) LEFT JOIN s2 USING (pair_id)"""


def _pairs(spark, sf):
    q = X.qa(spark, sf)
    return q.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "question", "answer")


@register("rouge12", ROUGE_SQL)
def q_rouge12(spark, sf):
    return TO.rouge_n(_pairs(spark, sf), "pair_id", "answer", "question", (1, 2))


ROUGE_L_SQL = f"""
WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS pair_id, {_words_sql('answer')} AS wp, {_words_sql('question')} AS wr FROM qa),
t(pair_id, i, best) AS (
  SELECT pair_id, 0, list_transform(range(len(wr) + 1), lambda x: 0) FROM w
  UNION ALL
  SELECT pair_id, i + 1, list_transform(range(len(cand)), lambda j: list_max(cand[1:j + 1])) FROM (
    SELECT t.pair_id, t.i, list_transform(range(len(wr) + 1), lambda j: CASE WHEN j > 0 AND wr[j] = wp[i + 1]
             THEN greatest(best[j + 1], best[j] + 1) ELSE best[j + 1] END) AS cand
    FROM t JOIN w USING (pair_id) WHERE t.i < len(wp)) s),
l AS (SELECT pair_id, len(wp) AS np, len(wr) AS nr, CAST(best[len(wr) + 1] AS BIGINT) AS lcs FROM t JOIN w USING (pair_id) WHERE i = len(wp)),
r AS (SELECT *, coalesce(lcs / nullif(np, 0), 0.0) AS p, coalesce(lcs / nullif(nr, 0), 0.0) AS r FROM l)
SELECT pair_id, lcs, p AS "rougeL_p", r AS "rougeL_r", CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS "rougeL_f" FROM r"""


@register("rouge_l", ROUGE_L_SQL)
def q_rouge_l(spark, sf):
    return TO.rouge_l(_pairs(spark, sf), "pair_id", "answer", "question")


@register("rouge_lsum")
def q_rouge_lsum(spark, sf):
    return RG.rouge_lsum(_pairs(spark, sf), "pair_id", "answer", "question")


SAMPLES, SEED = 200, 11


def _mix_sql(x: str, name: str, src: str) -> str:
    """CTEs ``name``: the columns of ``src`` and m, the 32-bit finaliser of ``x``."""
    def shift(c, n):
        return f"xor({c}, {c} >> {n})"
    return f"""{name}_1 AS (SELECT *, {x} AS m1 FROM {src}),
{name}_2 AS (SELECT *, ({shift('m1', 16)} * {RG.MULT1}::UBIGINT) % 4294967296::UBIGINT AS m2 FROM {name}_1),
{name}_3 AS (SELECT *, ({shift('m2', 13)} * {RG.MULT2}::UBIGINT) % 4294967296::UBIGINT AS m3 FROM {name}_2),
{name} AS (SELECT * EXCLUDE (m1, m2, m3), {shift('m3', 16)} AS m FROM {name}_3)"""


SCORES = [f"rouge{n}_{c}" for n in "12" for c in "prf"]
BOOTSTRAP_SQL = f"""
WITH rg AS ({ROUGE_SQL}),
k AS (SELECT *, md5('{SEED}|' || pair_id) AS hex FROM rg),
h AS (SELECT * EXCLUDE (hex), ('0x' || substr(hex, 1, 8))::UBIGINT AS hi, ('0x' || substr(hex, 9, 8))::UBIGINT AS lo FROM k),
b AS (SELECT h.*, s.sample FROM h, (SELECT unnest(range({SAMPLES})) AS sample) s),
{_mix_sql(f"(hi + (sample::UBIGINT * {RG.STEP}::UBIGINT) % 4294967296::UBIGINT) % 4294967296::UBIGINT", "x", "b")},
y0 AS (SELECT * EXCLUDE (m), xor(m, lo) AS m0 FROM x),
{_mix_sql("m0", "y", "y0")},
z AS (SELECT *, {' + '.join(f"(m >= {m})::INTEGER" for m in RG.MARKS)} AS w FROM y),
means AS (SELECT sample, {', '.join(f"sum(w * {c}) / sum(w) AS {c}" for c in SCORES)} FROM z GROUP BY sample HAVING sum(w) > 0),
long AS (UNPIVOT means ON {', '.join(SCORES)} INTO NAME score VALUE v)
SELECT score, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.5), 9) AS mid, round(quantile_cont(v, 0.975), 9) AS high
FROM long GROUP BY score"""


@register("rouge_bootstrap", BOOTSTRAP_SQL)
def q_rouge_bootstrap(spark, sf):
    scores = TO.rouge_n(_pairs(spark, sf), "pair_id", "answer", "question", (1, 2))
    out = RG.bootstrap_scores(scores, "pair_id", SCORES, SAMPLES, 0.95, SEED)
    return out.select("score", *[F.round(c, 9).alias(c) for c in ("low", "mid", "high")])


SUMMARY_SQL = f"""
WITH a AS (SELECT doc_id, content FROM articles WHERE length(content) > 0),
s0 AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(content, ''), '{TO.SENTENCE_END}', '\\1' || chr(1), 'g'),
                                            '[' || chr(1) || chr(10) || ']+') AS parts FROM a),
s1 AS (SELECT doc_id, unnest(range(0, len(parts))) AS sid, unnest(parts) AS s FROM s0),
sent AS (SELECT * FROM s1 WHERE length(trim(s)) > 0),
wds AS (SELECT doc_id, sid, unnest({_words_sql('s')}) AS w FROM sent),
tf AS (SELECT doc_id, w, count(*) AS tf FROM wds GROUP BY ALL),
sc AS (SELECT doc_id, sid, sum(tf) AS score FROM wds JOIN tf USING (doc_id, w) GROUP BY ALL),
ss AS (SELECT sent.*, sc.score, len({_words_sql('s')}) AS ntok FROM sent JOIN sc USING (doc_id, sid)),
cum AS (SELECT *, sum(ntok) OVER (PARTITION BY doc_id ORDER BY score DESC, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ss)
SELECT doc_id, string_agg(CASE WHEN c > 150 THEN array_to_string(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+')[1:(150 - (c - ntok))::BIGINT], ' ') ELSE trim(s) END, ' ' ORDER BY sid) AS summary,
       sum(least(ntok, 150 - (c - ntok))) AS summary_tokens
FROM cum WHERE c - ntok < 30 OR c <= 150 GROUP BY doc_id"""


@register("summarize", SUMMARY_SQL)
def q_summarize(spark, sf):
    return TO.summarize(TO.nonempty(X.articles(spark, sf)), "doc_id", "content", 30, 150)


def _round_sql(i: int) -> str:
    """One round of the power iteration over the sentence graph: p<i> from p<i - 1>."""
    return f"""y{i} AS (SELECT doc_id, w, sum(v * p / deg) AS y FROM vec JOIN deg USING (doc_id, sid) JOIN p{i - 1} USING (doc_id, sid) GROUP BY ALL),
p{i} AS MATERIALIZED (SELECT doc_id, sid, {SG.DAMPING} + {1 - SG.DAMPING} * sum(v * y) AS p FROM vec JOIN y{i} USING (doc_id, w) GROUP BY ALL)"""


GRAPH_SQL = f"""
WITH RECURSIVE a AS (SELECT doc_id, content FROM articles WHERE length(content) > 0),
s0 AS (SELECT doc_id, regexp_split_to_array(regexp_replace(content, '{TO.SENTENCE_END}', '\\1' || chr(1), 'g'), '[' || chr(1) || chr(10) || ']+') AS parts FROM a),
s1 AS (SELECT doc_id, unnest(range(0, len(parts))) AS sid, unnest(parts) AS s FROM s0),
sent AS MATERIALIZED (SELECT * FROM (SELECT *, len({_words_sql('s')}) AS ntok FROM s1) x WHERE ntok > 0),
wds AS (SELECT doc_id, sid, w, count(*) AS c FROM (SELECT doc_id, sid, unnest({_words_sql('s')}) AS w FROM sent) x GROUP BY ALL),
live AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id),
df AS (SELECT doc_id, w, count(*) AS df FROM wds GROUP BY ALL),
raw AS (SELECT doc_id, sid, w, c * ln(1 + n / df) AS v FROM wds JOIN df USING (doc_id, w) JOIN live USING (doc_id)),
vec AS MATERIALIZED (SELECT doc_id, sid, w, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, sid)) AS v FROM raw),
tot AS (SELECT doc_id, w, sum(v) AS y FROM vec GROUP BY ALL),
deg AS MATERIALIZED (SELECT doc_id, sid, sum(v * y) AS deg FROM vec JOIN tot USING (doc_id, w) GROUP BY ALL),
p0 AS (SELECT doc_id, sid, 1.0::DOUBLE AS p FROM sent),
{", ".join(_round_sql(i) for i in range(1, SG.ROUNDS + 1))},
pairs AS (SELECT x.doc_id, x.sid, y.sid AS other FROM vec x JOIN vec y USING (doc_id, w) GROUP BY ALL HAVING round(sum(x.v * y.v), 9) >= {SG.REDUNDANT}),
near AS (SELECT doc_id, sid, list(other) AS near FROM pairs GROUP BY ALL),
ranked AS MATERIALIZED (SELECT doc_id, sid, ntok, near, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, sid) AS k
  FROM sent JOIN p{SG.ROUNDS} USING (doc_id, sid) JOIN near USING (doc_id, sid)),
walk(doc_id, k, kept, used, go, sid, take) AS (
  SELECT doc_id, 0::BIGINT, []::BIGINT[], 0::BIGINT, true, NULL::BIGINT, NULL::BIGINT FROM live
  UNION ALL
  SELECT doc_id, k, CASE WHEN take > 0 THEN list_append(kept, sid) ELSE kept END, used + coalesce(take, 0), take IS NULL OR take > 0, sid, take FROM (
    SELECT w.doc_id, r.k, w.kept, w.used, r.sid, CASE WHEN list_has_any(w.kept, r.near) THEN NULL
      WHEN w.used + r.ntok <= 150 OR w.used < 30 THEN least(r.ntok, 150 - w.used) ELSE 0 END AS take
    FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.k = w.k + 1 WHERE w.go) x)
SELECT doc_id, string_agg(CASE WHEN take < ntok THEN array_to_string(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+')[1:take], ' ') ELSE trim(s) END, ' ' ORDER BY sid) AS summary,
       CAST(sum(take) AS BIGINT) AS summary_tokens
FROM walk JOIN sent USING (doc_id, sid) WHERE take > 0 GROUP BY doc_id"""


@register("graph_summary", GRAPH_SQL)
def q_graph_summary(spark, sf):
    return SG.graph_summary(TO.nonempty(X.articles(spark, sf)), "doc_id", "content", 30, 150)
