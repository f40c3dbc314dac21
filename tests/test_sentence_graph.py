"""Sentence-graph summaries: scores equal the dense graph's, budgets hold, repeats are left out."""

import re

import numpy as np
import pyarrow as pa

from tessera.operators import sentence_graph as SG
from tessera.operators.text import token_blocks


def _dense(words, rounds=SG.ROUNDS, damping=SG.DAMPING):
    """Scores and cosines by the full matrix of sentence pairs."""
    vocab = sorted({w for ws in words for w in ws})
    m = np.array([[ws.count(w) for w in vocab] for ws in words], float)
    m *= np.log(1 + len(words) / (m > 0).sum(axis=0))
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = m @ m.T
    score = np.ones(len(words))
    for _ in range(rounds):
        score = damping + (1 - damping) * cos @ (score / cos.sum(axis=1))
    return score, cos


def test_scores_and_choice_equal_the_dense_graph():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        words = [[f"w{x}" for x in rng.zipf(1.6, int(rng.integers(1, 14))) % 25] for _ in range(n)]
        words += [list(words[0])] * 2
        n = len(words)
        number = {w: i for i, w in enumerate({w for ws in words for w in ws})}
        sent = np.repeat(np.arange(n), [len(ws) for ws in words])
        word = np.array([number[w] for ws in words for w in ws])
        score, cos = _dense(words)
        np.testing.assert_allclose(SG.centrality(*SG._vectors(sent, word, n), n), score, atol=1e-9)
        want, used = [], 0
        for i in sorted(range(n), key=lambda i: (-round(score[i], 9), i)):
            if any(round(cos[i, j], 9) >= 0.7 for j, _ in want):
                continue
            if used >= 15 and used + len(words[i]) > 40:
                break
            take = min(len(words[i]), 40 - used)
            if not take:
                break
            want.append((i, take))
            used += take
        assert SG.choose(sent, word, n, 15, 40, 0.7) == sorted(want)


def test_graph_summaries(spark):
    long = " ".join(f"Word{i}" for i in range(5000)) + "."
    rows = [(1, long), (2, None), (3, ""), (4, "... !"), (5, "Cats chase mice. " * 300), (6, long + " Short end here."), (7, "One two. Two three.\nThree one!"), (7, "One two.")]
    got = SG.graph_summary(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    by = {r.id: r for r in got if r.id != 7}
    assert set(by) == {1, 5, 6} and all(len(re.findall(r"\w+", r.summary)) == r.summary_tokens <= 150 for r in got)
    assert by[1].summary == " ".join(f"Word{i}" for i in range(150)) and by[5].summary == "Cats chase mice." and by[6].summary_tokens == 150
    assert sorted(r.summary for r in got if r.id == 7) == ["One two.", "One two. Two three. Three one!"]
    assert SG.graph_summary(spark.createDataFrame([], "id int, text string"), "id", "text").collect() == []


def test_texts_scored_in_runs_equal_texts_alone():
    rng = np.random.default_rng(8)
    texts = [[[f"w{x}" for x in rng.zipf(1.5, int(rng.integers(0, 12))) % 20] for _ in range(int(rng.integers(0, 15)))] for _ in range(60)]
    run = SG._pick(10, 30, 0.7)
    kind = pa.list_(pa.list_(pa.string()))
    alone = [run(pa.array([t], kind)).to_pylist()[0] for t in texts]
    assert run(pa.array(texts, kind)).to_pylist() == alone and any(len(p) > 1 for p in alone)
    blocks = list(token_blocks(pa.array(texts, kind), 50))
    assert len(blocks) > 10 and sum(len(n) for n, _, _ in blocks) == len(texts)
    assert [w for _, _, b in blocks for w in b.to_pylist()] == [w for t in texts for s in t for w in s]
    assert run(pa.array([], kind)).to_pylist() == []
