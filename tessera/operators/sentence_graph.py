"""Summaries by the graph of a text's sentences.

Sentences are linked by the cosine of their weighted words (count times
``ln(1 + sentences / sentences with the word)``) and scored by damped power iteration on that graph.
The graph is a product of the (sentence x word) matrix with its transpose, so a round takes two passes
over a text's words and no pair of sentences is ever formed.  Sentences are then taken best first, but
not one that is as similar as ``redundant`` to one already taken, up to the token budget.

A text is scored in the task that reads it: nothing is shuffled.  Texts are scored in runs, whose graph
falls into one part per text.  Memory: an Arrow batch, and the words of a run or of one longer text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators.text import picked_summary, picks, token_blocks

ROUNDS, DAMPING, REDUNDANT = 20, 0.15, 0.7


def _vectors(sent: np.ndarray, word: np.ndarray, n: int, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, word, weight) of unit sentence vectors, from the sentence and the word of each token.

    ``doc`` is the text of each sentence where there are several; texts share no word number."""
    width = int(word.max()) + 1
    pair, count = np.unique(sent.astype(np.int64) * width + word, return_counts=True)
    s, t = pair // width, pair % width
    doc = np.zeros(n, np.int64) if doc is None else doc
    live = np.bincount(doc[np.bincount(sent, minlength=n) > 0])
    v = count * np.log(1 + live[doc[s]] / np.bincount(t)[t])
    return s, t, v / np.sqrt(np.bincount(s, v * v, n))[s]


def centrality(s: np.ndarray, t: np.ndarray, v: np.ndarray, n: int, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Scores with mean 1 over the sentences that have words."""
    def spread(x):
        return np.bincount(s, v * np.bincount(t, v * x[s])[t], n)
    degree = spread(np.ones(n))
    degree[degree == 0] = 1
    score = np.ones(n)
    for _ in range(rounds):
        score = damping + (1 - damping) * spread(score / degree)
    return score


def choose(sent: np.ndarray, word: np.ndarray, n: int, min_tokens: int, max_tokens: int, redundant: float,
           doc: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(sentence, words taken of it), in order of the text, or of the texts: ``doc`` as in ``_vectors``, ascending."""
    if not len(sent):
        return []
    doc = np.zeros(n, np.int64) if doc is None else doc
    s, t, v = _vectors(sent, word, n, doc)
    size = np.bincount(sent, minlength=n)
    order = np.lexsort((np.arange(n), -np.round(centrality(s, t, v, n), 9), doc))
    order = order[size[order] > 0]
    ends = np.concatenate([np.flatnonzero(np.diff(doc[order])) + 1, [len(order)]]).tolist()
    at = np.searchsorted(s, np.arange(n + 1)).tolist()      # where each sentence's weights begin
    out, barred, own, first = [], np.zeros(n, bool), np.zeros(int(t.max()) + 1), 0
    for end in ends:
        low, high = int(order[first:end].min()), int(order[first:end].max()) + 1
        text, used = slice(at[low], at[high]), 0
        for i in order[first:end].tolist():
            if barred[i]:
                continue
            if used >= min_tokens and used + size[i] > max_tokens:
                break
            take = min(int(size[i]), max_tokens - used)
            if take <= 0:
                break
            out.append((i, take))
            used += take
            mine = slice(at[i], at[i + 1])
            own[t[mine]] = v[mine]
            barred[low:high] |= np.round(np.bincount(s[text] - low, v[text] * own[t[text]], high - low), 9) >= redundant
            own[t[mine]] = 0
        first = end
    return sorted(out)


def _pick(min_tokens: int, max_tokens: int, redundant: float):
    def run(words: pa.Array) -> pa.Array:
        out = []
        for n_sents, size, word in token_blocks(words):
            doc, sent = np.repeat(np.arange(len(n_sents)), n_sents), np.repeat(np.arange(len(size)), size)
            code = word.dictionary_encode().indices.to_numpy().astype(np.int64)
            # one number for each word of each text
            number = np.unique(doc[sent] * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
            sid, take = np.array(choose(sent, number, len(size), min_tokens, max_tokens, redundant, doc), np.int64).reshape(-1, 2).T
            first = np.cumsum(n_sents) - n_sents
            out.append(picks(np.bincount(doc[sid], minlength=len(n_sents)), sid - first[doc[sid]], take))
        return pa.concat_arrays(out) if out else picks(*[np.zeros(0, np.int64)] * 3)
    return run


def graph_summary(df: DataFrame, key: str, text: str, min_tokens: int = 30, max_tokens: int = 150, redundant: float = REDUNDANT) -> DataFrame:
    """``key``, ``summary`` and ``summary_tokens`` of each row whose text has a word.

    The summary has at most ``max_tokens`` words; while it has fewer than ``min_tokens`` a sentence that does not fit is
    cut to its first words.  Ties go to the earlier sentence.  A null text, or one without words, gives no row;
    repeated rows give repeated rows; whole texts are read."""
    return picked_summary(df, key, text, _pick(min_tokens, max_tokens, redundant))
