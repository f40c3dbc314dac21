"""Column-level text helpers: tokenisation and a seeded hashing vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word pieces: runs of letters, runs of digits, or one other visible character.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]"
# ROUGE-style words: lower-cased runs of letters/digits.
WORD_PATTERN = r"[\p{L}\p{N}]+"

# Special ids (sequence-to-sequence convention): begin, pad, end.
BOS, PAD, EOS = 0, 1, 2
VOCAB_SIZE = 50265


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def tokens(text) -> Column:
    """All word pieces of the whole text, in order."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN_PATTERN), 0)


def words(text) -> Column:
    """Lower-cased words of the whole text (ROUGE tokenisation)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD_PATTERN), 0)


def token_id(tok: Column, vocab_size: int = VOCAB_SIZE) -> Column:
    """Hashing vocabulary: md5 of the piece mapped above the special ids."""
    h = F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(vocab_size - 3) + F.lit(3)).cast("int")


def encode_tokens(toks: Column, max_length: int, vocab_size: int = VOCAB_SIZE) -> Column:
    """``[BOS] + ids + [EOS]`` truncated to ``max_length`` and padded with PAD.

    Truncation happens on the token array, so only kept pieces are hashed."""
    body = F.transform(F.slice(toks, 1, max_length - 2), lambda t: token_id(t, vocab_size))
    seq = F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS)))
    pad = F.array_repeat(F.lit(PAD), F.lit(max_length) - F.size(seq))
    return F.concat(seq, pad)


def mask_tokens(toks: Column, max_length: int) -> Column:
    """1 for real positions (incl. BOS/EOS), 0 for padding."""
    n_real = F.least(F.size(toks) + 2, F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), F.lit(max_length) - n_real))


def encode(text, max_length: int, vocab_size: int = VOCAB_SIZE) -> Column:
    return encode_tokens(tokens(text), max_length, vocab_size)


def attention_mask(text, max_length: int) -> Column:
    return mask_tokens(tokens(text), max_length)
