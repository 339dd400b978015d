"""Operator 9: token counts by rank-synchronous merging of ragged pre-token arrays.

A null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated rows; other columns pass
through untouched, also where their names are taken (the counts then replace them). Special strings
inside a text count as one token each, as the library's default has it. Nothing is shuffled: a task holds
one Arrow batch, works through it in slices of about a million characters and keeps a bounded table of
words whose counts it knows. A pre-token of any length is merged in the same arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PreTokenizer, merge_words, table_from_json
from .common import in_chunks, table, trim

#: Words kept per task, and the length up to which a word is kept.
KNOWN_WORDS, KNOWN_LENGTH = 400_000, 64
LIMIT = 512


def _counts(texts: list[str], pre: PreTokenizer, pairs, known: dict[str, int]) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for a, b in in_chunks(texts):
        words, sizes = [], []
        for t in texts[a:b]:
            w = pre(t)
            sizes.append(len(w))
            words += w
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            known.update(dict.fromkeys(pre.specials, 1))
            new = [w for w in set(words) if w not in known]
        mine = known
        if new:
            _, n = merge_words([w.encode() for w in new], pairs)
            fresh = dict(zip(new, n.tolist()))
            known.update((w, k) for w, k in fresh.items() if len(w) <= KNOWN_LENGTH)
            if any(len(w) > KNOWN_LENGTH for w in new):
                mine = known | fresh
        got = np.fromiter(map(mine.__getitem__, words), np.int64, len(words))
        ends = np.cumsum(np.asarray(sizes, np.int64))
        sums = np.r_[0, np.cumsum(got)]
        out[a:b] = sums[ends] - sums[ends - sizes]
    return out


def count_tokens(text: Column, tokenizer_path: str, pattern: str) -> Column:
    """The number of tokens of a string column under a byte-level BPE tokenizer file."""

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs, specials = table_from_json(tokenizer_path)
        pre = PreTokenizer(pattern, specials)
        known = dict.fromkeys(specials, 1)
        for s in batches:
            trim()
            yield pd.Series(_counts(s.tolist(), pre, pairs, known))

    return n_tokens(F.coalesce(text, F.lit("")))


def with_token_counts(df: DataFrame, tokenizer_path: str, pattern: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit."""
    counted = df.withColumn("n_tokens", count_tokens(F.col(text), tokenizer_path, pattern))
    return counted.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
