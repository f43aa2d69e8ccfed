"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies and which file is used; both are parameters.
TOKENIZERS, VOCABULARY = os.environ.get("CREASE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
#: The usual split of a text before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text is encoded in pieces of about this many characters, so that memory stays bounded. A piece ends before a single
#: blank between two other characters, where the split above always ends a part too, so counts are exact.
PIECE = 100_000
CUT = re.compile(r"(?<=\S) (?=\S)")


def encoder(folder: str, vocabulary: str):
    """The encoder, kept for the life of a worker process (on the module of the tokenizer, as this one is not there)."""
    import tiktoken

    kept = vars(tiktoken).setdefault("crease_encoders", {})
    if (folder, vocabulary) in kept:
        return kept[folder, vocabulary]
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    kept[folder, vocabulary] = tiktoken.Encoding("crease", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[folder, vocabulary]


def with_tokens(documents: DataFrame, text: str = "text", out: str = "n_tokens", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents + the number of tokens of the whole text; NULL and empty texts have 0."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(folder, vocabulary)

        def size(t: str | None) -> int:
            total, at = 0, 0
            while t and at < len(t):
                cut = CUT.search(t, at + PIECE)
                end = cut.start() if cut else len(t)
                total += len(enc.encode_ordinary(t[at:end]))
                at = end
            return total

        for b in batches:
            yield b.map(size).astype("int64")

    return documents.withColumn(out, count(F.col(text)))


def hash31(*columns: Column | str) -> Column:
    """An even 31-bit hash of the columns, for orders and buckets."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31))
