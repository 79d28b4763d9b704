"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

#: Ranks of a byte-level BPE for tiktoken and the pattern that cuts texts into words for it. Both are parameters.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in pieces of about this many characters, cut at blanks, so no call grows with the longest text.
PIECE = 100_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> int:
    """Number of tokens of a text; strings of special tokens are ordinary text."""
    encode = encoder(vocabulary, pattern).encode_ordinary
    if len(text) <= PIECE:
        return len(encode(text))
    total = start = 0
    while start < len(text):
        stop = min(len(text), start + PIECE)
        cut = text.rfind(" ", start + 1, stop) if stop < len(text) else stop
        stop = cut if cut > start else stop
        total += len(encode(text[start:stop]))
        start = stop
    return total


def with_tokens(documents: DataFrame, columns: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``columns`` of the documents with their text's size, ``tokens``; null and blank texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[columns].copy()
            out["tokens"] = [token_count(t, vocabulary, pattern) if t and t.strip() else 0 for t in batch["text"]]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    return spread(documents.select(*columns, "text"), *columns).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", tokens long")
