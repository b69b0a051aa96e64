"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern that belongs to these ranks (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_batches(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = _encoding(path)
            counts = [None if t is None else len(enc.encode_ordinary(t)) for t in b.column(column).to_pylist()]
            i = b.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(b.columns) if j != i), pa.array(counts, pa.int64())], names=[*(n for n in b.schema.names if n != column), "tokens"])

    return run


def with_token_counts(df: DataFrame, text: str | Column = "text", path: str = TOKENIZER) -> DataFrame:
    """*df* without its text but with ``tokens BIGINT``: null for null texts, 0 for empty ones."""
    rest = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*rest, F.col(text) if isinstance(text, str) else text).mapInArrow(_count_batches(path, text), f"{schema + ', ' if rest else ''}tokens long")
