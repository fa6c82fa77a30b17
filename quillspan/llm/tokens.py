"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter; nothing is trained or copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's words are cut.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``documents`` plus ``n_tokens``; 0 for null and empty texts. A map: no shuffle, whole texts.

    The vocabulary file is read once, where the query is made, and travels with the job: workers need no copy of it.
    """
    with open(path, "rb") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: about a megabyte

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(held.value)
        for texts in parts:
            yield texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return documents.withColumn("n_tokens", count("text"))
