"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; every function takes another one.
FOLDER = os.environ.get("TESSELLA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, carry..., n_tokens) of every row; null texts have no tokens."""
    path = os.path.join(folder, vocabulary)
    rows = docs.select(key, *carry, F.col(text).alias("_text"))
    schema = [f for f in rows.schema.fields if f.name != "_text"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.pop("_text")]
            yield b.assign(n_tokens=n)

    from pyspark.sql import types as T

    return rows.mapInPandas(count, T.StructType([*schema, T.StructField("n_tokens", T.LongType())]))
