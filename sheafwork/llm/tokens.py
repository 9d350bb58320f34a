"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches; the vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty texts. Special strings count as ordinary text."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path)
        return texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)
