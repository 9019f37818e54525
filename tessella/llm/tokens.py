"""Token counts of a public subword tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank file of a public byte-level BPE vocabulary; override per call or by this variable.
DEFAULT_TOKENIZER = os.environ.get("TESSELLA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: The public pre-tokenization pattern of that byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """Number of tokens of the whole text; null and empty texts have 0."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return count(F.coalesce(text, F.lit("")))
