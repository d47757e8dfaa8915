"""Token counts under a public byte-pair vocabulary; nothing here is trained."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

#: Folder of the vocabulary files; a parameter of every caller.
DEFAULT_VOCABULARY = os.environ.get("LEAFSTACK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a ``.tiktoken`` rank file, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens of ``text``; 0 for null and empty texts. Whole texts, Arrow batches."""

    @F.pandas_udf("int")
    def counted(values: pd.Series) -> pd.Series:
        encode = encoding(vocabulary).encode_ordinary
        return pd.Series([len(encode(v)) if v else 0 for v in values], dtype="int32")

    return counted(text)


def token_slice(text: str, start: int, end: int, vocabulary: str = DEFAULT_VOCABULARY) -> bytes:
    """Bytes of tokens ``[start, end)`` of ``text``; the slices of a text join up to its UTF-8 bytes."""
    enc = encoding(vocabulary)
    return b"".join(enc.decode_single_token_bytes(t) for t in enc.encode_ordinary(text)[start:end])
