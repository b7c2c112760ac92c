"""Tokens of a public byte-level vocabulary; its file is a parameter and is read on the executors."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

VOCABULARY = os.environ.get("TIDEWIRE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern that splits texts before merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The encoder and the byte length of each token; once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    return encoding(path)[0].encode_to_numpy(text, disallowed_special=())


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoding(path)[0].encode_ordinary(text))
