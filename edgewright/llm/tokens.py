"""Token counts and token edges of texts under a public byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default place of the vocabulary; every operator takes another as a parameter. It must exist on all executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text into words before merging bytes.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Classes of token edges, best last.
ANY, WORD, SENTENCE, LINE, PARAGRAPH = range(5)


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The encoder of a worker and the byte length of each of its tokens."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), lengths


#: The encoder's own splitter runs out of stack on longer runs of white space.
_LONG_BLANK = re.compile(r"\s{20000}")


def encode(vocabulary: str, text: str) -> list[int]:
    own = encoder(vocabulary)[0]
    if len(text) > 20_000 and _LONG_BLANK.search(text):
        return [i for word in regex.findall(WORDS, text) for i in own._encode_single_piece(word)]
    return own.encode_ordinary(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null or empty."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(vocabulary, t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


def edges_of(text: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token index, character offset, class) of each token edge that does not split a character; 0 and the end included."""
    ids = encode(vocabulary, text)
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(encoder(vocabulary)[1][np.asarray(ids, dtype=np.int64)])])
    begins = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(begins)])
    padded = np.concatenate([np.zeros(4, dtype=np.uint8), data, np.zeros(2, dtype=np.uint8)])
    whole = np.concatenate([begins, [True]])[at]
    index, at = np.flatnonzero(whole), at[whole]
    p3, p2, p1, n1 = (padded[at + k] for k in (1, 2, 3, 4))
    blank = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
    stop = (p1 == 46) | (p1 == 33) | (p1 == 63)
    wide_stop = ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x82)) | ((p3 == 0xEF) & (p2 == 0xBC) & ((p1 == 0x81) | (p1 == 0x9F)))
    line = (p1 == 10) | (p1 == 13)
    kind = np.zeros(len(at), dtype=np.int8)
    kind[blank(n1) | blank(p1)] = WORD
    kind[(stop & blank(n1)) | wide_stop] = SENTENCE
    kind[line] = LINE
    kind[line & ((p2 == 10) | ((p3 == 10) & (p2 == 13)))] = PARAGRAPH
    kind[-1] = PARAGRAPH
    return index, chars[at], kind
