"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import filled_frames

TOKENIZERS = os.environ.get("QUILLMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pre-split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = [], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, keep...) of all rows with an id; a null or empty text has 0 tokens. Whole texts are encoded."""
    path = os.path.join(folder, vocabulary)

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            n = np.array([len(encode(t)) if t else 0 for t in pdf.pop("text")], dtype=np.int64)
            pdf.insert(1, "n_tokens", n)
            yield pdf

    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[2:])
    return slim.mapInPandas(filled_frames(size), "id long, n_tokens long" + (", " + kept if kept else ""))
