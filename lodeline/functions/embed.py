"""Hash embeddings: tokens hashed to signed buckets with log counts, unit length."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions.text import tokenize


def embed_text(text: str, dim: int) -> np.ndarray:
    out = np.zeros(dim)
    for token, n in Counter(tokenize(text)).items():
        digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
        out[int.from_bytes(digest[:4], "little") % dim] += (1.0 if digest[4] & 1 else -1.0) * (1.0 + np.log(n))
    size = np.linalg.norm(out)
    return out / size if size else out


def hash_embedding(text: Column, dim: int = 1024) -> Column:
    """Embedding of a text; all zero for one without tokens. Raises ValueError below 128 dimensions."""
    if dim < 128:
        raise ValueError("dim must be at least 128")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed_text(t, dim).astype(np.float32), na_action="ignore")

    return embed(text)
