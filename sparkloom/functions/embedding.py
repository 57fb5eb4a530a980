"""Hashed embeddings: an Arrow UDF, as BLAKE2b isn't among Spark's hashes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[\w一-鿿]+")


def embed_text(text: str | None, size: int) -> list[float]:
    """Signed counts of hashed tokens, of length one (all zero without tokens)."""
    v = np.zeros(size)
    for token in _TOKEN.findall((text or "").lower()):
        h = hashlib.blake2b(token.encode(), digest_size=16).digest()
        v[int.from_bytes(h[:8], "little") % size] += 1.0 if h[8] & 1 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def hash_embedding(size: int = 384):
    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: embed_text(x, size))

    return run
