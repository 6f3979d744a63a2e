"""The deterministic hash embedder, vectorized over Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIM = 128
SEED, PRIME = 2166136261, 16777619  # fixed values


def term_hash(term: str) -> int:
    """A 32-bit hash of a word's characters, signed if there is one (fixed behaviour)."""
    h = SEED
    for c in term:
        h = ((h ^ ord(c)) * PRIME) & 0xFFFFFFFF
    return h - (1 << 32) if term and h >= 1 << 31 else h


def _vector(text: str | None, seen: dict[str, int]) -> np.ndarray:
    terms = re.split(r"\s+", unicodedata.normalize("NFKC", text or "").lower())
    for t in set(terms).difference(seen):
        seen[t] = term_hash(t)
    place = np.abs(np.array([seen[t] for t in terms], np.int64) + np.arange(len(terms))) % DIM
    v = np.bincount(place, minlength=DIM).astype(float)
    return v / np.linalg.norm(v)


def hash_vector(text: str | None) -> list[float]:
    """Counts of hashed words by place, with length one."""
    return _vector(text, {}).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def hash_embed(text: pd.Series) -> pd.Series:
    seen: dict[str, int] = {}  # of this batch
    return text.map(lambda t: _vector(t, seen))  # arrays, as lists of Python's numbers take four times as much
