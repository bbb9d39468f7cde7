"""Small helpers that run inside Arrow tasks."""

from __future__ import annotations

from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets everything once it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def private(*names: str):
    """For an operator on ``docs`` that uses columns of these names itself: the caller's columns of such names (in any case) stand aside under others meanwhile."""
    mine = {n.lower() for n in names}

    def guard(f):
        @wraps(f)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            clash = [c for c in docs.columns if c.lower() in mine]
            if not clash:
                return f(docs, *args, **options)
            longest = max(map(len, docs.columns))
            aside = {c: f"aside_{i}_".ljust(longest + 8, "x") for i, c in enumerate(clash)}  # longer than any of the caller's
            options = {k: aside.get(v, v) if isinstance(v, str) and k.endswith("_col") else v for k, v in options.items()}
            return f(docs.withColumnsRenamed(aside), *args, **options).withColumnsRenamed({v: k for k, v in aside.items()})

        return run

    return guard


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def require_integer(df: DataFrame, col: str) -> None:
    """Ids whose order decides are whole numbers; others raise rather than turn into nulls."""
    if not isinstance(df.schema[col].dataType, T.IntegralType):
        raise TypeError(f"{col} must be of an integer type, not {df.schema[col].dataType.simpleString()}")


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        h *= MULT
        h += words[j : len(words) - n + 1 + j]
    return mix(h)


def spans_of(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.reshape(-1, 2)
