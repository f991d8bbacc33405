"""Encode texts to vectors with a user-supplied function."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions.strings import join_columns_clean
from sievemark.functions.vectors import l2_normalize
from sievemark.jobs.resumable import ERROR, ModelFunction, map_texts, run_resumable
from sievemark.operators.filters import require_columns

TEXT_COLUMNS = ("title", "description")


KNOWN_TOKENS = 200_000


def _token_number(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16)


def hashing_encoder(dim: int) -> ModelFunction:
    """Offline stand-in for a model: token counts in ``dim`` hash buckets."""

    known: dict[str, int] = {}

    def bucket(token: str) -> int:
        found = known.get(token)
        if found is None:
            found = _token_number(token) % dim
            if len(known) < KNOWN_TOKENS:
                known[token] = found
        return found

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            buckets = [bucket(t) for t in text.lower().split()]
            counts = np.bincount(np.array(buckets, dtype=np.int64), minlength=dim)
            out.append(counts.astype(np.float64))
        return out

    return encode


def encode_texts(
    df: DataFrame,
    fn: ModelFunction,
    id_col: str,
    text_col: str,
    retries: int = 2,
    batch_size: int | None = None,
) -> DataFrame:
    """(id, embedding of unit length, error); a failed row has no embedding but an error."""
    raw = map_texts(df, id_col, text_col, fn, "array<double>", retries, batch_size)
    return raw.select(id_col, l2_normalize(F.col("value")).alias("embedding"), ERROR)


def encode_columns(
    df: DataFrame,
    fn: ModelFunction,
    id_col: str,
    columns: Sequence[str] = TEXT_COLUMNS,
    retries: int = 2,
    batch_size: int | None = None,
) -> DataFrame:
    """Encode the joined text of ``columns``; an absent column is an error."""
    require_columns(df, list(columns))
    texts = df.select(id_col, join_columns_clean(columns).alias("feature_text"))
    return encode_texts(texts, fn, id_col, "feature_text", retries, batch_size)


def run_encode_job(
    df: DataFrame,
    fn: ModelFunction,
    path: str,
    id_col: str,
    columns: Sequence[str] = TEXT_COLUMNS,
    n_slices: int = 1,
    retries: int = 2,
    batch_size: int | None = None,
) -> DataFrame:
    """Encode every row not yet in ``path`` and return the whole vector table."""

    def encode(pending: DataFrame) -> DataFrame:
        return encode_columns(pending, fn, id_col, columns, retries, batch_size)

    return run_resumable(df, encode, path, id_col, n_slices)
