"""The two standard preparations of posting tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.constants import SHUFFLE_SEED
from sievemark.functions.markup import clean_description
from sievemark.functions.names import unused
from sievemark.operators.dedup import keep_first, key_hash
from sievemark.operators.filters import drop_blank
from sievemark.operators.joins import broadcast_if_bounded
from sievemark.operators.ordering import order_key


def prep_postings(
    df: DataFrame,
    id_col: str,
    n: int | None = None,
    seed: int = SHUFFLE_SEED,
    keys: Sequence[str] = ("title", "description", "location"),
) -> DataFrame:
    """Seeded order, first row per key, no null or blank description, first ``n`` rows or all.

    The seeded order decides which copy survives and which rows are first. The
    description is part of the key, so filtering before the dedup gives the same rows
    and keeps the dropped ones out of the exchange. With ``n`` the dedup and the order
    see (key hash, order key, id) only; the ``n`` rows that are left are then fetched.
    """
    filled = drop_blank(df, "description")
    place = order_key(id_col, seed)
    if n is None:
        return keep_first(filled, keys, [place, id_col])
    order, hashed, first = unused(df.columns, "order_key", "key_hash", "first")
    keyed = filled.withColumn(order, place).withColumn(hashed, key_hash(keys))
    wanted = (
        keyed.groupBy(hashed)
        .agg(F.min(F.struct(order, id_col)).alias(first))
        .select(hashed, f"{first}.*")
        .orderBy(order, id_col)
        .limit(n)
    )
    wanted = broadcast_if_bounded(wanted.drop(order), n)
    same = (keyed[hashed] == wanted[hashed]) & keyed[id_col].eqNullSafe(wanted[id_col])
    rows = keyed.join(wanted, same, "left_semi")
    # Of rows that repeat both id and key one stays; there are n keys at most.
    kept = keep_first(rows, [hashed], [order, id_col]).orderBy(order, id_col)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def clean_postings(
    df: DataFrame, id_col: str, keys: Sequence[str] = ("title", "description")
) -> DataFrame:
    """First row per (title, raw description) by id, descriptions as flat text.

    Rows that are blank before or become blank by cleaning are dropped.
    """
    unique = keep_first(drop_blank(df, "description"), keys, [id_col])
    return drop_blank(clean_description(unique, "description"), "description")
