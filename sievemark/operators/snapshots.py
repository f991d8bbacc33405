"""What happened to the records of one snapshot by the next one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import unused
from sievemark.operators.dedup import key_hash

NEW, CHANGED, INACTIVE, SAME = "new", "changed", "inactive", "same"


def _content(digest: Column) -> list[Column]:
    """Two sums over a key's digests: equal for equal rows in any order, and added up in parts."""
    parts = [F.conv(F.substring(digest, start, 15), 16, 10) for start in (1, 16)]
    return [F.sum(p.cast("decimal(38,0)")) for p in parts]


def lifecycle_diff(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    content: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key of either snapshot with its ``outcome``.

    ``new``: only in the new snapshot; ``inactive``: only in the old one; ``changed``: in both with
    other content; ``same``: in both with equal content. Content is ``content``, by default all
    columns of ``old`` besides the keys; null differs from the empty text.

    The two sides meet as in a full outer join in which null keys are equal: each row becomes its
    keys and a digest where it is read, both sides are grouped by key in one exchange, and every
    task first adds up its own rows. So no content is moved, and a key that very many rows share
    sends one row per task. A key with several rows has the set of these rows, repeats counted, as
    its content. Empty snapshots give no rows.

    Returns:
        the keys, outcome, old_rows and new_rows (long).
    """
    compared = list(content) if content is not None else [c for c in old.columns if c not in keys]
    digest, is_new = unused(keys, "digest", "is_new")

    def side(df: DataFrame, number: int) -> DataFrame:
        return df.select(*keys, key_hash(compared).alias(digest), F.lit(number).alias(is_new))

    def of(number: int, value: Column) -> Column:
        return F.when(F.col(is_new) == number, value)

    names = unused(keys, "old_a", "old_b", "new_a", "new_b", "old_rows", "new_rows")
    sums = [s for n in (0, 1) for s in _content(of(n, F.col(digest)))]
    rows = [F.count(of(n, F.lit(1))) for n in (0, 1)]
    both = side(old, 0).unionByName(side(new, 1))
    met = both.groupBy(*keys).agg(*[a.alias(n) for a, n in zip([*sums, *rows], names)])
    old_a, old_b, new_a, new_b, old_rows, new_rows = map(F.col, names)
    equal = (old_rows == new_rows) & (old_a == new_a) & (old_b == new_b)
    outcome = (
        F.when(old_rows == 0, F.lit(NEW))
        .when(new_rows == 0, F.lit(INACTIVE))
        .when(equal, F.lit(SAME))
        .otherwise(F.lit(CHANGED))
    )
    return met.select(*keys, outcome.alias("outcome"), old_rows.alias("old_rows"), new_rows.alias("new_rows"))


def outcome_counts(diff: DataFrame) -> DataFrame:
    """(outcome, n_keys) of a diff."""
    return diff.groupBy("outcome").agg(F.count("*").alias("n_keys"))
