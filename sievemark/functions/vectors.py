"""Vector expressions over array columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.constants import DIM_MODEL_SLOTS


def l2_norm(v: Column) -> Column:
    square_sum = F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(square_sum)


def l2_normalize(v: Column) -> Column:
    """Unit length in double; a zero vector stays as it is."""

    def scaled(norm: Column) -> Column:
        factor = F.when(norm > 0, norm).otherwise(1.0)
        return F.transform(v, lambda x: x.cast("double") / factor)

    # A one-element array binds the norm, so it is computed once per vector and not
    # once per component.
    return F.get(F.transform(F.array(l2_norm(v)), scaled), F.lit(0))


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def truncate_dim(v: Column, dim: int) -> Column:
    """First ``dim`` components, scaled to unit length again."""
    return l2_normalize(F.slice(v, 1, dim))


def has_dim(v: Column, dim: int) -> Column:
    """False for null, for another width and for a null component."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))


def slot_for_dim(
    dim: Column, slots: Mapping[int, tuple[str, str]] = DIM_MODEL_SLOTS
) -> tuple[Column, Column]:
    """(slot, model id) columns of a vector width; an unknown width raises at run time."""

    def pick(position: int) -> Column:
        out = None
        for width, entry in slots.items():
            value = F.lit(entry[position])
            out = F.when(dim == width, value) if out is None else out.when(dim == width, value)
        known = ", ".join(str(w) for w in slots)
        return out.otherwise(
            F.raise_error(
                F.concat(
                    F.lit("Unsupported vector width "),
                    F.coalesce(dim.cast("string"), F.lit("null")),
                    F.lit(f"; expected one of {known}"),
                )
            )
        )

    return pick(0), pick(1)
