"""Parse answers of a labelling model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.strings import strip


def parse_binary(raw: Column) -> Column:
    """1 when the stripped answer is exactly "1", else 0."""
    return F.when(strip(raw) == "1", 1).otherwise(0)


def extract_json(raw: Column) -> Column:
    """First ``{...}`` without inner braces as VARIANT; null if absent or not JSON."""
    first = F.regexp_extract(raw, r"\{[^{}]*\}", 0)
    return F.try_parse_json(F.nullif(first, F.lit("")))


def truthy(obj: Column, key: str) -> Column:
    """Truth value of a member, 0 or 1.

    Strings count when non-empty (so "0" is 1), lists when non-empty, numbers when
    not zero; null and absent are 0.
    """
    path = "$['" + key + "']"
    member = F.try_variant_get(obj, path, "variant")
    kind = F.schema_of_variant(member)
    as_text = F.try_variant_get(obj, path, "string")
    as_number = F.try_variant_get(obj, path, "double")
    flag = (
        F.when(member.isNull() | (kind == "VOID"), False)
        .when(kind == "STRING", as_text != "")
        .when(kind == "BOOLEAN", as_text == "true")
        .when(kind.startswith("ARRAY"), F.to_json(member) != "[]")
        .otherwise(F.coalesce(as_number != 0, F.lit(False)))
    )
    return F.coalesce(flag, F.lit(False)).cast("int")


def parse_multilabel(df: DataFrame, raw_col: str, categories: Sequence[str]) -> DataFrame:
    """Replace ``raw_col`` by one 0/1 column per category.

    Absent members and unreadable answers give 0. The parsed object is a column of its
    own, so each answer is parsed once for all categories.
    """
    kept = [c for c in df.columns if c != raw_col]
    parsed = df.withColumn("answer", extract_json(F.col(raw_col)))
    return parsed.select(*kept, *[truthy(F.col("answer"), c).alias(c) for c in categories])


def exclude_when(winner: Column, loser: Column) -> Column:
    """``loser`` becomes 0 where ``winner`` is 1; the other way round nothing changes."""
    return F.when(winner == 1, 0).otherwise(loser)


def label_cast(c: Column) -> Column:
    """Null to 0, fraction dropped."""
    return F.coalesce(c, F.lit(0)).cast("int")
