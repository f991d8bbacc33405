"""Model labels from file paths, loose model ids, and names for columns of our own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions.strings import empty_if_null, strip


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The ``wanted`` names, each with as many ``_`` behind it as tells it from all ``columns``.

    For columns that an operator adds for its own use: whatever the caller's are called, none is
    overwritten, dropped or ambiguous. Names are compared without case, as Spark does."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def model_name_from_path(path: Column) -> Column:
    """``.../embeddings_title_summary_1000_768d_v2.pkl`` -> ``title_summary_768d``."""
    name = F.substring_index(path, "/", -1)
    name = F.replace(name, F.lit(".pkl"), F.lit(""))
    name = F.regexp_replace(name, r"^embeddings_", "")
    name = F.regexp_replace(name, r"_\d+(?=_)", "")
    return F.regexp_replace(name, r"_v\d+$", "")


def normalize_model_id(model_id: Column) -> Column:
    """Lower case, ``_`` as ``-``, without the part up to the first ``/``; null as ''."""
    name = F.replace(F.lower(strip(empty_if_null(model_id))), F.lit("_"), F.lit("-"))
    return F.regexp_replace(name, r"^[^/]*/", "")


def same_model(a: Column, b: Column) -> Column:
    return normalize_model_id(a) == normalize_model_id(b)
