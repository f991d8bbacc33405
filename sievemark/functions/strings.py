"""Strip, join, truncate and render text columns."""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.constants import DESCRIPTION_CHARS, STRIP_CHARS

# True when at least one character is not whitespace.
NON_BLANK_PATTERN = r"(?U)[^\s\x1C-\x1F]"


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` only knows the space)."""
    return F.btrim(c, F.lit(STRIP_CHARS))


def is_not_blank(c: Column) -> Column:
    """Null and whitespace-only texts are blank."""
    return F.coalesce(c.rlike(NON_BLANK_PATTERN), F.lit(False))


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_equals(a: Column, b: Column) -> Column:
    return strip(empty_if_null(a)) == strip(empty_if_null(b))


def truncate_chars(c: Column, n: int = DESCRIPTION_CHARS) -> Column:
    """First ``n`` code points."""
    return F.substring(c, 1, n)


def join_columns(columns: Sequence[str]) -> Column:
    """Nulls become empty, parts are joined by one space, only the ends are stripped."""
    return strip(F.concat_ws(" ", *[empty_if_null(F.col(c).cast("string")) for c in columns]))


def join_columns_clean(columns: Sequence[str]) -> Column:
    """Every part is stripped; null and empty parts leave no extra space."""
    parts = [F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in columns]
    return F.concat_ws(" ", *parts)


def text_length(c: Column) -> Column:
    return F.char_length(c)


def _assemble(parts: Sequence[tuple[str, str | None]], values: Mapping[str, Column]) -> Column:
    """Concatenate (literal, field) parts; a field's text is never scanned again."""
    out = []
    for literal, field in parts:
        if literal:
            out.append(F.lit(literal))
        if field is not None:
            out.append(empty_if_null(values[field].cast("string")))
    return F.concat(*out) if out else F.lit("")


def render_format(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` fields; doubled braces become single ones."""
    parts = [(text, field) for text, field, _, _ in string.Formatter().parse(template)]
    return _assemble(parts, values)


def render_replace(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` fields of the given names; all other braces stay as they are."""
    names = "|".join(re.escape(n) for n in values)
    pieces = re.split(r"\{(" + names + r")\}", template)
    literals, fields = pieces[0::2], [*pieces[1::2], None]
    return _assemble(list(zip(literals, fields)), values)
