"""Every registered query against its SQL in DuckDB, over whole tables."""

import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from sievemark.catalog.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return repr(value)
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    columns, rows = normalised(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(oracle_sql()[name])
    expected_columns, expected = normalised(rel.columns, rel.fetchall())
    assert columns == expected_columns
    assert len(rows) == len(expected)
    different = [(a, b) for a, b in zip(rows, expected) if a != b]
    assert not different, different[:3]
    assert rows


TOKENS = [
    "a", "b1", "Word", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u2028", "\x1c", "\x85", "\r\n", "\x0b",
    "*", "**", "***", "_", "__", "#", "## ", "- ", "* ", "+ ", "1. ", "12.", "==", "---", "=", "-",
    "[", "]", "(", ")", "](", "`", "\\", "\\*", "&amp;", "&quot;", "&amp;lt;", "&amp", "5 < 6", ">",
    "<p>", "</p>", "<br/>", "<li class='x'>", "<b>", "</b>", '<a href="x>y">', "</a>", "<h2>", "</>",
    "<!-- c <b> -->", "<script>var a = '<p>';</script>", "<style>p{}</style>", "<!doctype html>",
]


def test_cleaning_of_random_texts_matches_sql(spark):
    """Texts of random marks, cleaned by Java patterns and by the RE2 ones."""
    import numpy as np
    import pyarrow as pa

    from sievemark.catalog.oracle import clean
    from sievemark.functions.markup import clean_description

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(TOKENS, size=rng.integers(1, 25))) for _ in range(4000)]
    rows = list(enumerate(texts))
    cleaned = clean_description(spark.createDataFrame(rows, "i int, t string"), "t")
    got = {r.i: r.t for r in cleaned.collect()}
    con = duckdb.connect()
    con.register("raw_texts", pa.table({"i": list(range(len(texts))), "t": texts}))
    expected = dict(con.sql(f"SELECT i, {clean('t')} FROM raw_texts").fetchall())
    different = [(texts[i], got[i], expected[i]) for i in got if got[i] != expected[i]]
    assert not different, (len(different), different[:5])
