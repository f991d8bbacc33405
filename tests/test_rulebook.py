"""Many rules at once against the same rules one by one."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.catalog.tables import TITLES
from sievemark.operators import labels
from sievemark.operators.labels import Rule
from sievemark.operators.rulebook import label_by_rulebook, needles

NEEDLES = [
    (r"data\s+analyst", ["analyst"]),
    (r"entry.?level", ["entry"]),
    ("colou?rs", ["colo"]),
    ("x{2,3}abc", ["abc"]),
    (r"\b(?:new grad|junior)\b", ["new grad", "junior"]),
    ("(abc|def)", ["abc", "def"]),
    ("(?:abc)?def", ["def"]),
    ("[abc|d]efg|hij", ["efg", "hij"]),
    (r"abc\?def|Vice +President", ["abc", "president"]),
    ("a|longer", None),
    ("ab*cd", None),
    ("", None),
    ("abc|", None),
    ("(?x) a b c d", None),
    (r"\Qabc\E", None),
    (r"\x41bcd", None),
    ("[a[b]cdef]", None),
    ("(?!intern)lead", ["lead"]),
]


@pytest.mark.parametrize("pattern,expected", NEEDLES)
def test_needles(pattern, expected):
    assert needles(pattern) == expected


def random_rules(rng, words, n):
    rules = []
    for i in range(n):
        a, b, c = (re.escape(w) for w in rng.choice(words, 3))
        shapes = [rf"\b{a}\b", rf"\b(?:{a}|{b} {c})\b", f"{a}.{{0,9}}{b}", f"{a[:4]}?|{b}s?", rf"{a}[\s-]+{b}", a[:2]]
        exclude = rf"\b{c}\b" if i % 3 == 0 else None
        rules.append(Rule(f"r{i % (n - 5)}", shapes[i % len(shapes)], exclude))
    return rules


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_rules_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = np.random.default_rng(2)
    words = sorted({w for r in docs.select("text").collect() for w in re.findall("[A-Za-z]{3,}", r.text or "")})
    rules = random_rules(rng, words, 300)
    df = docs.select("doc_id", F.col("text").alias("title"))
    expected = rows_of(labels.label_by_rules(df, rules).select("doc_id", "category"))
    assert rows_of(label_by_rulebook(df, rules).select("doc_id", "category")) == expected
    assert len({c for _, c in expected}) > 150


def test_title_rules_and_odd_rows(spark):
    odd = [None, "", " ", "ſenior analyst", "JUNıOR trainee", "TRAİNEE", "mar\u212aeting", "data analyst", "data analyst"]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate([*TITLES, *odd, "new grad " * 30_000])]
    df = spark.createDataFrame(rows + rows[:3], "i int, title string, category string, gram string, needle string")
    rules = [*labels.TITLE_RULES, Rule("a", "junior|trainee"), Rule("a", "senior"), Rule("m", r"\bmarketing\b", "growth")]
    got, expected = label_by_rulebook(df, rules), labels.label_by_rules(df, rules)
    assert sorted(got.columns) == sorted(expected.columns)
    names = sorted(got.columns)
    assert rows_of(got.select(names)) == rows_of(expected.select(names))
    assert rows_of(label_by_rulebook(df.limit(0), rules)) == []
    assert rows_of(label_by_rulebook(df, [])) == []


def test_plan_has_no_shuffle_and_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "title")
    rules = [Rule(f"r{i}", rf"\bword{i}\b") for i in range(300)]
    plan = label_by_rulebook(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan
