"""Title rules, answer parsing and label matrices on hand-made cases."""

from pyspark.sql import functions as F

from sievemark.catalog.tables import TITLES
from sievemark.functions import responses
from sievemark.jobs.labeller import apply_exclusion
from sievemark.operators import joins, labels

SHORT = {
    "entry_level": "E",
    "data_business_analytics": "D",
    "finance_analytics": "F",
    "marketing_analytics": "M",
}
EXPECTED = ["D", "F", "F", "ED", "D", "E", "", "E", "EM", "", "", "D", "D", "", "DM", "ED", "", "F", "E", ""]

ANSWERS = [
    ('{"internship":1,"entry_level":1}', (1, 0, 0)),
    ('```json\n{"marketing": true}\n```', (0, 0, 1)),
    ('Sure: {"marketing":"0"} ok', (0, 0, 1)),
    ("no json", (0, 0, 0)),
    ("{a:1}", (0, 0, 0)),
    ('{"x":{"marketing":1}}', (0, 0, 1)),
    ('{bad} {"marketing":1}', (0, 0, 0)),
    ('{"marketing":null}', (0, 0, 0)),
    ('{"marketing":0.0}', (0, 0, 0)),
    ('{"marketing":[]}', (0, 0, 0)),
    ('{"marketing":2}', (0, 0, 1)),
    ('{"marketing":[0]}', (0, 0, 1)),
    ('{"marketing":""}', (0, 0, 0)),
    ('{"marketing":false,\n"internship":"yes"}', (1, 0, 0)),
    (None, (0, 0, 0)),
]


def test_title_rules(spark):
    df = spark.createDataFrame(list(enumerate(TITLES)), "i int, title string")
    found = {i: set() for i in range(len(TITLES))}
    for row in labels.label_by_rules(df).collect():
        found[row.i].add(SHORT[row.category])
    assert [found[i] for i in range(len(TITLES))] == [set(e) for e in EXPECTED]


def test_rules_fold_case_like_unicode(spark):
    df = spark.createDataFrame([(0, "ſenior Analyst I"), (1, "JUNıOR")], "i int, title string")
    assert labels.label_by_rules(df, [labels.ENTRY_LEVEL]).where("i = 0").count() == 0


def test_single_rule_equals_multilabel(spark):
    df = spark.createDataFrame(list(enumerate(TITLES)), "i int, title string")
    every = labels.label_by_rules(df)
    for rule in labels.TITLE_RULES:
        alone = {r.i for r in labels.matching_rows(df, rule).collect()}
        assert alone == {r.i for r in every.where(F.col("category") == rule.category).collect()}


def test_parse_answers(spark):
    cats = ["internship", "entry_level", "marketing"]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, raw string")
    parsed = apply_exclusion(responses.parse_multilabel(df, "raw", cats))
    got = [tuple(r[1:]) for r in parsed.orderBy("i").collect()]
    assert got == [e for _, e in ANSWERS]


def test_parse_binary(spark):
    raw = [" 1\n", "0", "yes", "01", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(raw)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(responses.parse_binary(F.col("raw"))).collect()]
    assert got == [1, 0, 0, 0, 0]


def test_label_cast(spark):
    df = spark.createDataFrame([(1.0,), (None,), (0.0,)], "x double")
    assert [r[0] for r in df.select(responses.label_cast(F.col("x"))).collect()] == [1, 0, 0]


def test_subsets_counts_and_ids(spark):
    posts = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, title string")
    wide = spark.createDataFrame([(i, i % 2, 1) for i in range(40)], "id long, a int, b int")
    subsets = labels.labels_to_subsets(posts, wide, "id", ["a", "b"])
    dim = joins.category_dim(spark, {"a": "A", "b": "B", "c": "C"})
    counts = {r.category: r.n_rows for r in labels.category_counts(subsets, dim).collect()}
    assert counts == {"a": 20, "b": 40, "c": 0}
    chunks = labels.category_ids(subsets, "id", ids_per_chunk=10).collect()
    assert len([c for c in chunks if c.category == "b"]) > 1
    for category, n in (("a", 20), ("b", 40)):
        ids = sorted(i for c in chunks if c.category == category for i in c.ids)
        assert len(ids) == n == len(set(ids))
    whole = labels.category_ids(subsets, "id").where("category = 'b'").collect()
    assert len(whole) == 1 and whole[0].ids == list(range(40))


def test_pairs_and_back(spark):
    posts = spark.createDataFrame([(1,), (2,)], "id long")
    pairs = joins.posting_category_pairs(posts, ["a", "b"]).withColumn(
        "label", F.when((F.col("id") == 1) & (F.col("category") == "b"), 1)
    )
    wide = joins.pairs_to_wide(pairs, "id", ["a", "b"]).orderBy("id").collect()
    assert [tuple(r) for r in wide] == [(1, 0, 1), (2, 0, 0)]
