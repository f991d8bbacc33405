"""Quality scores from a sparse ensemble of rules.

Statistics of the text feed a forest of shallow trees; every path from a root is a rule, a
conjunction of thresholds. A lasso logistic regression keeps few of them, and the kept rules are
compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.labelled import SAMPLE_ROWS, held_out, joined, training_labels
from sievemark.session import materialize

FOLDS, FOLD_OUT = 5, 0
THRESHOLD = 0.3
TREES, DEPTH = 24, 3
LASSO = 0.002
SEED = 42

STATISTICS = [
    "log_words", "word_length", "distinct_share", "top_word_share", "repeat_share",
    "line_repeat_share", "line_words", "upper_word_share", "capital_share", "symbol_end_share",
    "digit_share", "symbol_share", "bang_share", "pipe_share", "stop_share", "comma_share",
]
SYMBOLS = "%$&#*~^_=+<>{}[]\\/@"


def statistics(text: str) -> list[float]:
    """Numbers that describe ``text``, in the order of STATISTICS; 0 for an empty text."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        len(str(n)) + n / 10 ** len(str(n)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(n / max(len(lines), 1), 1000.0),
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(w[-1] in SYMBOLS for w in words) / n,
        sum(map(str.isdigit, words)) / n,
        sum(text.count(c) for c in SYMBOLS) / chars,
        text.count("!") / n,
        text.count("|") / n,
        text.count(".") / n,
        text.count(",") / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{s} double" for s in STATISTICS)
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, {fields}")


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(description: str) -> list[Rule]:
    """Every path of the trees in Spark's printed form, as (statistic, comparison, value) triples."""
    rules, path = set(), []
    for line in description.splitlines():
        found = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if line.strip().startswith("Tree"):
            path = []
        if not found:
            continue
        depth = len(line) - len(line.lstrip())
        path = [p for p in path if p[0] < depth]
        path.append((depth, (STATISTICS[int(found[1])], found[2], float(found[3]))))
        rules.add(_shortest([test for _, test in path]))
    return sorted(rules)


def _shortest(tests: list[tuple[str, str, float]]) -> Rule:
    """The conjunction with one bound per statistic and side."""
    bounds: dict[tuple[str, str], float] = {}
    for name, op, value in tests:
        pick = min if op == "<=" else max
        bounds[name, op] = pick(value, bounds.get((name, op), value))
    return tuple(sorted((name, op, value) for (name, op), value in bounds.items()))


def rule_column(rule: Rule) -> Column:
    """The rule as a 0/1 column over the statistics."""
    met = F.lit(True)
    for name, op, value in rule:
        met = met & (F.col(name) <= value if op == "<=" else F.col(name) > value)
    return met.cast("double")


def fit_rules(sample: DataFrame) -> tuple[list[tuple[Rule, float]], float]:
    """(rule, weight) pairs and the constant, learned from ``sample`` (STATISTICS, label)."""
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n, ones = sum(counts.values()), counts.get(1, 0)
    if n == 0 or ones in (0, n):
        return [], 4.0 if ones else (-4.0 if n else 0.0)
    data = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(sample)
    data = data.select("x", "label", *STATISTICS)
    forest = RandomForestClassifier(
        featuresCol="x", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5",
        minInstancesPerNode=max(2, n // 200), seed=SEED,
    ).fit(data)
    rules = tree_rules(forest.toDebugString)
    shares = sample.agg(*[F.avg(rule_column(r)).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    rules = [r for i, r in enumerate(rules) if 0.005 < shares[f"r{i}"] < 0.995]
    if not rules:
        return [], 2.0 if 2 * ones > n else -2.0
    columns = [rule_column(r).alias(f"r{i}") for i, r in enumerate(rules)]
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(
        sample.select("label", *columns)
    )
    model = LogisticRegression(
        featuresCol="x", regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=100
    ).fit(table.select("x", "label"))
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients) if w]
    return kept, float(model.intercept)


def score_column(rules: list[tuple[Rule, float]], constant: float) -> Column:
    linear = F.lit(constant)
    for rule, weight in rules:
        linear = linear + rule_column(rule) * weight
    return 1 / (1 + F.exp(-linear))


def score(
    docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """Quality of every whole text.

    Args:
        docs: ``doc_id``, ``text``; other columns are not read.
        labels: ``doc_id``, ``quality``. Rows whose crc32(doc_id as text) mod 5 is 0 are not read.
        sample_rows: labelled rows to learn from, at most.

    Returns:
        doc_id, held_out boolean, score double, predicted int, n_rules int. One row per input row.
        Null and empty texts have statistics 0 and are scored like others. With labels of one
        class only, or none, the score is a constant.
    """
    rows = materialize(with_statistics(docs), "text-statistics")
    taken = training_labels(labels, "quality", FOLDS, FOLD_OUT, sample_rows)
    sample = materialize(joined(rows, taken).drop("doc_id"), "labelled-statistics")
    rules, constant = fit_rules(sample.coalesce(8))
    value = score_column(rules, constant)
    return rows.select(
        "doc_id",
        held_out(FOLDS, FOLD_OUT).alias("held_out"),
        value.alias("score"),
        (value >= threshold).cast("int").alias("predicted"),
        F.lit(len(rules)).alias("n_rules"),
    )
