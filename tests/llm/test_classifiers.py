import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import quality, toxicity
from sievemark.llm.label_model import LabelModel
from tests.llm.fixtures import awkward, documents

SF_DIR = "/root/testdata/sf0.01"


def scored(spark, module, label):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    return module.score(docs, labels).join(labels, "doc_id").toPandas(), label


@pytest.mark.parametrize("module,label,fold,least", [
    (toxicity, "toxic", lambda c: c % 3 == 1, 0.95), (quality, "quality", lambda c: c % 5 == 0, 0.97),
])
def test_held_out_rows_are_ranked_well(spark, module, label, fold, least):
    rows, _ = scored(spark, module, label)
    assert all(bool(h) == fold(zlib.crc32(str(d).encode())) for d, h in zip(rows.doc_id, rows.held_out))
    out = rows[rows.held_out]
    ones, zeros = out[out[label] == 1].score.to_numpy(), out[out[label] == 0].score.to_numpy()
    wins = (ones[:, None] > zeros).mean() + 0.5 * (ones[:, None] == zeros).mean()
    assert wins >= least
    assert (rows.predicted == (rows.score >= module.THRESHOLD)).all()
    assert rows.score.between(0, 1).all()


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
@pytest.mark.parametrize("kind", ["none", "one class", "some"])
def test_awkward_rows(spark, module, label, kind):
    rows = awkward()
    marks = {"none": [], "one class": [(i, 1) for i in range(9)], "some": [(i, i % 2) for i in range(40)]}[kind]
    marks = marks + ([(3, None), (None, 1), (3, 1), (3, 0)] if kind == "some" else [])
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int")
    got = module.score(documents(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert set(got.predicted) <= {0, 1}


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_empty_table(spark, module, label):
    labels = spark.createDataFrame([(1, 1)], f"doc_id long, {label} int")
    assert module.score(documents(spark, []), labels).collect() == []


def test_held_out_labels_and_ids_change_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 400")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    out = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_rejects_only_predicted_rows(spark):
    rows = awkward() + [(700, "you are an idiot and a moron, pathetic stupid clown", "s0")]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.reject(documents(spark, rows), labels)
    assert kept.where("doc_id = 700").count() == 0 and kept.count() == len(rows) - 1
    assert kept.columns == documents(spark, rows).columns


def test_label_model_finds_accuracies_and_copies():
    """Three voters of known accuracy, the last one copied four times."""
    rng = np.random.default_rng(0)
    y = (rng.random(40_000) < 0.3).astype(int)
    hit, false = [0.9, 0.7, 0.6], [0.05, 0.1, 0.2]
    votes = np.stack([rng.random(len(y)) < np.where(y == 1, h, f) for h, f in zip(hit, false)], 1).astype(int)
    votes = np.hstack([votes] + [votes[:, 2:]] * 4)
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    known = np.zeros((len(patterns), 2))
    start = np.where(patterns[:, 0] == 1, 0.8, 0.1)
    model = LabelModel(rounds=60).fit(patterns, n.astype(float), known, start)
    truth = np.bincount(which.reshape(-1), weights=y) / n
    assert abs(model.prior - 0.3) < 0.05
    assert np.average(np.abs(model.posterior(patterns) - truth), weights=n) < 0.1


def test_rules_are_read_from_printed_trees():
    text = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= 0.5)
      Predict: 0.0
     Else (feature 1 > 0.5)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
"""
    a, b = quality.STATISTICS[:2]
    assert quality.tree_rules(text) == sorted([
        ((a, "<=", 2.5),), ((a, "<=", 2.5), (b, "<=", 0.5)), ((a, "<=", 2.5), (b, ">", 0.5)), ((a, ">", 2.5),),
    ])


def test_rules_over_the_last_statistic_reach_the_lasso(spark, monkeypatch):
    rng = np.random.default_rng(8)
    first, last = min(quality.STATISTICS), max(quality.STATISTICS)
    values = rng.random((400, len(quality.STATISTICS)))
    place = quality.STATISTICS.index(last)
    rows = [(*map(float, v), int(v[place] > 0.5)) for v in values]
    sample = spark.createDataFrame(rows, [*quality.STATISTICS, "label"])
    tells = ((last, ">", 0.5),)
    noise = [((first, "<=", 0.1 + 0.8 * i / 230),) for i in range(230)]
    monkeypatch.setattr(quality, "tree_rules", lambda text: [*noise, tells])
    kept, _ = quality.fit_rules(sample)
    assert dict(kept).get(tells, 0) > 0


def test_toxic_rows_are_found_in_every_language(spark):
    """Held-out rows at the threshold: recall over all and per language, and false alarms."""
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").join(docs, "doc_id")
    counted = found.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hit")).collect()
    hit = {(r.lang, r.toxic): r.hit for r in counted}
    n = {(r.lang, r.toxic): r.n for r in counted}
    langs = {lang for lang, _ in n}
    assert sum(hit[x, 1] for x in langs) >= 0.9 * sum(n[x, 1] for x in langs)
    assert all(hit[x, 1] >= 0.8 * n[x, 1] for x in langs)
    assert sum(hit[x, 0] for x in langs) <= 0.01 * sum(n[x, 0] for x in langs)
