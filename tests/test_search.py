"""Top-k against brute force, and the metrics on hand-made lists."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.operators import metrics, topk
from sievemark.operators.topk import _Best, _unit_rows, cosine_topk
from sievemark.plans.evaluation import compare_models

RNG = np.random.default_rng(7)


def brute_force(ids, vectors, query, k):
    unit = _unit_rows(np.array(vectors, dtype=np.float32).astype(np.float64))
    q = _unit_rows(np.array([query], dtype=np.float64))[0]
    scores = (unit * q).sum(axis=1).astype(np.float32).astype(np.float64)
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return [(ids[i], float(scores[i])) for i in order]


def corpus(spark, ids, vectors, id_type="long"):
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"id {id_type}, embedding array<float>")


def queries(spark, vectors):
    rows = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "category string, embedding array<float>")


def hits_of(df):
    out = {}
    for r in df.orderBy("category", "rank").collect():
        out.setdefault(r.category, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("blocks", [4096, 1])
def test_topk_equals_brute_force_with_copies(spark, partitions, blocks):
    """A third of the corpus is one vector; ids decide, wherever the copies lie."""
    vectors = RNG.normal(size=(600, 24)).astype(np.float32)
    vectors[::3] = vectors[0]
    ids = list(RNG.permutation(600))
    asked = [vectors[0], RNG.normal(size=24).astype(np.float32), np.zeros(24, np.float32)]
    df = corpus(spark, [int(i) for i in ids], vectors).repartition(partitions)
    found = hits_of(
        cosine_topk(df, queries(spark, asked), 50, id_col="id", query_cols=["category"],
                    block_queries=blocks)
    )
    for i, q in enumerate(asked):
        assert found[f"q{i}"] == brute_force([int(x) for x in ids], vectors, q, 50)


def test_topk_string_ids_short_corpus_and_bad_vectors(spark):
    rows = [
        ("b", [1.0, 0.0]),
        ("a", [2.0, 0.0]),
        ("zero", [0.0, 0.0]),
        ("huge", [3e30, 3e30]),
        ("tiny", [1e-30, 0.0]),
        ("null", None),
        ("hole", [None, 1.0]),
        ("nan", [float("nan"), 1.0]),
    ]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    found = hits_of(
        cosine_topk(df, queries(spark, [[1.0, 0.0]]), 10, id_col="id", query_cols=["category"])
    )
    assert [i for i, _ in found["q0"]] == ["a", "b", "tiny", "huge", "zero"]
    assert found["q0"][-1][1] == 0.0
    other = df.union(spark.createDataFrame([("short", [1.0])], df.schema))
    with pytest.raises(Exception, match="Vector width is not 2 but 1"):
        cosine_topk(other, queries(spark, [[1.0, 0.0]]), 10, id_col="id", query_cols=["category"]).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_queries_scan_the_corpus_once(spark, tmp_path, monkeypatch):
    """Blocks are even whatever partitions the queries have, read by tasks, and one pass does all."""
    vectors = RNG.normal(size=(400, 6)).astype(np.float32)
    vectors[::3] = vectors[0]
    corpus(spark, range(400), vectors).repartition(5).write.parquet(f"{tmp_path}/corpus")
    df = spark.read.parquet(f"{tmp_path}/corpus")
    asked = queries(spark, vectors[:100]).repartition(20)
    monkeypatch.setattr(type(asked), "toArrow", None)  # no vector reaches the driver
    args = {"id_col": "id", "query_cols": ["category"], "block_queries": 30}
    found = cosine_topk(df, asked, 7, **args)
    plan = plan_of(found)
    assert plan.count(f"{tmp_path}/corpus") == 1 and "CartesianProduct" in plan
    assert "BroadcastExchange" not in plan.split("CartesianProduct")[1]
    got = hits_of(found)
    assert got == {f"q{i}": brute_force(range(400), vectors, vectors[i], 7) for i in range(100)}
    monkeypatch.setattr(topk, "CHUNK_BYTES", 6 * 8 * 17)
    assert hits_of(cosine_topk(df, asked, 7, pass_bytes=1, **args)) == got
    assert hits_of(cosine_topk(df.where("false"), asked, 7, **args)) == {}


def test_blocks_are_cut_over_all_partitions(spark):
    asked = queries(spark, RNG.normal(size=(100, 2))).repartition(20)
    blocks = topk._blocks(asked, ["category"], "embedding", 90)
    assert sorted(len(r.queries) for r in blocks.collect()) == [10, 90]


def test_tasks_hold_one_share_of_the_queries(spark):
    """However many queries there are, a task meets only its share, and shares are even."""
    vectors = RNG.normal(size=(120, 4)).astype(np.float32)
    blocks = topk._blocks(queries(spark, vectors), ["category"], "embedding", 10)
    shares = topk._shares(blocks, 12, 5)
    chunks = topk._chunks(corpus(spark, range(30), vectors[:30]).repartition(3), "id", "embedding", 4)
    pairs = topk._grid(chunks, shares).select("block", "queries", "ids", F.spark_partition_id().alias("task")).collect()
    met = {}
    for r in pairs:
        met.setdefault(r.task, []).append(r)
    assert sorted(sorted({r.block for r in rows}) for rows in met.values()) == sorted(
        [[*range(5)], [*range(5, 10)], [10, 11]] * 3
    )
    for rows in met.values():
        assert {r.block for r in rows if r.queries} == {r.block for r in rows} and any(r.ids for r in rows)
        assert max(map(len, (r.queries for r in rows if r.queries))) <= 10


def test_shares_give_the_hits_of_one_pass(spark):
    vectors = RNG.normal(size=(150, 5)).astype(np.float32)
    df = corpus(spark, range(150), vectors).repartition(4)
    args = {"id_col": "id", "query_cols": ["category"], "block_queries": 8}
    per_query = 5 * 12 + 6 * 16 + topk.QUERY_BYTES
    found = cosine_topk(df, queries(spark, vectors), 6, pass_bytes=3 * 8 * per_query, **args)
    assert hits_of(found) == {f"q{i}": brute_force(range(150), vectors, v, 6) for i, v in enumerate(vectors)}


def test_a_share_meets_a_chunk_once(spark, monkeypatch):
    """A task gets each block once and each chunk once, and not a row for each pair of them."""
    vectors = RNG.normal(size=(120, 4)).astype(np.float32)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 4 * 8 * 5)
    blocks = topk._blocks(queries(spark, vectors), ["category"], "embedding", 10)
    chunks = topk._chunks(corpus(spark, range(100), vectors[:100]).coalesce(1), "id", "embedding", 4)
    pairs = topk._grid(chunks, topk._shares(blocks, 12, 12)).collect()
    assert sum(r.queries is not None for r in pairs) == 12 and len(pairs) == 12 + 20
    assert sorted(i for r in pairs for i in r.ids) == list(range(100))


def test_corpus_is_cut_for_the_cores(spark):
    """Each part of the corpus returns hits of every query, so there are no more parts than tasks need."""
    vectors = RNG.normal(size=(200, 3)).astype(np.float32)
    df = corpus(spark, range(200), vectors).repartition(100)
    args = {"id_col": "id", "query_cols": ["category"], "block_queries": 8}
    found = cosine_topk(df, queries(spark, vectors), 2, **args)
    assert f"Coalesce {topk.TASKS_PER_CORE * spark.sparkContext.defaultParallelism}" in plan_of(found)
    assert hits_of(found) == {f"q{i}": brute_force(range(200), vectors, v, 2) for i, v in enumerate(vectors)}


def test_work_goes_by_stripe_and_not_by_query(monkeypatch):
    """Queries are merged together, and of a vector that fills a chunk only k copies are rescored."""
    vectors = RNG.normal(size=(900, 8)).astype(np.float32)
    vectors[::2] = vectors[0]
    ids = RNG.permutation(900)
    merged = []
    plain = _Best._merge
    monkeypatch.setattr(_Best, "_merge", lambda self, owner, *a: (merged.append(len(owner)), plain(self, owner, *a)))
    best = _Best(_unit_rows(vectors.astype(np.float64)), 3)
    for part in np.array_split(np.arange(900), 3):
        best.add(ids[part], vectors[part])
    assert len(merged) <= 3 * -(-900 // topk.STRIPE) and sum(merged) <= 3 * 900 * (2 * 3 + 32)
    for q in range(0, 900, 7):
        assert list(zip(best.ids[q], best.scores[q])) == brute_force(list(ids), vectors, vectors[q], 3)


@pytest.mark.parametrize("block_queries", [4, 4096])
def test_copies_zero_huge_and_tiny_vectors(spark, block_queries):
    """Far more copies than k, in any block and chunk; lengths that 32 bits cannot square."""
    vectors = RNG.normal(size=(90, 4)).astype(np.float32)
    vectors[::3], vectors[1::9] = vectors[0], 0
    vectors[2::9] *= np.float32(1e30)
    vectors[5::9] *= np.float32(1e-30)
    df = corpus(spark, range(90), vectors).repartition(3)
    asked = queries(spark, vectors[:30])
    args = {"id_col": "id", "query_cols": ["category"], "block_queries": block_queries}
    for k in (4, 200):
        found = hits_of(cosine_topk(df, asked, k, **args))
        assert found == {f"q{i}": brute_force(range(90), vectors, vectors[i], k) for i in range(30)}


def test_many_queries_take_any_column_names(spark):
    """Key columns called as the grid's own, several keys, string ids, vectors with holes."""
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("zero", [0.0, 0.0]), ("hole", [None, 1.0]), ("null", None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "ids string, vectors array<float>")
    asked = [(1, "x", [1.0, 0.0]), (1, None, [0.0, 1.0]), (None, "x", [3.0, 0.0]), (2, "x", None)]
    q = spark.createDataFrame(asked, "block int, first string, vectors array<double>")
    found = cosine_topk(df, q, 2, id_col="ids", query_cols=["block", "first"], vector_col="vectors", block_queries=1)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want = [(1, "x", 1, "a", 1.0), (1, "x", 2, "b", 1.0), (None, "x", 1, "a", 1.0), (None, "x", 2, "b", 1.0),
            (1, None, 1, "a", 0.0), (1, None, 2, "b", 0.0)]
    assert got == sorted(want, key=str)


def test_topk_prefix_and_no_queries(spark):
    vectors = RNG.normal(size=(300, 8)).astype(np.float32)
    df = corpus(spark, range(300), vectors)
    q = queries(spark, vectors[:3])
    args = {"id_col": "id", "query_cols": ["category"]}
    ten, fifty = (hits_of(cosine_topk(df, q, k, **args)) for k in (10, 50))
    assert all(fifty[c][:10] == ten[c] for c in ten)
    assert cosine_topk(df, q.limit(0), 10, **args).count() == 0
    with pytest.raises(ValueError, match="widths"):
        cosine_topk(df, q.union(queries(spark, [[1.0]])), 10, **args)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 20), st.integers(1, 5), st.randoms())
def test_batches_do_not_matter(n, k, n_batches, random):
    """The running best of any split into batches is the best of the whole."""
    rng = np.random.default_rng(random.randrange(2**32))
    vectors = rng.integers(-2, 3, size=(n, 3)).astype(np.float32)
    ids = np.array(rng.permutation(n))
    asked = _unit_rows(rng.integers(-2, 3, size=(2, 3)).astype(np.float64))
    best = _Best(asked, k)
    for part in np.array_split(rng.permutation(n), n_batches):
        if len(part):
            best.add(ids[part], vectors[part])
    for q in range(2):
        expected = brute_force(list(ids), vectors, asked[q], k)
        assert list(zip(best.ids[q], best.scores[q])) == expected


CASES = [
    ([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6], 4, 2, (0.25, 0.5, 0.333333, 0.613147)),
    ([0, 1, 0, 0], [0.9, 0.5, 0.5, 0.1], 1, 2, (1.0, 0.5, 0.666667, 0.315465)),
    ([0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6], 3, 2, (0.0, 0.0, 0.0, 0.0)),
    ([1, 1], [0.9, 0.8], 2, 5, (1.0, 0.4, 0.571429, 1.0)),
    ([0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6], 0, 2, (0.0, 0.0, 0.0, 0.0)),
    ([1], [0.9], 1, 3, (1.0, 0.333333, 0.5, 1.0)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_metrics(spark, case):
    rel, scores, n_truth, k, expected = CASES[case]
    hits = spark.createDataFrame(
        [("m", "c", i + 1, i, s) for i, s in enumerate(scores)],
        "model string, category string, rank int, id int, score double",
    )
    relevant = [i for i, r in enumerate(rel) if r]
    others = list(range(1000, 1000 + n_truth - len(relevant)))
    truth = spark.createDataFrame([("c", i) for i in relevant + others], "category string, id int")
    searches = spark.createDataFrame([("m", "c"), ("m", "none")], "model string, category string")
    ks = [k, len(rel)]
    out = metrics.retrieval_metrics(hits, truth, searches, ks, id_col="id", max_hits=4)
    rows = {(r.category, r.k): r for r in out.collect()}
    got = rows[("c", k)]
    assert tuple(round(x, 6) for x in (got.recall, got.precision, got.f1, got.ndcg)) == expected
    assert rows[("none", k)].recall == rows[("none", k)].ndcg == 0.0


def test_ndcg_depends_on_the_whole_list(spark):
    """NDCG@2 of a list of four differs from that of its first two rows."""
    hits = spark.createDataFrame(
        [("m", "c", r + 1, r, 1.0 - r / 10) for r in range(4)],
        "model string, category string, rank int, id int, score double",
    )
    truth = spark.createDataFrame([("c", 1), ("c", 3)], "category string, id int")
    searches = hits.select("model", "category").distinct()
    deep = metrics.retrieval_metrics(hits, truth, searches, [2, 4], id_col="id")
    flat = metrics.retrieval_metrics(hits, truth, searches, [2], id_col="id")
    assert deep.where("k = 2").first().ndcg < flat.where("k = 2").first().ndcg


def test_compare_models_bounds(spark):
    vectors = RNG.normal(size=(200, 6)).astype(np.float32)
    df = corpus(spark, range(200), vectors)
    q = queries(spark, vectors[:2])
    truth = df.select(F.concat(F.lit("q"), (F.col("id") % 3).cast("string")).alias("category"), "id")
    models = {"a": (df, q), "b": (df.withColumn("embedding", F.slice("embedding", 1, 3)),
                                  q.withColumn("embedding", F.slice("embedding", 1, 3)))}
    rows = compare_models(models, truth, [10, 50, 100], id_col="id").orderBy("k").collect()
    assert len(rows) == 12
    assert all(0 <= r.ndcg <= 1 and 0 <= r.recall <= 1 for r in rows)
    for m in "ab":
        for c in ("q0", "q1"):
            recalls = [r.recall for r in rows if (r.model, r.category) == (m, c)]
            assert recalls == sorted(recalls)
    wide = metrics.metrics_wide(compare_models(models, truth, [10], id_col="id"), [10])
    assert wide.columns == ["model", "category", "Recall@10", "Precision@10", "F1@10", "NDCG@10"]
