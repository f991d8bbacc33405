"""Order, slices, dedup, upserts and stored query vectors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievemark.functions import vectors as V
from sievemark.operators import dedup, filters, joins, ordering, sets
from sievemark.plans.prep import clean_postings, prep_postings

SCHEMA = "id long, title string, description string, location string"


def key(i, seed=42):
    return (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i)


def seeded(ids):
    return sorted(ids, key=key)


@pytest.fixture(scope="module")
def posts(spark):
    """A third of the rows are copies of one posting."""
    rows = []
    for i in range(900):
        if i % 3 == 0:
            rows.append((i, "Hot", "same text", "X"))
        elif i % 50 == 1:
            rows.append((i, None, None, None))
        elif i % 50 == 2:
            rows.append((i, "T", "\t \n", "X"))
        else:
            rows.append((i, f"t{i % 7}", f"d{i % 200}", None if i % 2 else "Y"))
    return spark.createDataFrame(rows, SCHEMA)


def first_per_key(rows, fields, order):
    best = {}
    for r in sorted(rows, key=order):
        best.setdefault(tuple(r[f] for f in fields), r)
    return sorted(best.values(), key=lambda r: r.id)


@pytest.mark.parametrize("partitions", [1, 13])
def test_prep_is_the_same_for_any_partitioning(posts, partitions):
    rows = posts.collect()
    kept = first_per_key(rows, ["title", "description", "location"], lambda r: key(r.id))
    kept = [r.id for r in kept if r.description and r.description.strip()]
    expected = seeded(kept)
    got = prep_postings(posts.repartition(partitions), "id", n=100)
    assert {r.id for r in got.collect()} == set(expected[:100])
    everything = prep_postings(posts.repartition(partitions), "id", n=None)
    assert {r.id for r in everything.collect()} == set(expected)
    again = prep_postings(everything, "id", n=None)
    assert {r.id for r in again.collect()} == set(expected)


def test_clean_postings_keeps_first_by_id(posts):
    rows = [r for r in posts.collect() if r.description and r.description.strip()]
    expected = first_per_key(rows, ["title", "description"], lambda r: r.id)
    assert sorted(r.id for r in clean_postings(posts, "id").collect()) == [r.id for r in expected]


def test_dedup_nulls_are_equal_and_differ_from_empty(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", ""), (4, "a-", None), (5, None, "a")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    kept = dedup.keep_first(df, ["a", "b"], ["id"])
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4, 5]
    assert kept.columns == ["id", "a", "b"]


def test_positions_slices_and_batches(posts):
    expected = seeded(range(900))
    ids = posts.select("id").repartition(9)
    got = ordering.with_position(ids, "id").orderBy("position").collect()
    assert [r.id for r in got] == expected
    assert [r.position for r in got] == list(range(900))
    part = ordering.slice_rows(ids, "id", 333, 444).orderBy("position").collect()
    assert [r.id for r in part] == expected[333:444]
    assert [r.id for r in ordering.seeded_shuffle(ids, "id").collect()] == expected
    batched = ordering.with_batch(ids, "id", 400).collect()
    assert {(r.batch, r.n_batches) for r in batched} == {(0, 3), (1, 3), (2, 3)}
    assert all(r.batch == r.position // 400 for r in batched)


def test_first_rows_come_in_order_and_in_one_pass(posts):
    first = ordering.first_rows(posts, "id", 250)
    assert [r.id for r in first.collect()] == seeded(range(900))[:250]
    assert first.columns == posts.columns
    assert ordering.first_rows(posts, "id", 5000).count() == 900
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("Scan") == 1


@pytest.mark.parametrize("n", [1, 100, 330, 2000])
def test_limited_prep_equals_the_whole_order(posts, n):
    everything = [r.id for r in prep_postings(posts, "id").collect()]
    twice = posts.union(posts.where("id < 40"))
    for df in (posts, twice):
        got = prep_postings(df, "id", n=n)
        assert [r.id for r in got.collect()] == seeded(everything)[:n]
        assert got.columns == posts.columns


def test_filters_and_projections(posts, spark):
    assert filters.drop_null(posts, "description").where("description is null").count() == 0
    present = {r.column_name: (r.n_present, r.n_total) for r in
               filters.completeness(posts, ["title", "location"]).collect()}
    assert present["title"] == (posts.where("title is not null").count(), 900)
    assert filters.select_existing(posts, ["location", "nope", "id"]).columns == ["location", "id"]
    with pytest.raises(KeyError, match="nope, other"):
        filters.require_columns(posts, ["id", "nope", "other"])
    assert dedup.duplicate_ids(posts, "id").count() == 0
    assert dedup.duplicate_ids(posts.union(posts.limit(3)), "id").count() == 3


def test_vector_checks(spark):
    df = spark.createDataFrame(
        [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [None, 1.0])],
        "id int, v array<float>",
    )
    assert [r.id for r in filters.valid_vectors(df, "v", 2).orderBy("id").collect()] == [1, 2]
    bad = {r.id: r.found_dim for r in filters.rejected_vectors(df, "v", 2).collect()}
    assert bad == {3: 1, 4: None, 5: 2}
    unit = df.where("id < 3").select("id", V.l2_normalize(F.col("v")).alias("u"))
    assert [r.u for r in unit.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0]]
    slot, model = V.slot_for_dim(F.size("v"), {2: ("s", "m")})
    assert df.where("id = 1").select(slot, model).first()[:] == ("s", "m")
    with pytest.raises(Exception, match="Unsupported vector width 1"):
        df.where("id = 3").select(slot).collect()


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, x string")
    once = sets.upsert(old, new, ["id"])
    twice = sets.upsert(once, new, ["id"])
    for df in (once, twice):
        assert sorted(tuple(r) for r in df.collect()) == [(1, "a"), (2, "B"), (3, "C")]
    assert sets.union_append(old, new).count() == 4


def test_upsert_keeps_keys_unique_and_null_safe(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "id int, x string")
    new = spark.createDataFrame([(2, "B"), (2, "A"), (None, "N"), (1, "z")], "id int, x string")
    once = sets.upsert(old, new, ["id"])
    twice = sets.upsert(once, new, ["id"])
    for df in (once, twice):
        assert sorted(((r.id or 0), r.x) for r in df.collect()) == [(0, "N"), (1, "z"), (2, "A")]
    last = sets.upsert(old, new, ["id"], [F.col("x").desc()])
    assert {r.x for r in last.where("id = 2").collect()} == {"B"}


def test_hits_keep_their_rows_and_double_ids_raise(spark):
    hits = spark.createDataFrame([(1, 7), (2, 8)], "rank int, id int")
    posts = spark.createDataFrame([(7, "t")], "id int, title string")
    got = joins.with_metadata(hits, posts, "id", 2).orderBy("rank").collect()
    assert [(r["rank"], r.title) for r in got] == [(1, "t"), (2, None)]
    with pytest.raises(Exception, match="more than once: 7"):
        joins.with_metadata(hits, posts.union(posts), "id", 2).collect()
    assert joins.with_metadata(hits.where("id = 8"), posts.union(posts), "id").count() == 1


def test_fill_values(spark):
    master = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, s string")
    values = spark.createDataFrame([(2, None), (3, "c")], "id int, s string")
    written = sets.fill_values(master, values, "id", "s").orderBy("id").collect()
    kept = sets.fill_values(master, values, "id", "s", keep_old_on_null=True).orderBy("id").collect()
    assert [r.s for r in written] == ["a", None, "c"]
    assert [r.s for r in kept] == ["a", "b", "c"]


def test_pending_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id int")
    done = spark.createDataFrame([(1, 0), (3, 1)], "id int, label int")
    assert sorted(r.id for r in joins.pending_rows(df, done, "id").collect()) == [0, 2, 4]


SLOTS = {2: ("embedding1", "Org/Small-Model"), 3: ("embedding2", "Org/Big-Model")}


@pytest.fixture
def stored(spark):
    queries = spark.createDataFrame([("a", " find a "), ("b", "find b"), ("c", None)],
                                    "category string, query string")
    vectors = spark.createDataFrame(
        [
            ("a", "embedding1", "org2/small_model", [1.0, 2.0]),
            ("a", "embedding2", "Org/Big-Model", [1.0, 2.0]),
            ("b", "embedding1", "Org/Other", [3.0, 4.0]),
            ("c", "embedding1", "Org/Small-Model", None),
        ],
        "category string, slot string, model_name string, vector array<double>",
    )
    return queries, vectors


def test_query_vector_lookup(spark, stored):
    asked = [
        (1, "a", "find a", 2),  # reused
        (2, "a", "find a", 3),  # stored vector has another width
        (3, "a", "find x", 2),  # other text
        (4, "b", "find b", 2),  # slot of another model
        (5, "c", None, 2),  # no vector
        (6, "zz", "find", 2),  # unknown category
    ]
    requests = spark.createDataFrame(
        asked, "request_id int, category string, query_text string, dim int"
    )
    found = joins.query_vector_lookup(requests, *stored, SLOTS).orderBy("request_id").collect()
    assert [r.needs_encoding for r in found] == [False, True, True, True, True, True]
    plan = joins.query_vector_lookup(requests, *stored, SLOTS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert found[0].vector == [1.0, 2.0]


def test_query_vector_lookup_takes_one_row_per_category(spark, stored):
    queries, vectors = stored
    asked = spark.createDataFrame([(1, "a", "find a", 2), (2, None, None, 2)],
                                  "request_id int, category string, query_text string, dim int")
    none = spark.createDataFrame([(None, "x"), (None, "x")], queries.schema)
    found = joins.query_vector_lookup(asked, queries.unionAll(none), vectors, SLOTS).collect()
    assert sorted((r.request_id, r.needs_encoding) for r in found) == [(1, False), (2, True)]
    empty = joins.query_vector_lookup(asked, queries.limit(0), vectors.limit(0), SLOTS).collect()
    assert [r.needs_encoding for r in empty] == [True, True]
    with pytest.raises(ValueError, match="Stored query occurs 2 times: .'a'"):
        joins.query_vector_lookup(asked, queries.unionAll(queries.limit(1)), vectors, SLOTS)
    with pytest.raises(ValueError, match="Stored vector occurs 2 times"):
        joins.query_vector_lookup(asked, queries, vectors.unionAll(vectors), SLOTS)


def test_query_cache_upsert(spark, stored):
    encoded = spark.createDataFrame(
        [
            ("a", "embedding1", "Org/Small-Model", "find a", [9.0, 9.0]),  # same model: replaced
            ("b", "embedding1", "Org/Small-Model", "find b", [9.0, 9.0]),  # other owner: kept
            ("b", "embedding2", "Org/Big-Model", "find b ", [9.0]),  # free slot: added
            ("a", "embedding2", "Org/Big-Model", "other text", [9.0]),  # other text: kept
        ],
        "category string, slot string, model_name string, query_text string, vector array<double>",
    )
    got = {(r.category, r.slot): r.vector for r in sets.query_cache_upsert(*stored, encoded).collect()}
    assert got == {
        ("a", "embedding1"): [9.0, 9.0],
        ("a", "embedding2"): [1.0, 2.0],
        ("b", "embedding1"): [3.0, 4.0],
        ("b", "embedding2"): [9.0],
        ("c", "embedding1"): None,
    }
