"""Snapshots compared, bucketed merges, streams of updates, and the caller's column names."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievemark.functions.markup import clean_description
from sievemark.functions.names import unused
from sievemark.operators import dedup, ordering, sets, snapshots
from sievemark.plans.prep import prep_postings
from sievemark.sources import buckets
from sievemark.streaming.upserts import upsert_new_files

SCHEMA = "id long, part string, text string"


def exchanges(df):
    """Plan lines of what is moved between tasks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [line for line in plan.splitlines() if "Exchange" in line]


def random_rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(n)]), rng.choice([None, "", "p", "q"]), rng.choice([None, "", "x", "yy"])) for _ in range(n)]


def brute_diff(old, new):
    sides = [{}, {}]
    for rows, side in zip((old, new), sides):
        for *key, text in rows:
            side.setdefault(tuple(key), Counter())[text] += 1
    out = []
    for key in {*sides[0], *sides[1]}:
        a, b = (s.get(key) for s in sides)
        outcome = "new" if a is None else "inactive" if b is None else "same" if a == b else "changed"
        out.append((*key, outcome, sum((a or {}).values()), sum((b or {}).values())))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,n", [(1, 0), (2, 1), (3, 40), (4, 400)])
def test_lifecycle_diff(spark, seed, n):
    old, new = random_rows(seed, n), random_rows(seed + 100, n)
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (old, new)]
    got = snapshots.lifecycle_diff(*frames, ["id", "part"])
    assert sorted(map(tuple, got.collect()), key=str) == brute_diff(old, new)
    counts = dict(map(tuple, snapshots.outcome_counts(got).collect()))
    assert counts == Counter(r[2] for r in brute_diff(old, new))


def test_lifecycle_diff_moves_no_text(spark, tmp_path):
    spark.createDataFrame(random_rows(5, 50), SCHEMA).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan, moved = exchanges(snapshots.lifecycle_diff(df, df.where("id > 3"), ["id", "part"]))
    assert len(moved) == 1 and "text" not in plan[: plan.index("Exchange")]
    below = plan[plan.index("Exchange") :].splitlines()[1]
    assert "partial_sum" in below and "text" not in below  # added up by key before it is moved


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).glob("key_bucket=*/*.parquet")}


def table_rows(spark, path):
    return sorted(map(tuple, buckets.read_bucketed(spark, path).collect()), key=str)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/table"
    old = spark.createDataFrame([(i, "p", f"old {i}") for i in range(500)] + [(None, "p", "old")], SCHEMA)
    buckets.write_bucketed(old, path, ["id"], 16)
    before = files(path)
    new = [(3, "q", "b"), (3, "q", "a"), (None, "q", "new"), (9999, "q", "new")]
    touched = buckets.merge_bucketed(spark, path, spark.createDataFrame(new, SCHEMA), ["id"], 16)
    after = files(path)
    kept = {f for f in before if not any(f"key_bucket={b}/" in f for b in touched)}
    assert 0 < len(touched) <= 3 and kept and all(after[f] == before[f] for f in kept)
    assert not {f for f in before if f not in kept} & set(after)
    want = [(i, "p", f"old {i}") for i in range(500) if i != 3] + [(3, "q", "a"), (None, "q", "new"), (9999, "q", "new")]
    assert table_rows(spark, path) == sorted(want, key=str)
    assert buckets.merge_bucketed(spark, path, spark.createDataFrame([], SCHEMA), ["id"], 16) == []
    plan = buckets.touched_rows(spark, path, touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_merge_equals_upsert(spark, tmp_path):
    """Random batches, also into a table that is not there yet."""
    path, state = f"{tmp_path}/t", None
    for seed in range(4):
        batch = spark.createDataFrame(random_rows(seed, 60), SCHEMA)
        buckets.merge_bucketed(spark, path, batch, ["id", "part"], 7)
        state = batch if state is None else state
        state = sets.upsert(state.where("false") if seed == 0 else state, batch, ["id", "part"])
    assert table_rows(spark, path) == sorted(map(tuple, state.collect()), key=str)
    with pytest.raises(ValueError, match="more"):
        buckets.merge_bucketed(spark, path, batch.withColumn("more", F.lit(1)), ["id", "part"], 7)
    with pytest.raises(ValueError):
        buckets.write_bucketed(batch.withColumn("key_bucket", F.lit(1)), f"{path}2", ["id"], 7)


def test_cut_off_merge_is_finished(spark, tmp_path, monkeypatch):
    """The table loses a bucket while it is replaced; the same commit brings it back, once."""
    path = f"{tmp_path}/table"
    buckets.write_bucketed(spark.createDataFrame([(i, "p", "old") for i in range(90)], SCHEMA), path, ["id"], 4)
    new = spark.createDataFrame([(i, "p", "new") for i in range(60, 120)], SCHEMA)
    write = buckets._write

    def cut(rows, where, mode):
        for f in Path(where).glob("key_bucket=2/*"):
            f.unlink()
        raise RuntimeError("lost")

    monkeypatch.setattr(buckets, "_write", cut)
    with pytest.raises(RuntimeError):
        buckets.merge_bucketed(spark, path, new, ["id"], 4, commit=7)
    monkeypatch.setattr(buckets, "_write", write)
    assert buckets.merge_bucketed(spark, path, new, ["id"], 4, commit=7) == [0, 1, 2, 3]
    want = [(i, "p", "old" if i < 60 else "new") for i in range(120)]
    assert table_rows(spark, path) == sorted(want, key=str)
    stale = spark.createDataFrame([(1, "p", "replayed")], SCHEMA)
    assert buckets.merge_bucketed(spark, path, stale, ["id"], 4, commit=7) == []
    assert table_rows(spark, path) == sorted(want, key=str)


def test_stream_of_updates(spark, tmp_path):
    """Known ids are updated late, a batch is replayed, and the table is that of one batch run."""
    base, rows = str(tmp_path), []
    run = lambda: upsert_new_files(
        spark, f"{base}/in", spark.createDataFrame([], SCHEMA).schema, f"{base}/table", f"{base}/checkpoint",
        ["id"], 5, files_per_batch=1,
    ).awaitTermination()
    for part, ids in enumerate([range(50), range(40, 70), [3, 65, 100]]):
        new = [(i, f"p{part}", f"text {part}") for i in ids]
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        rows.append(new)
        run()
    run()  # nothing new
    want = {r[0]: r for batch in rows for r in batch}
    assert table_rows(spark, f"{base}/table") == sorted(want.values(), key=str)
    last = max(Path(f"{base}/checkpoint/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()  # as after a failure between the merge and the stream's own commit
    Path(f"{last.parent}/.{last.name}.crc").unlink(missing_ok=True)
    before = files(f"{base}/table")
    run()
    assert files(f"{base}/table") == before
    assert table_rows(spark, f"{base}/table") == sorted(want.values(), key=str)


NAMES = [
    "key_hash", "place", "any_new", "is_old", "bucket", "n_rows", "offset", "order_key", "clean_step",
    "new_value", "in_range", "new_id", "first", "counted", "digest", "is_new", "old_rows", "old_a",
]


@pytest.fixture(scope="module")
def named(spark):
    """Postings with a column for every name that operators use inside."""
    df = spark.range(30).select("id", F.lit("t").alias("title"), F.concat(F.lit("<p>d "), F.col("id") % 7).alias("description"),
                                F.lit("l").alias("location"))
    return df.select("*", *[F.concat(F.lit(f"{n} "), "id").alias(n) for n in NAMES])


def test_callers_columns_stay(named):
    columns = named.columns

    def check(df, n, more=()):
        assert sorted(df.columns) == sorted([*columns, *more])
        rows = df.collect()
        assert len(rows) == n
        assert all(r[name] == f"{name} {r.id}" for r in rows for name in NAMES)

    check(dedup.keep_first(named, ["description"], ["id"]), 7)
    check(sets.upsert(named, named.where("id < 4"), ["id"]), 30)
    check(sets.fill_values(named, named.select("id", F.lit("T").alias("title")), "id", "title"), 30)
    check(ordering.with_position(named, "id"), 30, ["position", "n_total"])
    check(ordering.slice_rows(named, "id", 3, 9), 6, ["position"])
    check(ordering.first_rows(named, "id", 5), 5)
    check(ordering.seeded_shuffle(named, "id"), 30)
    check(prep_postings(named, "id"), 7)
    check(prep_postings(named, "id", 4), 4)
    check(clean_description(named, "description"), 30)
    assert {r.description for r in clean_description(named, "description").collect()} == {f"d {i}" for i in range(7)}
    diff = snapshots.lifecycle_diff(named, named, ["id", "digest", "is_new", "old_rows"], ["title"])
    assert diff.where("outcome <> 'same'").count() == 0


def test_unused_names():
    assert unused(["A", "b_", "b"], "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]
