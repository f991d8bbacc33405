"""Resumable jobs, sources, sinks and the streaming run."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from sievemark.jobs import resumable
from sievemark.jobs.answers import answer_distinct
from sievemark.jobs.encode import encode_columns, encode_texts, hashing_encoder, run_encode_job
from sievemark.jobs.labeller import label_multilabel, label_per_category, run_label_job, with_prompt
from sievemark.jobs.summary import fill_summaries, summarize
from sievemark.operators import joins, labels
from sievemark.plans.retrieval import retrieve_by_text
from sievemark.session import scratch_path, shared_dir
from sievemark.sources import readers, sinks
from sievemark.streaming.incremental import process_new_files

CATEGORIES = ["internship", "entry_level", "marketing"]


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(i, f"title {i}", f"text number {i} bad" if i == 7 else f"text number {i}") for i in range(40)]
    return spark.createDataFrame(rows, "id long, title string, description string")


def test_call_model_isolates_bad_texts():
    calls = []

    def fn(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    failed = (None, "RuntimeError: no")
    assert resumable.call_model(fn, ["a", "bad", "b"], retries=1) == [("A", None), failed, ("B", None)]
    assert resumable.call_model(fn, []) == []
    assert resumable.call_model(lambda t: [1], ["a", "b"], retries=0) == [(1, None), (1, None)]
    calls.clear()
    resumable.call_in_batches(fn, list("abcde"), 0, 2)
    assert calls == [2, 2, 1]


def answer(prompts):
    if any("bad" in p for p in prompts):
        raise RuntimeError("model down")
    return ['ok {"internship": 1, "entry_level": 1}' for _ in prompts]


def test_label_defaults_and_exclusion(posts):
    rows = {r.id: r for r in label_multilabel(posts, answer, "id", CATEGORIES, retries=0).collect()}
    assert len(rows) == 40
    assert tuple(rows[1])[1:] == (1, 0, 0, None)
    assert tuple(rows[7])[1:] == (0, 0, 0, "RuntimeError: model down")


def test_label_per_category(posts):
    def binary(prompts):
        return ["1\n" if "marketing" in p else "yes" for p in prompts]

    rows = label_per_category(posts, binary, "id", ["marketing", "finance"]).collect()
    assert len(rows) == 40 and all((r.marketing, r.finance) == (1, 0) for r in rows)


def test_label_job_resumes_without_repeating(spark, posts):
    path = scratch_path(spark, "labels")
    first = run_label_job(posts.where("id < 25"), answer, path, "id", CATEGORIES, n_slices=3, retries=0)
    assert first.count() == 24 and first.columns == ["id", *CATEGORIES]
    failed = spark.read.parquet(resumable.errors_path(path)).collect()
    assert [(r.id, r.error) for r in failed] == [(7, "RuntimeError: model down")]
    still = resumable.open_failures(spark, path, "id").collect()
    assert [(r.id, r.errors) for r in still] == [(7, ["RuntimeError: model down"])]
    marker = {r.id for r in first.collect()}

    def other(prompts):
        return ['{"marketing": 1}' for _ in prompts]

    second = run_label_job(posts, other, path, "id", CATEGORIES, n_slices=3).collect()
    assert len(second) == 40 == len({r.id for r in second})
    assert all((r.marketing == 0) == (r.id in marker) for r in second)
    assert resumable.open_failures(spark, path, "id").count() == 0
    assert run_label_job(posts, other, path, "id", CATEGORIES).count() == 40
    with pytest.raises(ValueError, match="mode"):
        run_label_job(posts, other, path, "id", mode="nope")


def test_a_dead_model_stores_nothing(spark, posts):
    def dead(prompts):
        raise RuntimeError("down")

    path = scratch_path(spark, "dead")
    with pytest.raises(RuntimeError, match="All 40 rows failed; first: RuntimeError: down"):
        run_label_job(posts, dead, path, "id", CATEGORIES, retries=0)
    healthy = run_label_job(posts, lambda p: ['{"marketing": 1}'] * len(p), path, "id", CATEGORIES)
    assert healthy.where("marketing = 1").count() == 40


def test_unreadable_results_are_not_taken_for_none(spark, posts):
    path = scratch_path(spark, "broken")
    assert resumable.read_done(spark, path) is None
    posts.select("title").write.text(path)
    with pytest.raises(Exception):
        run_label_job(posts, answer, path, "id", CATEGORIES)


def test_prompt_is_whole_unless_told(spark):
    df = spark.createDataFrame([("t" * 2000, "d" * 2000)], "title string, description string")
    assert with_prompt(df, "{title}|{description}").first().prompt == "t" * 2000 + "|" + "d" * 2000
    prompt = with_prompt(df, "{title}|{description}", max_chars=1500).first().prompt
    assert prompt == "t" * 2000 + "|" + "d" * 1500


def test_fill_summaries_writes_only_the_slice(spark, posts):
    master = posts.withColumn("summary", F.lit("old"))

    def model(prompts):
        if any("number 1" in p for p in prompts):
            raise RuntimeError("no")
        return [" s:" + p + "\n" for p in prompts]

    rows = fill_summaries(master, model, "id", 10, 30, "{title}", retries=0).collect()
    assert len(rows) == 40
    assert sum(r.summary == "old" for r in rows) == 20
    assert all(r.summary in ("old", f"s:{r.title}") for r in rows)
    failed = summarize(posts, model, "id", "{title} {description}", retries=0)
    assert failed.where("summary is null").count() == 11
    assert fill_summaries(posts, model, "id", 0, 1).columns[-1] == "summary"


def test_failed_summaries_are_listed_with_reasons(spark, posts):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["s" for _ in prompts]

    path = scratch_path(spark, "failed-summaries")
    rows = fill_summaries(posts, model, "id", 0, 40, retries=0, errors_to=path)
    assert rows.columns == [*posts.columns, "summary"]
    assert [r.id for r in rows.where("summary is null").collect()] == [7]
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(7, "RuntimeError: no")]
    fill_summaries(posts, lambda prompts: ["s" for _ in prompts], "id", 0, 40, errors_to=path)
    assert spark.read.parquet(path).count() == 0


def test_open_failures_of_a_job_without_any(spark, posts):
    path = scratch_path(spark, "no-failures")
    with pytest.raises(ValueError, match="No job"):
        resumable.open_failures(spark, path, "id")
    run_label_job(posts.where("id < 3"), answer, path, "id", CATEGORIES)
    assert resumable.open_failures(spark, path, "id").collect() == []


def test_encode_job_is_resumable_and_unit_length(spark, posts):
    path = scratch_path(spark, "vectors")
    columns = ["title", "description"]
    run_encode_job(posts.where("id % 2 = 0"), hashing_encoder(16), path, "id", columns)
    stored = run_encode_job(posts, hashing_encoder(16), path, "id", columns)
    again = run_encode_job(posts, hashing_encoder(16), path, "id", columns)
    assert stored.count() == again.count() == 40
    for r in again.collect():
        assert abs(sum(x * x for x in r.embedding) - 1) < 1e-9
    with pytest.raises(KeyError, match="nope"):
        encode_columns(posts, hashing_encoder(4), "id", ["nope"])


def test_failed_encodings_stay_pending(posts):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, 1.0] for _ in texts]

    answers = encode_texts(posts, model, "id", "description", retries=0)
    assert [(r.id, r.error) for r in answers.where("error is not null").collect()] == [(7, "RuntimeError: no")]
    done = answers.where("error is null")
    assert done.count() == 39
    assert [r.id for r in joins.pending_rows(posts, done, "id").collect()] == [7]


def test_similar_text_ranks_first(spark):
    """A software query is nearer to the software job than to the finance job."""
    posts = spark.createDataFrame(
        [
            (0, "Engineer", "develop software in python and review code", "X"),
            (1, "Accountant", "prepare tax reports and audit ledgers", "Y"),
        ],
        "id long, title string, description string, location string",
    )
    encode = hashing_encoder(256)
    requests = spark.createDataFrame(
        [(5, "sw", "python software engineer", 256)],
        "request_id int, category string, query_text string, dim int",
    )
    none = spark.createDataFrame([], "category string, query string")
    no_vectors = spark.createDataFrame(
        [], "category string, slot string, model_name string, vector array<double>"
    )
    corpus = encode_columns(posts, encode, "id")
    hits = retrieve_by_text(
        requests, corpus, posts, none, no_vectors, encode, 5, id_col="id",
        slots={256: ("embedding1", "m")},
    ).orderBy("rank").collect()
    assert [(r.rank, r.id, r.location) for r in hits] == [(1, 0, "X"), (2, 1, "Y")]
    own = encode_texts(posts, encode, "id", "description")
    stored_queries = spark.createDataFrame([("sw", "x")], "category string, query string")
    stored = own.where("id = 1").select(
        F.lit("sw").alias("category"), F.lit("embedding1").alias("slot"),
        F.lit("org/M").alias("model_name"), F.col("embedding").alias("vector"),
    )
    reused = retrieve_by_text(
        requests.withColumn("query_text", F.lit(" x ")), own, posts, stored_queries, stored, encode,
        1, id_col="id", slots={256: ("embedding1", "m")},
    ).first()
    assert (reused.id, round(reused.score, 6)) == (1, 1.0)

    def dead(texts):
        raise RuntimeError("down")

    with pytest.raises(Exception, match="No vector for request 5"):
        retrieve_by_text(
            requests, own, posts, none, no_vectors, dead, 1, id_col="id",
            slots={256: ("embedding1", "m")},
        )


class _Session:
    """Stands in for a session with the given settings."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, key, default):
        return self.settings.get(key.replace(".", "_"), default)


def test_shared_dir():
    configured = _Session(spark_checkpoint_dir="hdfs://x/c/", spark_master="yarn")
    assert shared_dir(configured) == "hdfs://x/c"
    local = _Session(spark_master="local[2]")
    assert shared_dir(local) == shared_dir(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session(spark_master="yarn"))


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:x", "SELECT 1", user="u")
    assert plain["query"] == "SELECT 1" and plain["user"] == "u" and "dbtable" not in plain
    split = readers.jdbc_options(
        "jdbc:x", "SELECT * FROM t", partition_column="id", lower_bound=0, upper_bound=9,
        num_partitions=3,
    )
    assert split["dbtable"] == "(SELECT * FROM t) source_rows" and "query" not in split
    assert (split["partitionColumn"], split["numPartitions"]) == ("id", "3")
    with pytest.raises(ValueError, match="partition_column"):
        readers.jdbc_options("jdbc:x", partition_column="id")


def test_fallback_order(spark, posts):
    def broken():
        raise RuntimeError("database down")

    assert readers.read_with_fallback(spark, lambda: posts, broken).count() == 40
    assert readers.read_with_fallback(spark, broken, lambda: posts).count() == 40
    assert readers.read_with_fallback(spark, lambda: posts.limit(0), lambda: posts).count() == 40
    empty = readers.read_with_fallback(spark, broken)
    assert empty.count() == 0 and empty.columns == [f.name for f in readers.POSTING_SCHEMA]


def test_csv_round_trip(spark):
    rows = [("1", 'a "b"\n\n c,', " x ", "y"), ("2", None, "\\\"", "l")]
    df = spark.createDataFrame(rows, readers.POSTING_SCHEMA)
    path = scratch_path(spark, "csv")
    sinks.write_csv(df, path)
    assert sorted(tuple(r) for r in readers.read_csv(spark, path).collect()) == rows


def test_subsets_and_manifest(spark, posts):
    wide = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "id long, a int, b int")
    subsets = labels.labels_to_subsets(posts, wide, "id", ["a", "b"])
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, "subsets")
        sinks.write_subsets(subsets, path, ["id", "title", "nope"], fmt)
        if fmt == "parquet":
            back = readers.read_subsets(spark, path)
        else:
            back = readers.read_csv_subsets(spark, path, subsets.select("id", "title").schema)
        assert back.columns == ["id", "title", "category"]
        assert {r.category: r["count"] for r in back.groupBy("category").count().collect()} == {
            "a": 20, "b": 10,
        }
    dim = joins.category_dim(spark, {"a": "A", "b": "B", "c": "C"})
    records = sinks.manifest(
        subsets, dim, "id", source="s", method="m", preprocessing={"row_limit": "1000"}
    )
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(records, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    by_cat = {x["category"]: x for x in lines}
    assert (by_cat["b"]["count"], by_cat["b"]["ids"]) == (10, list(range(1, 20, 2)))
    assert by_cat["c"]["count"] == 0 and by_cat["c"]["ids"] == []
    assert by_cat["a"]["preprocessing"] == {"row_limit": "1000"} and by_cat["a"]["generated_at"]


def test_written_vectors_are_read_back(spark, posts):
    rows = posts.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    path = scratch_path(spark, "vectors")
    assert sinks.write_vectors(rows, path, "v", 2).count() == 40
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_vectors(rows, path)
    with pytest.raises(ValueError, match="width 3"):
        sinks.write_vectors(rows, scratch_path(spark, "vectors"), "v", 3)


def test_stream_labels_each_posting_once(spark, posts):
    inbox, out, checkpoint = (scratch_path(spark, n) for n in ("inbox", "out", "checkpoint"))
    arrived = posts.select("id", F.lit("Junior Analyst").alias("title"))

    def run(transform=labels.label_by_rules):
        process_new_files(spark, inbox, arrived.schema, out, checkpoint, transform, "id").awaitTermination()
        return spark.read.parquet(out)

    arrived.where("id < 10").write.parquet(f"{inbox}")
    assert run().count() == 10
    arrived.where("id between 5 and 29").write.mode("append").parquet(f"{inbox}")
    assert run().count() == 30
    assert run().count() == 30


def test_written_vectors_are_computed_once(spark, tmp_path):
    """A counting function sees every row once, whatever is checked."""
    calls = f"{tmp_path}/calls"
    os.makedirs(calls)

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                with open(f"{calls}/{uuid.uuid4().hex}", "w") as file:
                    file.write(str(i))
            yield pdf.assign(v=[[float(i), 1.0] for i in pdf["id"]])

    rows = spark.range(10).repartition(3).mapInPandas(run, "id long, v array<double>")
    stored = sinks.write_vectors(rows, f"{tmp_path}/v", "v", 2, "id")
    assert sorted(r.id for r in stored.collect()) == list(range(10)) and len(os.listdir(calls)) == 10


def test_writing_checks_rows(spark, tmp_path, monkeypatch):
    """Other vectors under the same ids are noticed, though their number and width are right."""
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id long, v array<double>")
    other = rows.withColumn("v", F.array(F.lit(9.0), F.lit(0.0)))
    other.write.parquet(f"{tmp_path}/other")
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path: read(self, f"{tmp_path}/other"))
    assert sinks.write_vectors(rows, f"{tmp_path}/a", "v", 2).count() == 5
    with pytest.raises(ValueError, match="checksum"):
        sinks.write_vectors(rows, f"{tmp_path}/b", "v", 2, "id")
    with pytest.raises(ValueError):
        sinks.write_vectors(rows.where("false"), f"{tmp_path}/c", "v", 2, "id")


def test_one_call_per_distinct_prompt(spark, tmp_path):
    """Each prompt is seen once over two runs and two tables; failures are asked again."""
    calls, path = f"{tmp_path}/calls", f"{tmp_path}/answers"
    os.makedirs(calls)
    down = f"{tmp_path}/down"
    open(down, "w").close()

    def fn(prompts):
        if "b" in prompts and os.path.exists(down):
            raise RuntimeError("model down")
        for p in prompts:
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as file:
                file.write(p)
        return [p.upper() for p in prompts]

    def seen():
        return sorted(open(f"{calls}/{f}").read() for f in os.listdir(calls))

    def run(rows, **options):
        df = spark.createDataFrame(rows, "id long, prompt string, prompt_key string, answer string").repartition(4)
        found = answer_distinct(df, "prompt", fn, path, model="m", retries=0, **options)
        assert found.columns == ["id", "prompt", "prompt_key", "answer"]
        assert all(r.prompt_key == f"k{r.id}" for r in found.collect())
        return sorted(((r.id, r.answer) for r in found.collect()), key=str)

    rows = [(i, p, f"k{i}", "old") for i, p in enumerate(["a"] * 60 + ["b", "", None, "c", "a"])]
    want = {"a": "A", "b": "B", "": "", None: "", "c": "C"}
    assert run(rows) == sorted(((i, None if p == "b" else want[p]) for i, p, _, _ in rows), key=str)
    os.remove(down)
    more = rows + [(100, "d", "k100", None), (100, "d", "k100", None)]
    assert run(more, n_slices=2) == sorted(((i, {**want, "d": "D"}[p]) for i, p, _, _ in more), key=str)
    assert seen() == ["", "a", "b", "c", "d"]
    df = spark.createDataFrame([("a",)], "prompt string")
    assert answer_distinct(df, "prompt", fn, path, model="other").first().answer == "A"
    assert seen() == ["", "a", "a", "b", "c", "d"]
    assert answer_distinct(df.where("false"), "prompt", fn, f"{path}2", model="m").count() == 0


def test_counting_sees_the_subsets_once(spark, tmp_path):
    """Manifest and id lists compute the join behind them once."""
    calls = f"{tmp_path}/calls"
    os.makedirs(calls)

    def run(batches):
        for pdf in batches:
            for _ in range(len(pdf)):
                open(f"{calls}/{uuid.uuid4().hex}", "w").close()
            yield pdf.assign(category=["x" if i % 4 else "y" for i in pdf["id"]])

    subsets = spark.range(40).repartition(3).mapInPandas(run, "id long, category string")
    dim = joins.category_dim(spark, {"x": "X", "y": "Y", "z": "Z"})
    records = sinks.manifest(subsets, dim, "id", source="s", method="m", preprocessing={"a": "b"}, ids_per_chunk=7)
    rows = records.collect()
    assert len(os.listdir(calls)) == 40
    sizes = {c: sorted(len(r.ids) for r in rows if r.category == c) for c in "xyz"}
    assert sizes == {"x": [2, 7, 7, 7, 7], "y": [3, 7], "z": [0]}
    assert {r["count"] for r in rows if r.category == "x"} == {30}


def test_calls_get_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(resumable, "CALL_BYTES", 100)
    rows = [(i, "title", "x" * (i % 7) * 9) for i in range(60)] + [(60, None, None), (61, "long", "y" * 500)]
    df = spark.createDataFrame(rows, "id long, title string, description string").coalesce(1)

    def size(texts):
        return [str(sum(map(len, texts)) if len(texts) > 1 else 0) for _ in texts]

    got = resumable.map_texts(df.select("id", "description").na.fill(""), "id", "description", size, "string").collect()
    assert sorted(r.id for r in got) == list(range(62)) and max(int(r.value) for r in got) <= 100
    assert {r.error for r in got} == {None}

    def many(texts):
        return ["1" if len(texts) == 1 else "0" for _ in texts]

    labels = label_per_category(df, many, "id", CATEGORIES).collect()  # three prompts pass 100 bytes in every row
    assert len(labels) == 62 and {tuple(r)[1:] for r in labels} == {(1, 1, 1, None)}
