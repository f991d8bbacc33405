"""Every stage of the pipeline against brute force on what the stage before it kept."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from sievemark.llm import decontaminate, secret_scan, simhash, toxicity
from sievemark.session import scratch_path
from tests.llm.fixtures import LONG, awkward, documents, prose
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute as near

INSULT = "you are a stupid idiot and a worthless moron, pathetic clown"


def tables(spark, rows, items, marks):
    path = scratch_path(spark, "sf")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark):
    rng = random.Random(9)
    rows = [r for r in awkward() if r[1] != LONG and r[0] is not None]
    toxic = [(300 + i, f"{prose(rng, 30)} {INSULT} {prose(rng, 20)}", "s1") for i in range(20)]
    words = prose(rng, 500).split()
    copies = [(400 + i, " ".join([*words[:-1], f"end{i % 3}"]), "s2") for i in range(6)]
    items = [(i, prose(rng, 20)) for i in range(3)]
    leaked = [(500 + i, f"{prose(rng, 40)} {items[i % 3][1]} {prose(rng, 9)}", "s3") for i in range(5)]
    secret = [(600 + i, f'{prose(rng, 50)} token = "{i:02d}be64439e3e49cf46b2d7c9" x', "s0") for i in range(4)]
    rows += toxic + copies + leaked + secret
    marks = [(i, 1, int(300 <= i < 320)) for i, _, _ in rows]
    path = tables(spark, rows, items, marks)

    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch_path(spark, "stage")
        stage(spark, docs, path).write.parquet(out)
        seen[name], docs = (docs, spark.read.parquet(out)), spark.read.parquet(out)
        assert docs.columns[: len(columns)] == columns
        assert docs.columns == columns or name == "mixing"

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    def triples(df):
        return [(r.doc_id, r.text, r.source) for r in df.collect()]

    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{path}/labels.parquet")
    flagged = {r.doc_id for r in toxicity.score(before, labels).where("predicted = 1").collect()}
    assert flagged == {i for i, _, _ in toxic}
    assert ids(after) == [i for i in ids(before) if i not in flagged]

    before, after = seen["simhash near-dedup"]
    assert ids(after) == sorted({c for _, _, c in near(triples(before))})

    before, after = seen["benchmark decontamination"]
    leak = {d for d, _ in leaks(triples(before), items)}
    assert leak == {i for i, _, _ in leaked}
    assert ids(after) == [i for i in ids(before) if i not in leak]

    before, after = seen["secret scan"]
    novelty = secret_scan.Novelty()
    masked = {
        d: t if t is None else secret_scan.redacted(t, secret_scan.all_spans(t, novelty), "[secret]")
        for d, t, _ in triples(before)
    }
    assert {d: t for d, t, _ in triples(after)} == masked
    assert all("[secret]" in masked[i] for i, _, _ in secret)
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)

    before, after = seen["mixing"]
    kept = {r.doc_id: r for r in after.collect()}
    assert len(kept) == after.count() and set(kept) <= set(ids(before))
    assert all(0 < r.taken <= 3 * r.size for r in kept.values())

    again = corpus_pipeline.run(spark, path)
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect()))


def test_empty_tables(spark):
    path = tables(spark, [], [], [])
    assert corpus_pipeline.run(spark, path).collect() == []


def test_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(11)
    clean = [prose(rng, 60) for _ in range(6)]
    copy, lone = prose(rng, 60), prose(rng, 60)
    item = prose(rng, 20)
    leak = f"{prose(rng, 40)} {item} {prose(rng, 9)}"
    toxic = [f"{prose(rng, 30)} {INSULT} {prose(rng, 20)}" for _ in range(20)]

    def texts(df):
        return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())

    # The second text of id 5 is a copy of that of id 2; null ids copy id 2 and each other.
    near_rows = [(2, copy), (5, clean[0]), (5, copy), (None, copy), (None, clean[1]), (None, lone), (None, lone)]
    near_rows += [(7, clean[2]), (7, clean[2]), (7, clean[3])]
    kept = simhash.keep_one(documents(spark, [(i, t, "s") for i, t in near_rows]))
    assert texts(kept) == sorted(
        [(2, copy), (5, clean[0]), (-1, clean[1]), (-1, lone), (7, clean[2]), (7, clean[3])]
    )

    leak_rows = [(None, leak), (None, clean[0]), (3, leak), (3, clean[1])]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.reject(documents(spark, [(i, t, "s") for i, t in leak_rows]), benchmark)
    assert texts(kept) == sorted([(-1, clean[0]), (3, clean[1])])

    toxic_rows = [(300 + i, t) for i, t in enumerate(toxic[:-2])] + [(i, t) for i, t in enumerate(clean)]
    marks = [(i, 1, int(i >= 300)) for i, _ in toxic_rows]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    # The same words as in labelled texts, so that no cue found by chance is in them.
    other = [" ".join(reversed(t.split())) for t in clean[:2]]
    toxic_rows += [(None, toxic[-1]), (None, other[0]), (900, toxic[-2]), (900, other[1])]
    kept = toxicity.reject(documents(spark, [(i, t, "s") for i, t in toxic_rows]), labels)
    assert texts(kept) == sorted([(i, t) for i, t in enumerate(clean)] + [(-1, other[0]), (900, other[1])])


NAMES = [
    "gone", "again", "one", "lost", "twice", "kept_row", "toxic", "leaked", "digest", "label", "held_out", "score",
    "size", "mix_size", "source_size", "mix_taken", "target", "taken", "mix_id", "shard", "place", "weight", "group",
    "fingerprint", "key", "component_id", "least_id", "item_id", "shift", "hits", "n", "doc", "id", "of", "labelled_id",
]


def test_columns_of_any_name(spark):
    """Documents that already have a column for every name the stages use."""
    rng = random.Random(10)
    rows = [r for r in awkward() if r[1] != LONG]
    rows += [(300 + i, f"{prose(rng, 30)} {INSULT} {prose(rng, 20)}", "s1") for i in range(6)]
    rows += [(500, f"{prose(rng, 40)} {(item := prose(rng, 20))} {prose(rng, 9)}", "s3")]
    path = tables(spark, rows, [(1, item)], [(i, 1, int(300 <= i < 306)) for i, _, _ in rows if i is not None])
    plain = spark.read.parquet(f"{path}/documents.parquet")
    full = plain.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in NAMES])
    for name, stage in corpus_pipeline.STAGES:
        want = sorted(map(tuple, stage(spark, plain, path).select(*plain.columns).collect()), key=str)
        found = stage(spark, full, path)
        assert found.columns[: len(full.columns)] == full.columns
        assert len(set(found.columns)) == len(found.columns)
        if name != "mixing":
            assert found.columns == full.columns
        rows = found.collect()
        assert all(r[n] == f"{n} {-1 if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)
        assert sorted((tuple(r[c] for c in plain.columns) for r in rows), key=str) == want
        empty = stage(spark, full.where("false"), path)
        assert empty.count() == 0 and empty.columns == found.columns
