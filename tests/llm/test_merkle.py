import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sievemark.llm import merkle, queries
from tests.llm.fixtures import awkward, documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """(root, siblings per leaf as (before, after) lists) of one tree."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 16 * 16
            proofs[i].append((nodes[run:place], nodes[place + 1 : run + 16]))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [place // 16 for place in at]
    return nodes[0], proofs


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the contract's result."""
    make = lambda r, text: h(*map(framed, (r[0], r[3], r[2], r[4], text)))
    lower = lambda t: t if t is None else t.translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0], make(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        group = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = (group, *tree([x[1] for x in group]))
    root, above = tree([trees[name][1] for name in names])
    out = []
    for name, upper in zip(names, above):
        group, subroot, proofs = trees[name]
        for (doc_id, leaf, r), proof in zip(group, proofs):
            proof = proof + upper
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            found = make(r, lower(r[1])) if tampered else leaf
            for before, after in proof:
                found = h(*before, found, *after)
            digests = "".join(d for before, after in proof for d in before + after)
            out.append((doc_id, leaf, subroot, root, h(digests), found, found == root))
    return out


def key(row):
    return tuple(map(str, row))


def checked(df):
    return sorted(map(tuple, queries.merkle_rows(df).collect()), key=key)


def test_awkward_rows(spark):
    rows = awkward()
    got = checked(documents(spark, rows))
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    assert got == sorted(brute(full), key=key)


@pytest.mark.parametrize("sizes", [[1], [2, 1, 16, 17, 256, 257], [4096, 4097, 3], [1] * 300])
def test_tree_sizes(spark, sizes):
    rng = random.Random(3)
    rows = [(f"Text {i} {s}", None if s == 1 else f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    full = [(i, t, "en", s, len(t)) for i, (t, s) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    assert checked(df.repartition(5)) == sorted(brute(full), key=key)


def test_empty_table(spark):
    assert checked(documents(spark, [])) == []


def test_third_layer_of_blocks(spark, monkeypatch):
    """Small blocks, so that a few thousand rows need many layers."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 4)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    full = [(i, f"T{i}", "en", "s" if i % 3 else None, 2) for i in range(5000)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    assert checked(df) == sorted(brute(full), key=key)


def test_repeated_and_null_ids(spark):
    full = [(None if i % 2 else 7, f"T{i % 9}", None, "hot", None) for i in range(700)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    assert checked(df) == sorted(brute(full), key=key)


def test_proofs_verify_and_carry(spark):
    """The operator alone: any group, order and fields, and columns with the names it uses inside."""
    names = ["tree", "digest", "item", "kids", "block", "n", "rank", "run", "place", "path", "root", "leaf", "by"]
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), *[F.lit(1).alias(c) for c in names])
    out = merkle.manifest(df, ["k", "tree"], group="g", order="k", carry={"claim": merkle.leaf(F.col("k"), F.lit(2))})
    good = out.withColumn("ok", merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root"))
    bad = out.withColumn("ok", merkle.fold(F.col("claim"), F.col("proof")) == F.col("root"))
    assert good.where("ok").count() == 40 and bad.where("ok").count() == 0
    assert out.select("root").distinct().count() == 1 and out.select("subroot").distinct().count() == 3
