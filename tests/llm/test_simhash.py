import random
import re

import numpy as np
import xxhash

from sievemark.llm import simhash
from sievemark.llm.components import components
from tests.llm.fixtures import awkward, documents, prose


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = roots(len(rows), near)
    least = {}
    for r, (doc_id, _, _) in zip(root, rows):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d if d is not None else -1), format(p, "016x"), least.get(r, -1)) for (d, _, _), p, r in zip(rows, prints, root))


def test_documents_match_brute_force(spark):
    rng = random.Random(5)
    rows = awkward()
    for k in range(6):
        words = prose(rng, 400).split()
        for copy in range(5):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(400)] = "Changed"
            rows.append((500 + 10 * k + copy, " ".join(changed), "s"))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got)
    expected = brute(rows)
    assert found == expected
    assert len({c for _, _, c in expected}) < len(rows) - 10
    kept = simhash.keep_one(documents(spark, rows)).toPandas()
    least = {c for d, _, c in expected if c >= 0}
    assert sorted(kept.doc_id.dropna()) == sorted(least)


def test_links_of_random_neighbourhoods(spark):
    rng = np.random.default_rng(2)
    prints = set()
    for _ in range(60):
        value = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(8):
            prints.add(value)
            for bit in rng.choice(64, size=rng.integers(1, 5), replace=False):
                value ^= 1 << int(bit)
    prints = sorted(prints)
    signed = [p - (1 << 64 if p >> 63 else 0) for p in prints]
    table = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fingerprint long, least_id long")
    near = components(simhash._near_links(table))
    from pyspark.sql import functions as F

    grouped = table.join(near, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("group")
    )
    links = {frozenset((r.a, r.b)) for r in simhash._far_links(grouped, 3).collect()}
    group = {r.fingerprint: r["group"] for r in grouped.collect()}
    names = sorted(set(group.values()))
    ours = [(names.index(a), names.index(b)) for a, b in map(tuple, links)]
    merged = dict(zip(names, roots(len(names), ours)))
    classes = [merged[group[s]] for s in signed]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    expected = roots(len(prints), pairs)
    assert len(set(zip(classes, expected))) == len(set(classes)) == len(set(expected))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 300)
    edges = list(zip(ids[:100], ids[1:100])) + [(ids[100], x) for x in ids[101:200]] + [(ids[250], ids[250])]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in ids[:100]} == {got[ids[0]]} and {got[x] for x in ids[100:200]} == {got[ids[100]]}
    assert got[ids[0]] != got[ids[100]] and set(got) == set(ids[:200])


def test_empty_table(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []
