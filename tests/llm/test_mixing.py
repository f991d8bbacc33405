import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sievemark.llm import mixing
from tests.llm.fixtures import awkward, documents, prose


def brute_targets(sizes, weights=(1, 2, 3)):
    """Targets by repeated sharing, over {source: size}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def brute_seats(weights, most, seats):
    """Seats one by one to the highest quotient, ties to the first party."""
    won = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(won)) if won[i] < most[i] and weights[i] > 0]
        if not open_:
            break
        won[max(open_, key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
    return won


def test_seats_match_one_by_one(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for g in range(40):
        n = rng.randint(1, 12)
        weights = [float(rng.choice([0, 1, 2, 3, 50, 1000, rng.random() * 9])) for _ in range(n)]
        seats = rng.choice([0, 1, 7, 100, 999])
        total = sum(weights) or 1
        most = [rng.choice([10_000, math.ceil(seats * w / total)]) for w in weights]
        expected[g] = brute_seats(weights, most, seats)
        rows += [(g, i, w, m, seats) for i, (w, m) in enumerate(zip(weights, most))]
    table = spark.createDataFrame(rows, "g int, p int, weight double, most long, seats long")
    got = mixing.apportion(table, ["g"], ["p"]).collect()
    for g in expected:
        assert [r.quota for r in sorted((r for r in got if r.g == g), key=lambda r: r.p)] == expected[g]


@pytest.mark.parametrize("seed", [1, 2])
def test_sources_come_near_their_targets(spark, seed):
    rng = random.Random(seed)
    rows = awkward(seed)
    rows += [(5000 + i, prose(rng, rng.randint(1, 120)), rng.choice(["hot"] * 6 + ["a", "B", "é", "z", None])) for i in range(900)]
    rows += [(9000, "tiny", "one word"), (9001, None, "empty source")]
    df = documents(spark, rows)
    got = mixing.mix(df, shard_docs=50).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted(
        (-1 if d is None else d, words(t)) for d, t, _ in rows
    )
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    targets = brute_targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {size}
        assert all(abs(r.target - targets[source]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[source]) <= max(32, 0.02 * targets[source])
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    again = mixing.mix(df.repartition(7), shard_docs=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    kept = mixing.mixed_documents(df).where(F.col("doc_id") >= 5000)
    assert kept.columns[: len(df.columns)] == df.columns and kept.where("taken <= 0").count() == 0


def test_empty_tables(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    nothing = mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in nothing] == [(0, 0, 0.0)] * 2
