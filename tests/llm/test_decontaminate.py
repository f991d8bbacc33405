import random
import re

import pytest

from sievemark.llm import decontaminate
from tests.llm.fixtures import awkward, documents, prose


def brute(rows, items):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for doc_id, text, _ in rows:
        d = tok(text)
        for item_id, item in items:
            t = tok(item)
            if len(t) < 5:
                continue
            length = min(13, len(t))
            need = 11 if length == 13 else length
            for shift in range(-len(t), len(d) + 1):
                eq = [0 <= j + shift < len(d) and d[j + shift] == t[j] for j in range(len(t))]
                if any(sum(eq[s : s + length]) >= need for s in range(len(t) - length + 1)):
                    found.add((doc_id, item_id))
                    break
    return found


def test_passages_with_replaced_words(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, rng.choice([13, 14, 20, 40]))) for k in range(12)]
    items += [(50, prose(rng, 7)), (51, "too short item"), (52, None), (53, ""), (None, prose(rng, 16))]
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 50_000]
    for k, (_, item) in enumerate(items[:12]):
        words = item.split()
        for step, gap in enumerate((0, 12, 7, 6, 5, 4)):
            changed = [("Zz" if gap and i % gap == step else w.upper()) for i, w in enumerate(words)]
            rows.append((1000 + 10 * k + step, f"{prose(rng, 9)}, {'! '.join(changed)} {prose(rng, 4)}", "s"))
    rows += [(2000, items[12][1], "s"), (2001, " ".join(items[12][1].split()[:-1]), "s")]
    rows += [(2002, f"a {items[16][1]}", "s"), (2003, " ".join(items[0][1].split()[1:]), "s")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(documents(spark, rows), table)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    expected = brute(rows, items)
    assert got == expected and (1000, 0) in got and len(got) > 30
    kept = decontaminate.reject(documents(spark, rows), table)
    flagged = {d for d, _ in expected}
    assert sorted(kept.toPandas().doc_id.fillna(-1)) == sorted(
        -1 if r[0] is None else r[0] for r in rows if r[0] not in flagged
    )
    assert kept.columns == documents(spark, rows).columns


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    docs = documents(spark, [] if empty == "docs" else [(1, "a b c d e f", "s")])
    items = spark.createDataFrame([] if empty == "items" else [(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.overlaps(docs, items).collect() == []


def test_masks_leave_no_window_out():
    from itertools import combinations

    for phase in range(decontaminate.STEP):
        for lost in combinations(range(decontaminate.WINDOW), 2):
            assert any(
                not set(lost) & {start + i for i, c in enumerate(mask) if c == "1"}
                for mask in decontaminate.MASKS
                for start in range(phase, decontaminate.WINDOW - len(mask) + 1, decontaminate.STEP)
            )


def test_no_python_in_the_plan(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    plan = decontaminate.overlaps(documents(spark, awkward()), items)
    assert "Python" not in plan._jdf.queryExecution().toString()
