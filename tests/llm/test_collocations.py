import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievemark.llm import collocations
from tests.llm.fixtures import awkward

SCHEMA = "doc_id long, lang string, text string, f long, w1 string, run int, place long, score string, rank int, n int"


def frame(spark, rows):
    """(lang, text) rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, *r, 1, "x", 2, 3, "y", 4, 5) for i, r in enumerate(rows)], SCHEMA)


def brute(rows, least=10, within=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        key = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[key] += len(words)
            for size in (1, 2, 3):
                f[key].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for part in (p[:2], p[1:]) if len(p) == 3 else ():
                longest[part] = max(longest[part], a)
        rows = []
        for p, a in found.items():
            if len(p) == 2 and longest[p] and 100 * longest[p] >= within * a:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, partitions=3, **options):
    return sorted(map(tuple, collocations.collocations(frame(spark, rows).repartition(partitions), **options).collect()))


def texts(seed, many, words, langs=("en", None, "de")):
    rng = random.Random(seed)
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " - ", "?", "\x01 "]
    rows = []
    for _ in range(many):
        picked = rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60))
        rows.append((rng.choice(langs), "".join(w + rng.choice(ends) for w in picked)))
    return rows


WORDS = ["the", "The", "a", "of", "é", "\x01x", "the\x01", "zebra", "new", "york", "city", "中", "--", "b", "c", "d"]


def test_awkward_texts(spark):
    rows = texts(1, 400, WORDS) + [(None, None), ("", "x y " * 12), ("en", ""), ("fr", " \t"), ("en", "hot dog " * 5000)]
    want = brute(rows)
    assert found(spark, rows) == want and len(want) > 100
    copies = [(None, t) for _, t, _ in awkward()] * 3
    assert found(spark, copies) == brute(copies)


@pytest.mark.parametrize("least,within,top", [(1, 50, 2000), (3, 100, 7), (2, 1, 50)])
def test_parameters_and_ties(spark, least, within, top):
    rows = texts(2, 60, WORDS[:9])
    assert found(spark, rows, least=least, within_percent=within, top=top) == brute(rows, least, within, top)


def test_a_word_that_begins_most_phrases(spark):
    """Its phrases are spread over all ranges, and so are those that it ends."""
    rows = [("en", f"hot w{i} v{i % 50}. u{i % 50} w{i} hot") for i in range(400) for _ in range(3)]
    assert found(spark, rows, least=3) == brute(rows, least=3)


def test_small_chunks_and_a_full_map(spark, monkeypatch):
    """Neither the size of chunks nor a map in which every bit is set changes a result."""
    rows = texts(3, 300, WORDS)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 50)
    monkeypatch.setattr(collocations, "MAP_BITS", 15)
    monkeypatch.setattr(collocations, "_bit_map", lambda pairs: collocations.np.full(4096, 255, "uint8"))
    assert found(spark, rows, least=2) == brute(rows, least=2)


def test_map_holds_every_frequent_pair(spark):
    rng = random.Random(4)
    pairs = [rng.getrandbits(63) - 2**62 for _ in range(5000)] + [0, -1, 2**63 - 1, -(2**63), 32767, 32768]
    bits = collocations._bit_map(spark.createDataFrame([(p,) for p in pairs], "pair long"))
    at = {p & ((1 << collocations.MAP_BITS) - 1) for p in pairs}
    assert {i for i in at if bits[i >> 3] >> (i & 7) & 1} == at
    assert sum(int(b).bit_count() for b in bits[bits > 0]) == len(at)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_scores_are_exact(spark):
    big = 9_007_199_254_740_993
    df = spark.createDataFrame([(big, big + 2, big + 4)], "a long, x long, y long")
    score = df.select(collocations._score("x", "y").alias("s")).first().s
    assert score == 1_000_000 * big * big // ((big + 2) * (big + 4))
    assert df.select(F.typeof(collocations._score("x", "y"))).first()[0] == "bigint"
