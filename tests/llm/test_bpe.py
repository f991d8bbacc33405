import hashlib
import json
import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievemark.llm import bpe, queries
from tests.llm.fixtures import awkward, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "the", "Cats", "running", " ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "'s", "'S", "'LL", "'", "1", "42",
    "½", "É", "é", "ß", "İ", "ΑΣ", "Σ", "ñ", "中文字", "日本", "ك", "\U0001f600", "\U0001f469‍\U0001f4bb",
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "...", "--", "$%&", "\x00", "\x07", "﻿", "ͅ", "ǅ",
    "ạ̇", "Å", "ﬁ", "</w>", "http://x.y/z?q=1",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts_as_the_library(spark, library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]
    # Characters that Python's tables do not know are classed by the age of each library's own.
    assigned = [chr(c) for c in range(32, 0x2FFF) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts += ["".join(rng.choices(assigned, k=40)) for _ in range(1500)]
    vocabulary = bpe.read_vocabulary(PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    coded = df.select("i", bpe.encode(F.col("t"), vocabulary).alias("ids"))
    got = {r.i: (r.ids, r.text) for r in coded.select("i", "ids", bpe.decode(F.col("ids"), vocabulary).alias("text")).collect()}
    wrong = [(t, got[i], expected(library, t)) for i, t in enumerate(texts) if got[i] != expected(library, t)]
    assert not wrong, wrong[:2]


def test_query_rows(spark, library):
    rows = awkward()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, _ in rows:
        ids, back = expected(library, text or "")
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(back)))
    got = queries.bpe_rows(documents(spark, rows), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert queries.bpe_rows(documents(spark, []), PATH).collect() == []


def test_long_words(library):
    rng = random.Random(6)
    words = bpe.WordBpe(bpe.read_vocabulary(PATH))
    texts = [
        "".join(rng.choices(letters, k=n))
        for n in (1, 2, 63, 64, 65, 66, 500, 3000)
        for letters in ("ab", "thein", "!", "中文é", "aeioutnrsl")
    ]
    for text, ids in zip(texts, words.encode(texts)):
        assert ids.tolist() == expected(library, text)[0]
    assert len(words.encode(["ab" * 300_000])[0]) == len(expected(library, "ab" * 300_000)[0])
    assert max(map(len, words.known)) <= bpe.SHORT


def test_scan_and_heap_agree():
    rng = random.Random(7)
    for _ in range(60):
        pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(60)}
        ranks = {a << bpe.PAIR_BITS | b: r for r, (a, b) in enumerate(pairs)}
        merged = np.array([rng.randrange(12) for _ in ranks])
        ranks_of = np.vectorize(lambda a, b: ranks.get(int(a) << bpe.PAIR_BITS | int(b), bpe.NEVER), otypes=[np.int64])
        parts = np.array([[rng.randrange(5) for _ in range(9)] for _ in range(30)])
        want = [bpe.merged_by_heap(p, ranks, merged) for p in parts.tolist()]
        assert bpe.merged_by_scan(parts, ranks_of, merged) == want
        for p, ids in zip(parts.tolist(), want):
            while True:
                found = [(ranks.get(a << bpe.PAIR_BITS | b, bpe.NEVER), i) for i, (a, b) in enumerate(zip(p, p[1:]))]
                if not found or min(found)[0] == bpe.NEVER:
                    break
                rank, i = min(found)
                p[i : i + 2] = [int(merged[rank])]
            assert p == ids


def test_known_words_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    words = bpe.WordBpe(bpe.read_vocabulary(PATH))
    for text in ("one two three four", "five six one two " + "x" * 200, "six seven", ""):
        assert words.encode([text])[0].tolist() == expected(library, text)[0]
        assert len(words.known) <= 7


def test_decode_takes_any_ids(spark):
    vocabulary = bpe.read_vocabulary(PATH)
    df = spark.createDataFrame([([320, None, 99999999, -1, 49407],), ([],), (None,)], "ids array<int>")
    got = [r[0] for r in df.select(bpe.decode(F.col("ids"), vocabulary)).collect()]
    assert got == ["a</w> <|endoftext|>", "", None]


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.loads(bpe.read_vocabulary(PATH))
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}
    with pytest.raises(ValueError):
        bpe.WordBpe(json.dumps(spec).encode())
    (tmp_path / "v.json").write_bytes(b"x")
    with pytest.raises(ValueError):
        bpe.read_vocabulary(str(tmp_path / "v.json"))


def test_large_texts_are_taken_in_slices(library):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("etaoin", k=2)) for _ in range(20_000)) for _ in range(200)]
    texts[3] = ""
    words = bpe.WordBpe(bpe.read_vocabulary(PATH))
    tracemalloc.start()
    found = list(bpe._encoded(words, pa.array(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # the words of all 200 texts take 200 MB
    ids = pa.concat_arrays(found).to_pylist()
    assert len(ids) == 200 and ids[3] == [] and ids[9] == expected(library, texts[9])[0]
    assert max(map(len, found)) < 100 and all(type(x) is bytes for x in words.known.values())


def test_slices_cover_every_row_once(monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 3)
    monkeypatch.setattr(bpe, "BYTES", 10)
    sizes = [0, 4, 6, 1, 30, 2, 2, 2, 2, None, 0, 11]
    rows = pa.array(range(12))
    assert [x.to_pylist() for x in bpe._slices(rows, pa.array(sizes))] == [[0, 1, 2], [3], [4], [5, 6, 7], [8, 9, 10], [11]]
    assert not list(bpe._slices(rows[:0], pa.array([], pa.int32())))
