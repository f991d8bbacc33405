import hashlib
import random

from sievemark.llm import sketch
from tests.llm.fixtures import awkward, documents, prose


def brute_sketch(text):
    words = text.encode().split()
    shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = {hashlib.md5(s).hexdigest()[:16] for s in shingles}
    low = {h for h in hashes if h < sketch.THRESHOLD}
    return low or set(sorted(hashes)[:1])


def test_documents_and_edits(spark):
    rows = awkward()
    got = sketch.sketches_with_edits(documents(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    expected = []
    for (doc_id, text, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        a, b, c = map(brute_sketch, (text, edit, following))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        expected.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), "".join(sorted(a)),
                         "".join(sorted(b)), near(a, b), near(a, c), len(a & b) / len(a) if a else 1.0))
    key = lambda r: (-1 if r[0] is None else r[0], *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_one_document_follows_itself(spark):
    got = sketch.sketches_with_edits(documents(spark, [(5, "abcd", "s")])).first()
    assert got.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and got.near_next == 1.0
    assert sketch.sketches_with_edits(documents(spark, [])).collect() == []


def test_merging_and_containment():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([f"{rng.randrange(16**4):04x}" * 4 for _ in range(rng.choice([0, 1, 2, 30]))] for _ in range(2))
        assert sketch.merge(sketch.sketch(a), sketch.sketch(b)) == sketch.sketch(a + b)
    words = prose(rng, 9000).encode().split()
    whole, part = (sketch.sketch(sketch.shingle_hashes(w)) for w in (words, words[1000:1900]))
    assert sketch.containment(part, whole) == 1.0 and sketch.containment(whole, part) < 0.2
