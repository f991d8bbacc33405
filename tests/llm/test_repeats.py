import hashlib
import random

import numpy as np
import pyarrow as pa

from sievemark.llm import repeats
from tests.llm.fixtures import LONG, awkward, documents, prose


def brute(rows):
    first = {}
    data = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t, _ in rows]
    for d, b in data:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for (doc_id, _, _), (d, b) in zip(rows, data):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, gone) if not c)
        runs = sum(1 for k, c in enumerate(gone) if c and not (k and gone[k - 1]))
        out.append((-1 if doc_id is None else doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(spark, rows):
    got = repeats.remove_repeats(documents(spark, rows)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_shared_passages_match_brute_force(spark):
    rng = random.Random(4)
    rows = [r for r in awkward(n=25) if r[1] != LONG]
    shared = [prose(rng, k) for k in (12, 14, 30, 80)] + ["ab" * 200, "x" * 300, "é中" * 60]
    for k in range(40):
        parts = [prose(rng, rng.randint(0, 25)) for _ in range(3)]
        rows.append((rng.randrange(10**6), parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared)[rng.randint(0, 20) :] + parts[2], "s"))
    for cut in (48, 49, 50, 51, 52):
        rows.append((200 + cut, "." * cut + "|" + shared[2][:cut], "s"))
    rows += [(900, "one text of an id that another row has too, " + shared[3], "s")]
    rows += [(900, "a different text of the same id, and its tail " + shared[3][50:], "s")]
    assert found(spark, rows) == brute(rows)


def test_chunks_give_the_same_result(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(rng, 600)
    rows = [(1, base, "s"), (2, "q" + base[100:2500], "s"), (3, prose(rng, 50) + base[700:] + "z" * 500, "s"), (4, "z" * 200, "s")]
    texts = [t.encode() for _, t, _ in rows]
    whole = repeats.phrases(texts, [(0, len(t) - 49) for t in texts])
    monkeypatch.setattr(repeats, "CHUNK", 500)
    for text in texts:
        pieces = list(repeats._pieces(text))
        own = [low + k for low, _, (a, b) in pieces for k in range(a, b)]
        assert own == list(range(max(0, len(text) - 49)))
        assert all(data == text[low : low + len(data)] for low, data, _ in pieces)
    assert whole["n"].sum() == sum(len(t) - 49 for t in texts)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_different_phrases_of_one_trigger_stay_apart():
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 256, (200_000, repeats.GRAM), dtype=np.uint8)
    data = grams.ravel()
    at = np.arange(len(grams)) * repeats.GRAM
    trigger = grams[repeats.Hashes(data).of(at, at + repeats.GRAM).argmin()]
    side = repeats.GRAMS - 1
    # About 300,000^2 / 2^33, so ten false equalities, if 32 bits told them apart.
    seen, n = {}, 0
    for _ in range(100):
        texts = rng.integers(0, 256, (3000, 2 * side + repeats.GRAM), dtype=np.uint8)
        texts[:, side : side + repeats.GRAM] = trigger
        found = repeats.phrases([t.tobytes() for t in texts], [(0, repeats.GRAMS)] * len(texts))
        whole = found["n"] == repeats.GRAMS
        for key, piece in zip(zip(found["g"][whole].tolist(), found["e"][whole].tolist()), found["piece"][whole].tolist()):
            n += 1
            assert seen.setdefault(key, texts[piece].tobytes()) == texts[piece].tobytes()
    assert n > 290_000 and len({g for g, _ in seen}) == 1


def test_second_window_hash_has_its_own_base(monkeypatch):
    texts = ["x" * 20 + c + "y" * 29 for c in "ab"]
    alike = repeats._BYTES.copy()
    alike[ord("a")] = alike[ord("b")]
    monkeypatch.setattr(repeats, "_BYTES", alike)
    marks = pa.array([[{"at": 0, "n": 1}]] * 2, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([0, 0], pa.int16()), pa.array(texts), marks], ["doc", "variant", "text", "marks"]
    )
    table = pa.Table.from_batches(list(repeats._send_windows(1)([batch])))
    rows = repeats._flat(table, list(repeats.WINDOWS))
    assert len(set(rows["h"].tolist())) == 1 and len(rows["h2"]) == 2
    assert not repeats._decide_windows(table).num_rows


def test_tasks_send_small_batches(monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 300) for _ in range(20)]
    texts += texts[:5]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(25)), pa.array([0] * 25, pa.int16()), pa.array(texts)], ["doc", "variant", "text"]
    )
    whole = list(repeats._send_phrases(500)([batch]))
    monkeypatch.setattr(repeats, "SEND", 40)
    small = list(repeats._send_phrases(500)([batch]))
    assert len(whole) == 1 and len(small) > 20
    assert pa.Table.from_batches(small).equals(pa.Table.from_batches(whole).combine_chunks())
    sizes = [len(b.column("g").flatten()) + len(b.column("done_n").flatten()) for b in small]
    assert all(size <= 40 or b.num_rows == 1 for size, b in zip(sizes, small))
    assert sum(len(b.column("done_n").flatten()) for b in small) > 100
