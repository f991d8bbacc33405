"""Exact repeats across documents by prefix-free parsing.

Rolling hashes cut every text into phrases: a phrase is a longest run of windows of 50 bytes with
the same smallest rolling hash of 12 bytes, its trigger, together with the bytes that its windows
reach. Where phrases end depends on the nearby bytes only, so a repeated passage is cut alike
everywhere, and every window lies in exactly one phrase.

Equal windows have equal triggers. Phrases are therefore ordered by trigger, then by the hash of
the whole phrase, then by document, which is all of the corpus order that windows of a fixed
length need:

- a phrase that starts in a smaller document is covered as a whole;
- a phrase that is the first of its kind, but whose trigger has other phrases with the same bytes
  to the left or right of it, is looked at window by window: the suffixes of these dictionary
  phrases are ordered by the hash of their first 50 bytes;
- all others are unique.

Tasks drop what they can decide alone before anything is shuffled, so of a phrase that is common
to many documents each task sends one. Documents meet their spans again in a join by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import partitions_of, small_side
from sievemark.session import materialize

LENGTH, GRAM = 50, 12
GRAMS = LENGTH - GRAM + 1  # in a window
SIDE = (LENGTH - GRAM + 1) // 2  # bytes that a shared window has on one side of the trigger
CHUNK = 250_000  # bytes that are hashed at a time
FLUSH = 250_000  # phrases that a task collects before it sends them
SEND = 20_000  # phrases or windows in a batch that leaves a task, if no single bucket has more
BUCKETS = 4  # per shuffle partition
LAST_ID = 2**63 - 1

_BYTES = np.frombuffer(hashlib.shake_256(b"byte values").digest(2048), np.uint64)
_BASE = 0x9E3779B97F4A7C15
# Of a second hash, so that its bits say more than those of the first.
_BYTES_2 = np.frombuffer(hashlib.shake_256(b"second byte values").digest(2048), np.uint64)
_BASE_2 = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 2**64))
        done += more
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by base, of it and of its inverse


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of ``base`` and of its inverse."""
    if base not in _POWERS or n > len(_POWERS[base][0]):
        _POWERS[base] = _powers(base, 2 * n), _powers(pow(base, -1, 2**64), 2 * n)
    return _POWERS[base]


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Rolling hashes of all substrings of ``data``."""

    def __init__(self, data: np.ndarray, base: int = _BASE, values: np.ndarray | None = None) -> None:
        self.power, inverse = _powers_of(base, len(data) + 1)
        values = _BYTES if values is None else values
        sums = np.cumsum(values[data] * inverse[: len(data)], dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), sums))

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.power[start]

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return _mixed(self.raw(start, end), salt)


def _window_minima(grams: np.ndarray) -> np.ndarray:
    """Smallest gram hash of the window at every place."""
    least, width = grams, 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = GRAMS - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def _ends(lengths: list[int]) -> np.ndarray:
    return np.cumsum(np.array(lengths, np.int64))


def phrases(pieces: list[bytes], own: list[tuple[int, int]]) -> dict[str, np.ndarray]:
    """Phrases of ``pieces``, whose windows at starts ``own`` (first, end) count.

    Returns piece, at (start in the piece), n (windows), g (trigger), e (phrase), sides (16 bits
    of the hash to the left and right of the trigger, 0 where the piece ends; -1 if the trigger
    occurs more than once), place (of the trigger in the phrase)."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    hashes = Hashes(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(places, places + GRAM)
    least = _window_minima(grams)
    owner = np.full(len(least), -1, np.int32)
    piece_end = _ends([len(p) for p in pieces])
    piece_start = piece_end - [len(p) for p in pieces]
    for i, (first, end) in enumerate(own):
        if end > first:
            owner[piece_start[i] + first : piece_start[i] + end] = i
    cut = np.flatnonzero((least[1:] != least[:-1]) | (owner[1:] != owner[:-1])) + 1
    start = np.concatenate(([0], cut))
    end = np.concatenate((cut, [len(least)]))
    real = owner[start] >= 0
    start, end = start[real], end[real]
    piece, g = owner[start], least[start]
    inside = np.arange(GRAMS)
    first = start + (grams[start[:, None] + inside] == g[:, None]).argmax(axis=1)
    back = (grams[(end - 1)[:, None] + inside[::-1]] == g[:, None]).argmax(axis=1)
    single = first == end - 1 + GRAMS - 1 - back
    left_ok = first - SIDE >= piece_start[piece]
    right_ok = first + GRAM + SIDE <= piece_end[piece]
    left = hashes.of(np.where(left_ok, first - SIDE, first), first + GRAM, 1) >> np.uint64(48)
    right = hashes.of(first, np.where(right_ok, first + GRAM + SIDE, first), 2) >> np.uint64(48)
    left = np.where(left_ok, np.maximum(left, 1), 0).astype(np.int64)
    right = np.where(right_ok, np.maximum(right, 1), 0).astype(np.int64)
    sides = (left << 16 | right).astype(np.uint32).view(np.int32)
    return {
        "piece": piece,
        "at": start - piece_start[piece],
        "n": end - start,
        "g": g.view(np.int64),
        "e": hashes.of(start, end - 1 + LENGTH, 3).view(np.int64),
        "sides": np.where(single, sides, -1).astype(np.int32),
        "place": (first - start).astype(np.int8),
    }


def _pieces(text: bytes) -> Iterator[tuple[int, bytes, tuple[int, int]]]:
    """(offset, bytes, own window starts in them) of chunks of ``text`` with margins."""
    last = len(text) - LENGTH + 1
    for s in range(0, max(last, 0), CHUNK):
        low = max(0, s - LENGTH)
        e = min(s + CHUNK, last)
        yield low, text[low : e + 2 * LENGTH], (s - low, e - low)


FIELDS = {"g": pa.int64(), "e": pa.int64(), "sides": pa.int32(), "doc": pa.int64(),
          "variant": pa.int16(), "at": pa.int32(), "n": pa.int32(), "place": pa.int8()}
DONE = {"done_doc": pa.int64(), "done_variant": pa.int16(), "done_at": pa.int32(), "done_n": pa.int32()}


def _dealt(
    rows: dict[str, np.ndarray], key: list[str], buckets: int, fields: dict[str, pa.DataType]
) -> Iterator[pa.RecordBatch]:
    """One row of lists per bucket of the first key column, in batches of about ``SEND`` entries. Rows
    of a key after its smallest document are decided here and sent as done."""
    order = np.lexsort((rows["doc"], *[rows[k] for k in reversed(key)]))
    first, _ = _firsts({k: rows[k][order] for k in key}, key)
    keep = rows["doc"][order] == rows["doc"][order[first]]
    bucket = ((rows[key[0]][order].view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
    by_bucket = np.argsort(bucket, kind="stable")
    order, keep, bucket = order[by_bucket], keep[by_bucket], bucket[by_bucket]
    begins = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    a = 0
    while a < len(begins) - 1:
        b = max(a + 1, int(np.searchsorted(begins, begins[a] + SEND, "right")) - 1)
        low, high = begins[a], begins[b]
        here, kept = order[low:high], keep[low:high]
        columns = [pa.array(bucket[begins[a:b]], pa.int32())]
        for names, chosen in ((fields, kept), (DONE, ~kept)):
            ends = np.append(0, np.cumsum(chosen))[begins[a : b + 1] - low]
            for k, t in names.items():
                values = rows[k.removeprefix("done_")][here[chosen]]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, t)))
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *fields, *DONE])
        a = b


def _firsts(rows: dict[str, np.ndarray], key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by ``key``: the first row of each row's key, and where keys begin."""
    begins = np.ones(len(rows[key[0]]), bool)
    for i, k in enumerate(key):
        change = rows[k][1:] != rows[k][:-1]
        begins[1:] = change if not i else begins[1:] | change
    starts = np.flatnonzero(begins)
    return starts[np.cumsum(begins) - 1], begins


def _lists(fields: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.int16(): "smallint", pa.int8(): "tinyint"}
    kinds = {**fields, **DONE}
    return "bucket int, " + ", ".join(f"{k} array<{names[t]}>" for k, t in kinds.items())


def _flat(table: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    out = {}
    for k in names:
        chunks = [c.flatten() for c in table[k].chunks]
        out[k] = np.concatenate([c.to_numpy(zero_copy_only=False) for c in chunks]) if chunks else np.zeros(0, int)
    return out


SPANS = pa.schema(
    [("doc", pa.int64()), ("variant", pa.int16()), ("at", pa.int32()), ("n", pa.int32()), ("detail", pa.bool_())]
)
SPANS_SQL = "doc bigint, variant smallint, at int, n int, detail boolean"


def _spans(*parts: tuple[dict[str, np.ndarray], np.ndarray, str, bool]) -> pa.Table:
    """Rows of SPANS from (rows, chosen, prefix of the names, detail)."""
    columns = [
        np.concatenate([rows[prefix + k][chosen] for rows, chosen, prefix, _ in parts])
        for k in ("doc", "variant", "at", "n")
    ]
    detail = np.concatenate([np.full(int(chosen.sum()), flag) for _, chosen, _, flag in parts])
    kinds = [f.type for f in SPANS]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip([*columns, detail], kinds)], schema=SPANS)


def _decide_phrases(table: pa.Table) -> pa.Table:
    """Covered phrases, and those to look at by window, of one bucket of triggers."""
    rows, done = _flat(table, list(FIELDS)), _flat(table, list(DONE))
    order = np.lexsort((rows["doc"], rows["e"], rows["g"]))
    rows = {k: v[order] for k, v in rows.items()}
    every = np.ones(len(done["done_doc"]), bool)
    if not len(order):
        return _spans((rows, np.zeros(0, bool), "", False), (done, every, "done_", False))
    first, begins = _firsts(rows, ["g", "e"])
    covered = rows["doc"] > rows["doc"][first]
    trigger, _ = _firsts(rows, ["g"])
    # A window shared with another phrase of the trigger has SIDE bytes in common with it to the
    # left of the trigger, or else to the right. Only phrases of other documents matter.
    kinds = np.flatnonzero(begins)
    group, docs = trigger[kinds], rows["doc"][kinds]
    sides = rows["sides"][kinds].view(np.uint32).astype(np.int64)
    repeated = np.zeros(len(order), bool)
    repeated[group[rows["sides"][kinds] == -1]] = True
    left, right = sides >> 16, sides & 0xFFFF
    left_alike = (left > 0) & _differ([group, left], docs)
    right_alike = (right > 0) & _differ([group, right], docs)
    every_window = repeated[group] & _differ([group], docs)
    place, size = rows["place"][kinds].astype(np.int64), rows["n"][kinds].astype(np.int64)
    # Of the windows, those too short on the side that differs to reach beyond what is common.
    low = np.where(left_alike | every_window, 0, np.maximum(0, place - SIDE + 1))
    high = np.where(right_alike | every_window, size, np.minimum(size, place + GRAM + SIDE - LENGTH))
    wanted = (left_alike | right_alike | every_window) & (high > low)
    kind = np.cumsum(begins) - 1
    detail = wanted[kind] & ~covered
    narrowed = rows | {"at": rows["at"] + low[kind], "n": (high - low)[kind]}
    return _spans((rows, covered, "", False), (narrowed, detail, "", True), (done, every, "done_", False))


def _differ(keys: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Whether rows with the same ``keys`` have different ``values``."""
    order = np.lexsort((values, *reversed(keys)))
    begins = np.ones(len(order), bool)
    begins[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    starts = np.flatnonzero(begins)
    last = np.append(starts[1:], len(order)) - 1
    differ = values[order][starts] != values[order][last]
    out = np.zeros(len(order), bool)
    out[order] = differ[np.cumsum(begins) - 1]
    return out


WINDOWS = {"h": pa.int64(), "h2": pa.int32(), "doc": pa.int64(), "variant": pa.int16(), "at": pa.int32(),
           "n": pa.int32()}


def _decide_windows(table: pa.Table) -> pa.Table:
    """Windows of one bucket that start in a smaller document as well."""
    rows, done = _flat(table, list(WINDOWS)), _flat(table, list(DONE))
    order = np.lexsort((rows["doc"], rows["h2"], rows["h"]))
    rows = {k: v[order] for k, v in rows.items()}
    every = np.ones(len(done["done_doc"]), bool)
    covered = np.zeros(len(order), bool)
    if len(order):
        first, _ = _firsts(rows, ["h", "h2"])
        covered = rows["doc"] > rows["doc"][first]
    return _spans((rows, covered, "", False), (done, every, "done_", False))


def _collected(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The columns of all ``parts``, which are emptied on the way."""
    return {k: np.concatenate([p.pop(k) for p in parts]) for k in list(parts[0])}


def _send_phrases(buckets: int):
    """Task that parses documents (doc, variant, text) and deals their phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count, pieces, size = [], 0, [], 0

        def parse() -> dict[str, np.ndarray]:
            found = phrases([p[3] for p in pieces], [p[4] for p in pieces])
            which = found.pop("piece")
            for k, i, kind in (("doc", 0, np.int64), ("variant", 1, np.int16), ("low", 2, np.int64)):
                found[k] = np.array([p[i] for p in pieces], kind)[which]
            found["at"] = (found["at"] + found.pop("low")).astype(np.int32)
            return found | {"n": found["n"].astype(np.int32)}

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for doc, variant, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                for low, data, own in _pieces(text.as_py()):
                    pieces.append((doc, variant, low, data, own))
                    size += len(data)
                    if size >= CHUNK:
                        parts.append(parse())
                        count += len(parts[-1]["g"])
                        pieces, size = [], 0
                    if count >= FLUSH:
                        yield from _dealt(_collected(parts), ["g", "e"], buckets, FIELDS)
                        parts, count = [], 0
        if pieces:
            parts.append(parse())
        if parts:
            yield from _dealt(_collected(parts), ["g", "e"], buckets, FIELDS)

    return run


def _send_windows(buckets: int):
    """Task that deals the windows of (doc, variant, text, marks) that are to be looked at."""

    def hashed(pieces: list[tuple[int, int, int, bytes]]) -> dict[str, np.ndarray]:
        data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        sizes = np.array([len(p[3]) for p in pieces])
        base = np.cumsum(sizes) - sizes
        counts = sizes - LENGTH + 1
        which = np.repeat(np.arange(len(pieces)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = base[which] + inside
        second = Hashes(data, _BASE_2, _BYTES_2).of(start, start + LENGTH, 5)
        column = lambda i, kind: np.array([p[i] for p in pieces], kind)[which]
        return {
            "h": Hashes(data).of(start, start + LENGTH, 4).view(np.int64),
            "h2": (second >> np.uint64(32)).astype(np.uint32).view(np.int32),
            "doc": column(0, np.int64), "variant": column(1, np.int16),
            "at": (column(2, np.int64) + inside).astype(np.int32),
            "n": np.ones(len(which), np.int32),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for doc, variant, text, (ats, ns) in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, _ranges(batch.column(3))
            ):
                data = text.as_py()
                for start, count in zip(ats.tolist(), ns.tolist()):
                    for at in range(start, start + count, CHUNK):
                        n = min(CHUNK, start + count - at)
                        pieces.append((doc, variant, at, data[at : at + n + LENGTH - 1]))
                        size += n
                        if size >= CHUNK:
                            yield from _dealt(hashed(pieces), ["h", "h2"], buckets, WINDOWS)
                            pieces, size = [], 0
        if pieces:
            yield from _dealt(hashed(pieces), ["h", "h2"], buckets, WINDOWS)

    return run


def _ranges(marks: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(at, n) of the marks of each row, in no order."""
    bounds = marks.offsets.to_numpy()
    at, n = (marks.values.field(k).to_numpy().astype(np.int64) for k in ("at", "n"))
    for low, high in zip(bounds, bounds[1:]):
        yield at[low:high], n[low:high]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the marked windows of (doc_id, text, marks)."""
    for batch in batches:
        rows = []
        for text, (at, n) in zip(batch.column(1).cast(pa.binary()), _ranges(batch.column(2))):
            data, kept = text.as_py(), hashlib.sha256()
            order = np.argsort(at)
            start, reach = at[order], np.maximum.accumulate((at + n)[order] + LENGTH - 1)
            # A run of removed bytes ends where the next mark starts behind all before it.
            first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            starts, ends = start[first], reach[np.append(first[1:], len(start)) - 1]
            end = 0
            for a, b in zip(starts.tolist(), ends.tolist()):
                kept.update(data[end:a])
                end = b
            kept.update(data[end:])
            rows.append((len(data), int((ends - starts).sum()), len(starts), kept.hexdigest()))
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _marks(spans: DataFrame, name: str) -> DataFrame:
    """(m_doc, m_variant, marks) of each document, written; marks are bounded by its length."""
    marks = spans.groupBy(F.col("doc").alias("m_doc"), F.col("variant").alias("m_variant")).agg(
        F.collect_list(F.struct("at", "n")).alias("marks")
    )
    return materialize(marks, name)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Cut every byte that a 50-byte string covers which also starts in a smaller document.

    Args:
        docs: ``doc_id`` long, ``text``; other columns are not read.

    Returns:
        doc_id, n_bytes, n_removed, n_spans long, kept_sha256 string. One row per input row. Null
        is the empty text. A null doc_id counts as larger than all others. Rows that share an id
        do not cut each other. Texts below 50 bytes stay whole.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc"),
    )
    digests = materialize(rows.select("doc", F.sha2("text", 256).alias("digest")), "text-digests")
    rows = _with_variants(rows, digests)
    copied = (
        digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .where("first < last").select(F.col("digest").alias("copied"), "first")
    )
    # Written first: both sides of the join are then plain exchanges, which Spark can split.
    copied = materialize(copied, "copied-texts")
    copies = digests.join(copied, F.col("digest") == F.col("copied")).where("doc > first")
    copies = materialize(copies.select(F.col("doc").alias("c_doc"), F.col("digest").alias("c_digest")).distinct(), "copies")
    # A whole copy of a smaller document needs no parsing.
    whole = small_side(copies, 100_000)
    own_digest = F.sha2("text", 256)
    is_copy = (F.col("doc") == F.col("c_doc")) & (own_digest == F.col("c_digest"))
    long = F.octet_length("text") >= LENGTH
    firsts = rows.where(long).join(whole, is_copy, "left_anti")

    buckets = BUCKETS * partitions_of(docs)
    sent = firsts.select("doc", "variant", "text").mapInArrow(_send_phrases(buckets), _lists(FIELDS))
    spans = materialize(sent.groupBy("bucket").applyInArrow(_decide_phrases, SPANS_SQL), "phrase-spans")

    wanted = _marks(spans.where("detail"), "phrases-by-window")
    asked = _meet(firsts, wanted).select("doc", "variant", "text", "marks")
    windows = asked.mapInArrow(_send_windows(buckets), _lists(WINDOWS))
    more = windows.groupBy("bucket").applyInArrow(_decide_windows, SPANS_SQL)
    covered = _marks(spans.where("not detail").unionByName(more), "covered-windows")

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    cut = _meet(firsts, covered).select("doc_id", "text", "marks").mapInArrow(_cut, schema)
    ids = small_side(materialize(covered.select("m_doc", "m_variant"), "covered-ids"))
    n_bytes = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("bigint")

    def untouched(df: DataFrame) -> DataFrame:
        return df.select("doc_id", n_bytes.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                         own_digest.alias("kept_sha256"))

    same = (F.col("doc") == F.col("m_doc")) & (F.col("variant") == F.col("m_variant"))
    removed = rows.where(long).join(whole, is_copy, "left_semi").select(
        "doc_id", n_bytes.alias("n_bytes"), n_bytes.alias("n_removed"),
        F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"),
    )
    return (
        cut.unionByName(untouched(firsts.join(ids, same, "left_anti")))
        .unionByName(untouched(rows.where(~long)))
        .unionByName(removed)
    )


def _meet(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` that have marks, with them. If few documents have any, only their texts move."""
    ids = small_side(materialize(marks.select(F.col("m_doc").alias("i_doc"), F.col("m_variant").alias("i_variant")), "ids"))
    some = rows.join(ids, (F.col("doc") == F.col("i_doc")) & (F.col("variant") == F.col("i_variant")), "left_semi")
    return some.join(marks, (F.col("doc") == F.col("m_doc")) & (F.col("variant") == F.col("m_variant")))


def _with_variants(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` with ``variant``, which tells apart different texts of one id; 0 for nearly all."""
    mixed = digests.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    mixed = materialize(mixed.select("doc"), "ids-with-texts")
    none = F.lit(0).cast("smallint")
    if mixed.isEmpty():
        return rows.withColumn("variant", none)
    different = digests.distinct().join(mixed, "doc", "left_semi")
    places = different.groupBy("doc").agg(F.array_sort(F.collect_list("digest")).alias("texts"))
    places = places.select(F.col("doc").alias("v_doc"), F.posexplode("texts").alias("place", "v_digest"))
    places = materialize(places, "text-variants")
    same = (F.col("doc") == F.col("v_doc")) & (F.sha2("text", 256) == F.col("v_digest"))
    return rows.join(places, same, "left").select(
        "doc_id", "text", "doc", F.coalesce(F.col("place").cast("smallint"), none).alias("variant")
    )
