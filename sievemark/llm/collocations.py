"""Collocations: phrases of two or three words that stand together more often than their parts.

Counts of words and phrases are streams, laid out twice: sorted from the first word on (prefix
order) and from the last word on (suffix order). In prefix order a phrase comes after its own
beginnings and before its continuations, so one pass in step over the sorted counts gives the count
of every left part and the most frequent continuation; the pass in suffix order gives right parts
and what may stand before. Both results are merge-joined in phrase order. No table of counts is
looked up by hash.

Sorted streams are cut into ranges by whole phrases, so a word that begins very many phrases is not
one task: the beginnings of a range's first phrase are sent to it as guests, at most two rows a range.

Texts are read twice. The first time words, and pairs of words by a 64-bit hash, are counted; the
second time only phrases all of whose pairs may be frequent. What may be frequent is a bit map of
fixed size: when it fills up, more rows are counted and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import in_ranges, small_side
from sievemark.session import materialize

LEAST_COUNT = 10
# A phrase goes if a longer one has this share of its count, in percent.
WITHIN_PERCENT = 50
TOP = 2_000
SCALE = 1_000_000

# Words that a task counts at once.
CHUNK_WORDS = 1_000_000
# Bits of the map of pairs that may be frequent; 16 MB.
MAP_BITS = 27
BATCH_ROWS = 50_000

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TO_DOT = bytes.maketrans(SEPARATORS, b"." * len(SEPARATORS))
BREAK = b"."
WORDS = ["w1", "w2", "w3"]
KEY = ["lang", *WORDS]


class _Ids(dict):
    """Numbers of the words of one language; 0 is the break between pieces."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str], hashes: list[int]) -> None:
        super().__init__({BREAK: 0})
        self.lang, self.words, self.langs, self.hashes = lang, words, langs, hashes
        self.seed = xxhash.xxh64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number


class Chunk:
    """Words of many texts as one array of numbers, with breaks where no phrase may cross."""

    def __init__(self) -> None:
        self.words, self.langs, self.hashes = [BREAK], [""], [0]
        self.by_lang: dict[str, _Ids] = {}
        self.runs, self.n = [], 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.by_lang:
            self.by_lang[lang] = _Ids(lang, self.words, self.langs, self.hashes)
        # bytes.lower() changes A-Z alone; split() parts at blanks and tabs, the rest are dots now.
        found = text.lower().translate(_TO_DOT).replace(BREAK, b" . ").split()
        found.append(BREAK)
        number = self.by_lang[lang].__getitem__
        self.runs.append(np.fromiter(map(number, found), np.int64, len(found)))
        self.n += len(found)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers in order, the hash of every number, and the hash of the pair at each place."""
        ids = np.concatenate([*self.runs, [0, 0]])
        hashes = np.array(self.hashes, np.uint64)
        return ids, hashes, pair_hash(hashes[ids[:-1]], hashes[ids[1:]])

    def strings(self, numbers: np.ndarray) -> pa.Array:
        return pa.array(self.words, pa.binary()).take(pa.array(numbers)).cast(pa.string())

    def languages(self, numbers: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.string()).take(pa.array(numbers))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair from the hashes of its words; the order counts."""
    return left ^ ((right << np.uint64(29)) | (right >> np.uint64(35)))


def _in_chunks(batches: Iterator[pa.RecordBatch], count: Callable[[Chunk], pa.Table]) -> Iterator[pa.RecordBatch]:
    chunk = Chunk()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            chunk.add(lang.as_py(), text.as_py())
            if chunk.n >= CHUNK_WORDS:
                yield from count(chunk).to_batches(BATCH_ROWS)
                chunk = Chunk()
    if chunk.n:
        yield from count(chunk).to_batches(BATCH_ROWS)


def _words_and_pairs(chunk: Chunk) -> pa.Table:
    """(lang, word, pair, f): counts of words, and of pairs by their hash."""
    ids, hashes, _ = chunk.arrays()
    left, right = ids[:-1], ids[1:]
    both = (left > 0) & (right > 0)
    pairs, f = np.unique((left[both] << 32) | right[both], return_counts=True)
    known = np.arange(1, len(hashes))
    counts = np.bincount(ids, minlength=len(hashes))[1:]
    at = pair_hash(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]).view(np.int64)
    no_words, no_pairs = pa.nulls(len(pairs), pa.string()), pa.nulls(len(known), pa.int64())
    return pa.table(
        {
            "lang": pa.chunked_array([chunk.languages(known), no_words]),
            "word": pa.chunked_array([chunk.strings(known), no_words]),
            "pair": pa.chunked_array([no_pairs, pa.array(at)]),
            "f": pa.array(np.concatenate([counts, f])),
        }
    )


def _phrases(chunk: Chunk, frequent: np.ndarray) -> pa.Table:
    """(lang, w1, w2, w3, f): counts of phrases whose pairs are all marked in ``frequent``; w3 is
    empty in pairs."""
    ids, _, hashes = chunk.arrays()
    at = (hashes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    marked = (frequent[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    pair = (ids[:-1] > 0) & (ids[1:] > 0) & (marked == 1)
    packed = (ids[:-1] << 32) | ids[1:]
    pairs, f2 = np.unique(packed[pair], return_counts=True)
    triple = np.flatnonzero(pair[:-1] & pair[1:])
    starts = np.searchsorted(pairs, packed[triple])
    triples, f3 = np.unique((starts << 32) | ids[triple + 2], return_counts=True)
    all_pairs = np.concatenate([pairs, pairs[triples >> 32]])
    first, second = all_pairs >> 32, all_pairs & 0xFFFFFFFF
    return pa.table(
        {
            "lang": chunk.languages(first),
            "w1": chunk.strings(first),
            "w2": chunk.strings(second),
            "w3": pa.chunked_array([pa.array([""] * len(pairs), pa.string()), chunk.strings(triples & 0xFFFFFFFF)]),
            "f": pa.array(np.concatenate([f2, f3])),
        }
    )


def _bit_map(pairs: DataFrame) -> np.ndarray:
    """The hashes in column ``pair`` as a map of 2^MAP_BITS bits."""
    at = F.col("pair").bitwiseAND((1 << MAP_BITS) - 1) + 1  # Spark's bit maps count from 1
    parts = pairs.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        bits = np.frombuffer(row.bits, np.uint8)
        start = (row.part - 1) * 4096
        out[start : start + 4096] = bits[: len(out) - start]
    return out


def counts(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, f) of all words and phrases of up to three words that occur ``least``
    times, empty where there is no word, and (lang, n) with the number of all words."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("string").cast("binary").alias("text"),
    ).where(F.col("text").isNotNull())
    first = texts.mapInArrow(
        lambda batches: _in_chunks(batches, _words_and_pairs),
        "lang string, word string, pair bigint, f bigint",
    )
    counted = first.groupBy("lang", "word", "pair").agg(F.sum("f").alias("f"))
    counted = materialize(counted.where(F.col("word").isNotNull() | (F.col("f") >= least)), "counted")
    sizes = counted.where(F.col("word").isNotNull()).groupBy("lang").agg(F.sum("f").alias("n"))

    frequent = docs.sparkSession.sparkContext.broadcast(_bit_map(counted.where(F.col("pair").isNotNull())))
    second = texts.mapInArrow(
        lambda batches: _in_chunks(batches, lambda chunk: _phrases(chunk, frequent.value)),
        "lang string, w1 string, w2 string, w3 string, f bigint",
    )
    phrases = second.groupBy(*KEY).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    none = F.lit("")
    words = counted.where(F.col("word").isNotNull() & (F.col("f") >= least)).select(
        "lang", F.col("word").alias("w1"), none.alias("w2"), none.alias("w3"), "f"
    )
    return materialize(words.unionByName(phrases), "streams"), materialize(sizes, "sizes")


def _in_step(stream: DataFrame, name: str) -> DataFrame:
    """One pass over the counts in the order of w1, w2, w3.

    Returns the phrases with ``first`` and ``second``, the counts of their first word and of their
    first two, and ``longer``, the highest count of a phrase that goes on after them. A phrase may
    come more than once; the largest values count."""
    placed = in_ranges(stream, KEY, name)
    # One row per range.
    starts = placed.where(F.col("place") == 0).select(
        F.col("run").alias("to"), F.col("lang").alias("low"), *[F.col(w).alias(f"low_{w}") for w in WORDS[:2]]
    )
    begins = (F.col("lang") == F.col("low")) & (F.col("w1") == F.col("low_w1")) & (F.col("w3") == "")
    begins &= (F.col("w2") == "") | (F.col("w2") == F.col("low_w2"))
    guests = placed.join(F.broadcast(starts), begins & (F.col("run") < F.col("to")))
    rows = placed.select(*KEY, "f", "run").unionByName(guests.select(*KEY, "f", F.col("to").alias("run")))
    upto = Window.partitionBy("run").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("run", "lang", "w1", "w2")
    word, pair = F.col("w2") == "", (F.col("w2") != "") & (F.col("w3") == "")
    passed = rows.select(
        *KEY,
        "f",
        F.last(F.when(word, F.col("f")), ignorenulls=True).over(upto).alias("first"),
        F.last(F.when(pair, F.col("f")), ignorenulls=True).over(upto).alias("second"),
        F.when(pair, F.max(F.when(F.col("w3") != "", F.col("f"))).over(same)).alias("longer"),
    )
    return passed.where(F.col("w2") != "")


def _largest(passed: DataFrame, prefix: str) -> DataFrame:
    values = ["f", "first", "second", "longer"]
    return passed.groupBy(*KEY).agg(*[F.max(c).alias(f"{prefix}_{c}") for c in values])


def _score(left: str, right: str) -> F.Column:
    """Exact in 38 digits, which counts up to 10^16 stay within."""
    a, b, c = (f"CAST({x} AS DECIMAL(38,0))" for x in ("a", left, right))
    return F.expr(f"CAST({SCALE} AS DECIMAL(38,0)) * {a} * {a} div ({b} * {c})")


def candidates(streams: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, longer) of every phrase of two or three words."""
    turned = F.when(F.col("w3") != "", F.array("w3", "w2", "w1")).when(
        F.col("w2") != "", F.array("w2", "w1", F.lit(""))
    )
    turned = F.coalesce(turned, F.array(*WORDS))
    back = lambda df: df.withColumn("turned", turned).select(
        *[c for c in df.columns if c not in WORDS], *[F.col("turned")[i].alias(w) for i, w in enumerate(WORDS)]
    )
    before = _largest(_in_step(streams, "prefix-order"), "p")
    after = _largest(back(_in_step(back(streams), "suffix-order")), "s")
    both = before.hint("merge").join(after.hint("merge"), KEY).withColumn("a", F.col("p_f"))
    three = F.col("w3") != ""
    both = both.withColumn("right", F.when(three, F.col("s_second")).otherwise(F.col("s_first")))
    both = both.withColumn("score", _score("p_first", "right"))
    both = both.withColumn("other", F.when(three, _score("p_second", "s_first")))
    later = F.coalesce(F.col("other") < F.col("score"), F.lit(False))
    return both.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", F.expr("nullif(w3, '')")).alias("phrase"),
        "a",
        F.when(later, F.col("p_second")).otherwise(F.col("p_first")).alias("l"),
        F.when(later, F.col("s_first")).otherwise(F.col("right")).alias("r"),
        F.when(later, F.col("other")).otherwise(F.col("score")).alias("score"),
        F.greatest("p_longer", "s_longer").alias("longer"),
    )


def _top(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of every language with their ``rank``.

    A histogram of scores with at most 1000 steps tells which step holds the last one; only rows
    from there up are ranked, first in 64 parts of a language, then together."""
    step = F.floor(F.log2(F.col("score") + 1) * 50)
    counted = found.groupBy("lang", step.alias("step")).agg(F.count("*").alias("rows"))
    higher = Window.partitionBy("lang").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("above", F.coalesce(F.sum("rows").over(higher), F.lit(0)))
    last = counted.where(F.col("above") < top).groupBy("lang").agg(F.min("step").alias("last"))
    kept = found.join(small_side(materialize(last, "last-steps")), "lang").where(step >= F.col("last")).drop("last")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    for group in (["lang", part], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
        kept = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return kept


def collocations(
    docs: DataFrame, *, least: int = LEAST_COUNT, within_percent: int = WITHIN_PERCENT, top: int = TOP
) -> DataFrame:
    """The best phrases of every language.

    Args:
        docs: ``lang``, ``text``; other columns are not read.
        least: occurrences that a phrase needs.
        within_percent: a phrase goes if a longer one around it has this share of its count.
        top: phrases to report per language.

    Returns:
        lang, rank (from 1), phrase, a, l, r, n, score; numbers long. Null languages are ``und``;
        null and empty texts have no words; repeated rows count every time; texts of any length are
        read whole; an empty table gives an empty result. Ties go to the larger count, then to the
        phrase that is first in the order of its UTF-8 bytes.
    """
    streams, sizes = counts(docs, least)
    found = materialize(candidates(streams), "candidates")
    gone = F.col("longer") * 100 >= F.col("a") * within_percent
    best = _top(found.where(~F.coalesce(gone, F.lit(False))), top)
    return best.join(small_side(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
