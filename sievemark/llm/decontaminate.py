"""Benchmark decontamination by spaced seeds: substitution-tolerant overlaps of token windows.

A seed is a fixed mask laid over consecutive tokens; the positions under a 0 do not count, so a
replaced token there does not hide the overlap. Seeds of all documents meet those of the benchmark
in one hash join. Around every hit the two texts are laid on each other and windows compared token
by token, so a hash collision never reports anything.

Everything is built-in Spark expressions. Documents stay where they are: the benchmark's seeds are
broadcast after their number has been checked, otherwise seeds are shuffled by their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import unused
from sievemark.llm.common import small_side, text_digest, text_or_empty
from sievemark.session import materialize

# Every way to replace 2 of 13 tokens leaves one of these masks untouched at some even offset, and
# at some odd one, so documents are sampled at every second place.
MASKS = ("11100011", "11010011")
STEP = 2
WINDOW = 13
LEAST_EQUAL = 11
LEAST_TOKENS = 5


def tokens(name: str = "text") -> Column:
    """Lower-case runs of letters and digits; none for null or empty text."""
    return F.regexp_extract_all(F.lower(text_or_empty(name)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def seed_hash(number: int, mask: str) -> Column:
    """Hash of the tokens that ``mask`` keeps, laid at ``start``; null where it does not fit."""
    start = F.col("start")
    kept = [F.get(F.col("token_hashes"), start + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(start <= F.size("token_hashes") - len(mask), F.xxhash64(F.lit(number), *kept))


def _seeds(df: DataFrame, masks: list[str], *keep: str, step: int = 1) -> DataFrame:
    """(keep, mask number, start, hash) of every mask at every ``step``-th place.

    One row per place inside one stage of generated code, so the array is not copied."""
    at = F.sequence(F.lit(0), F.size("token_hashes") - 1, F.lit(step))
    places = df.where(F.size("token_hashes") > 0).select(
        *keep, "token_hashes", F.explode(at).alias("start")
    )
    each = F.array(*[seed_hash(i, m) for i, m in enumerate(masks)])
    rows = places.select(*keep, "start", F.posexplode(each).alias("mask", "seed"))
    return rows.where(F.col("seed").isNotNull())


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    least_equal: int = LEAST_EQUAL,
    masks: tuple[str, ...] = MASKS,
    step: int = STEP,
    least_tokens: int = LEAST_TOKENS,
) -> DataFrame:
    """Documents that contain a passage of a benchmark item.

    Args:
        docs: ``doc_id``, ``text``; other columns are not read.
        benchmark: ``item_id``, ``text``.
        window, least_equal: a passage counts if ``least_equal`` of ``window`` consecutive tokens
            agree at the same distance. With the default masks and step no such window is missed.
        masks, step: of the seeds; documents are read at every ``step``-th token, items at each.
        least_tokens: items below ``window`` tokens must occur whole and unchanged; those below
            this number are too common to prove anything and are never reported.

    Returns:
        doc_id, item_id, best_equal int (most equal tokens in a window), first_token and
        last_token long (of the matching windows in the document). Null or empty texts match
        nothing. Repeated rows change nothing; rows that share an id (null included) are reported
        together.
    """
    items = (
        benchmark.select("item_id", tokens().alias("item_tokens"))
        .where(F.size("item_tokens") >= least_tokens)
        .distinct()
    )
    items = materialize(items, "benchmark-items")
    lengths = items.where(F.size("item_tokens") < window).select(F.size("item_tokens")).distinct()
    # At most window - least_tokens different lengths.
    whole = ["1" * r[0] for r in lengths.collect()]

    text_hashes = F.transform(tokens(), lambda t: F.xxhash64(t)).alias("token_hashes")
    item_hashes = F.transform("item_tokens", lambda t: F.xxhash64(t)).alias("token_hashes")
    doc_tokens = docs.select("doc_id", text_hashes)
    long_items = items.where(F.size("item_tokens") >= window).select("item_id", item_hashes)
    hits = _hits(_seeds(doc_tokens, list(masks), "doc_id", step=step), _seeds(long_items, list(masks), "item_id"))
    if whole:
        short_items = items.where(F.size("item_tokens") < window).select("item_id", item_hashes)
        full = F.length(F.element_at(F.array(*map(F.lit, whole)), F.col("mask") + 1))
        short_seeds = _seeds(short_items, whole, "item_id", "token_hashes")
        short_seeds = short_seeds.where(full == F.size("token_hashes")).drop("token_hashes")
        hits = hits.unionByName(_hits(_seeds(doc_tokens, whole, "doc_id"), short_seeds)).distinct()
    hits = small_side(materialize(hits, "seed-hits"))
    return _verified(docs, items, hits, window, least_equal)


def _hits(doc_seeds: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """Documents and items with a common seed, and how far the item is shifted."""
    item_seeds = item_seeds.select("seed", "item_id", F.col("start").alias("item_start"))
    item_seeds = small_side(materialize(item_seeds, "benchmark-seeds"))
    return (
        doc_seeds.join(item_seeds, "seed")
        .select("doc_id", "item_id", (F.col("start") - F.col("item_start")).alias("shift"))
        .distinct()
    )


def _verified(
    docs: DataFrame, items: DataFrame, hits: DataFrame, window: int, least_equal: int
) -> DataFrame:
    """Lay document and item on each other at every shift and count equal tokens per window."""
    pairs = (
        docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text"))
        .join(hits, F.col("id").eqNullSafe(F.col("doc_id")))
        .select("doc_id", "item_id", "shift", "text")
        .withColumnRenamed("item_id", "hit_item")
        .join(items, F.col("hit_item").eqNullSafe(F.col("item_id")))
        .select("doc_id", "item_id", "shift", "item_tokens", tokens().alias("doc_tokens"))
    )
    n = F.size("item_tokens")
    first = F.greatest(F.col("shift"), F.lit(0))
    before = first - F.col("shift")  # item tokens in front of the document
    equal = F.zip_with(
        F.slice("doc_tokens", first + 1, F.greatest(n - before, F.lit(0))),
        F.slice("item_tokens", before + 1, F.greatest(n - before, F.lit(0))),
        lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)),
    )
    length = F.least(F.lit(window), n)
    # One row per window. The explode keeps the arrays from being computed again for each.
    rows = pairs.select(
        "doc_id", "item_id", "shift", length.alias("length"),
        F.concat(F.array_repeat(F.lit(0), before), equal).alias("equal"),
        F.sequence(F.lit(0), n - length).alias("starts"),
    ).select("doc_id", "item_id", "shift", "length", "equal", F.explode("starts").alias("start"))
    inside = F.slice("equal", F.col("start") + 1, F.col("length"))
    rows = rows.withColumn("n_equal", F.aggregate(inside, F.lit(0), lambda a, b: a + b))
    need = F.when(F.col("length") < window, F.col("length")).otherwise(least_equal)
    place = (F.col("start") + F.col("shift")).cast("long")
    return (
        rows.where(F.col("n_equal") >= need)
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("n_equal").alias("best_equal"),
            F.min(F.greatest(place, F.lit(0))).alias("first_token"),
            F.max(place + F.col("length") - 1).alias("last_token"),
        )
    )


def reject(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without rows that hold a benchmark passage. Rows are told apart by their text, so
    repeated rows go or stay together; null and empty texts hold none, very long ones are searched
    whole. Columns of any name stay; an empty table on either side removes nothing."""
    (gone,) = unused(docs.columns, "gone")
    texts = docs.select(text_digest().alias("doc_id"), "text")
    found = overlaps(texts, benchmark).select(F.col("doc_id").alias(gone)).distinct()
    found = small_side(materialize(found, "leaked-texts"))
    return docs.join(found, text_digest() == F.col(gone), "left_anti")
