"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is cut into shards of a few hundred documents, every shard into blocks of equally
many words in a seeded document order. Blocks are seats: the seats of the whole mix go to sources,
and those of a source to its shards, by the highest quotients target / (2 seats + 1). A shard
takes all its blocks as often as its quota allows and the rest from a seeded choice of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.names import unused
from sievemark.llm.common import small_side, text_or_empty
from sievemark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
SHARD_DOCS = 256
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 42
# A prime above every block count, so that multiples of it visit each block of a shard once.
STRIDE = 2_147_483_647


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, its place by code point from 0, null last.

    Range partitions are numbered inside; only their sizes reach the driver."""
    order = F.col("source").asc_nulls_last()
    placed = sources.repartitionByRange(8, order).sortWithinPartitions(order)
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    sizes = {r.part: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    first, offset = [], 0
    for k in sorted(sizes):
        first += [F.lit(k).cast("bigint"), F.lit(offset).cast("bigint")]
        offset += sizes[k]
    before = F.create_map(*first)[part] if first else F.lit(0).cast("bigint")
    return placed.withColumn("rank", before + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place")


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target`` double.

    The sum of all sizes is shared by weight. Sources above ``most`` times their size stop there
    and the rest is shared again. Each round reads one row of sums; targets of the others only
    grow, so a round that stops no further source is the last."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = materialize(_ranked(sources).withColumn("weight", weight), "weighted-sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, stopped = 0.0, -1
    while True:
        full = (F.col("source_size") * most) <= F.col("weight") * share
        sums = rows.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if not sums["open"] or sums["n"] == stopped:
            break
        stopped, share = sums["n"], (total - sums["held"]) / sums["open"]
    limit = (F.col("source_size") * most).cast("double")
    return rows.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(share))))


def apportion(parties: DataFrame, group: list[str], party: list[str]) -> DataFrame:
    """``parties`` (group, party, weight double, most long, seats long) with ``quota`` long.

    ``seats`` are the seats of the whole group. They go one by one to the highest quotient
    weight / (2 quota + 1); no party gets more than ``most``, which must not be below its share
    of the seats. Almost all seats follow from the divisor that shares them on average, so only
    a few quotients per party are ranked.
    """
    whole = Window.partitionBy(*group)
    n = F.count("*").over(whole)
    sized = parties.withColumn("n", n).withColumn("sum", F.sum("weight").over(whole))
    per = F.when(F.col("sum") > 0, F.col("weight") / F.col("sum")).otherwise(0.0)
    low = F.ceil(per * (F.col("seats") - F.col("n") / 2) - 1.5)
    high = F.floor(per * (F.col("seats") + 2 * F.col("n"))) + 2
    sized = sized.withColumn("low", F.least(F.greatest(low, F.lit(0)), F.col("most"))).withColumn(
        "high", F.least(high, F.col("most"))
    )
    left = F.col("seats") - F.sum("low").over(whole)
    sized = materialize(sized.withColumn("left", left), "parties")
    asked = (
        sized.where("high > low and weight > 0")
        .select(*group, *party, "weight", "left", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
        .withColumn("quotient", F.col("weight") / (2 * F.col("k") + 1))
    )
    by_quotient = Window.partitionBy(*group).orderBy(F.col("quotient").desc(), *party)
    won = (
        asked.withColumn("place", F.row_number().over(by_quotient))
        .where("place <= left")
        .groupBy(*group, *party)
        .agg(F.count("*").alias("won"))
    )
    keys = group + party
    won = won.select(*[F.col(k).alias(f"won_{k}") for k in keys], "won")
    same = [F.col(k).eqNullSafe(F.col(f"won_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    quota = F.col("low") + F.coalesce("won", F.lit(0))
    return sized.join(won, on, "left").select(*[sized[c] for c in parties.columns], quota.alias("quota"))


def _taken(block: int) -> Column:
    """Words of the document at ``start`` that the quota of its shard takes."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    rest = F.col("quota") % F.col("blocks")

    def add(words: Column, b: Column) -> Column:
        chosen = (b * STRIDE + F.col("turn")) % F.col("blocks") < rest
        inside = F.least(end, (b + 1) * block) - F.greatest(start, b * block)
        return words + F.when(chosen, inside).otherwise(F.lit(0).cast("bigint"))

    last = F.floor((end - 1) / block)
    some = F.aggregate(F.sequence(F.floor(start / block), last), F.lit(0).cast("bigint"), add)
    whole = F.floor(F.col("quota") / F.col("blocks")) * F.col("size")
    return F.when(F.col("size") > 0, whole + some).otherwise(F.lit(0).cast("bigint"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """Words that a mix of all sources takes from every document.

    Args:
        docs: ``doc_id``, ``source``, ``text``; other columns are not read.
        weights: of the sources by code point, null last, repeating.
        block_words: words of a block, the unit of all quotas.
        shard_docs: documents of a shard on average.

    Returns:
        doc_id, size, source_size long, target double, taken long, source. One row per input row.
        Null and empty texts have size 0 and nothing is taken from them. Rows that repeat an id
        are documents of their own. An empty table gives no rows. Reruns agree.
    """
    sizes = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
    )
    sizes = materialize(sizes, "document-sizes")
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    sources = materialize(source_targets(totals, weights), "source-targets")

    turn = F.xxhash64(F.lit(seed), F.col("doc_id"))
    shard = F.pmod(turn, F.ceil(F.col("n_docs") / shard_docs))
    info = sources.select(F.col("source").alias("of"), "source_size", "target", "n_docs")
    placed = sizes.join(small_side(info), F.col("source").eqNullSafe(F.col("of")))
    placed = placed.select("doc_id", "source", "size", shard.alias("shard"))
    inside = Window.partitionBy("source", "shard").orderBy(
        F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "size"
    )
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("start", F.sum("size").over(until) - F.col("size"))
    placed = materialize(placed, "placed-documents")

    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / block_words))
    shards = materialize(shards.where("blocks > 0"), "shards")
    # The last block of a shard is short, so words are turned into seats by the source's own mean.
    room = shards.groupBy(F.col("source").alias("of")).agg(F.sum("blocks").alias("blocks"))
    parties = room.join(sources, F.col("of").eqNullSafe(F.col("source"))).select(
        F.lit(0).alias("mix"), "source",
        (F.col("target") * F.col("blocks") / F.col("source_size")).alias("weight"),
        (F.col("blocks") * MOST_REPEATS).alias("most"),
    )
    parties = materialize(parties, "source-parties")
    seats = max(1, round(parties.agg(F.sum("weight")).first()[0] or 0))
    parties = parties.withColumn("seats", F.lit(seats).cast("bigint"))
    of_source = apportion(parties, ["mix"], ["source"]).select(
        F.col("source").alias("of"), F.col("quota").alias("seats")
    )
    parts = (
        shards.join(small_side(materialize(of_source, "source-quotas")), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("weight", F.col("blocks").cast("double"))
        .withColumn("most", F.col("blocks") * MOST_REPEATS)
        .select("source", "shard", "blocks", "weight", "most", "seats")
    )
    quotas = apportion(parts, ["source"], ["shard"]).select(
        F.col("source").alias("of_source"), F.col("shard").alias("of_shard"), "blocks", "quota",
        F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), F.col("blocks")).alias("turn"),
    )
    quotas = small_side(materialize(quotas, "shard-quotas"))
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard"))
    return (
        placed.join(quotas, same, "left")
        .select("doc_id", "source", "size", F.coalesce(_taken(block_words), F.lit(0)).alias("taken"))
        .join(small_side(info.drop("n_docs")), F.col("source").eqNullSafe(F.col("of")))
        .select("doc_id", "size", "source_size", "target", "taken", "source")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes words from, with size, source_size, target, taken.

    Rows that repeat an id are kept if the mix takes words from one of them, with its largest
    numbers; a document without id goes the same way. Texts that are null or empty go, as nothing
    is taken from them. Columns of any name stay: where one of the four is in use, ``mix_`` and if
    need be ``_`` tell the new one apart. An empty table stays empty.
    """
    numbers = ["size", "source_size", "target", "taken"]
    used = {c.lower() for c in docs.columns}
    new = unused(docs.columns, *[f"mix_{c}" if c in used else c for c in numbers], "mix_id")
    found = mix(docs).groupBy("doc_id").agg(*[F.max(c).alias(n) for c, n in zip(numbers, new)])
    found = found.where(F.col(new[3]) > 0).withColumnRenamed("doc_id", new[4])
    found = small_side(materialize(found, "mix"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(new[4]))).drop(new[4])
