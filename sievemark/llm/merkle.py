"""Merkle manifest: hash trees over the rows of each group and over the groups.

Every row is a leaf. In a tree, 16 consecutive nodes become the hash of their digests until one is
left; a last run may be shorter. The rank of a node, written in digits of base 16, is its path from
the root. Three digits at a time are grouped away, the last first, within a block of at most 4096
nodes, and each grouping nests the structs of the one before. Blocks are the nodes of the next
layer, which is rolled up the same way. Proofs come from opening the nested structs from the top:
a block meets the path above it by grouping on its number, never by a join of rows and hashes.

Only digests and ids are moved, never texts. A group that holds most rows is cut into ranges to
find ranks, and into blocks to hash them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import in_ranges, small_side
from sievemark.session import materialize

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
# Digits that are grouped away in one block.
DIGITS = 3
BLOCK_BITS = FANOUT_BITS * DIGITS
BLOCK = 1 << BLOCK_BITS

PROOF = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts in a row, digests as hex text."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row from its values."""
    return digest(*[framed(v) for v in values])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda found, level: digest(level["before"], found, level["after"]))


def siblings_text(proof: Column) -> Column:
    """All digests of a proof in a row, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def manifest(
    docs: DataFrame,
    fields: list[str],
    *,
    group: str = "source",
    order: str = "doc_id",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Leaf, roots and proof of every row.

    Args:
        docs: holds ``fields``, ``group`` and ``order``; only they and ``carry`` are read, so other
            columns may have any name.
        fields: columns whose values make the leaf, in this order.
        group: the tree of a row; null is a group of its own, before all others. Groups follow each
            other by their UTF-8 bytes.
        order: order of leaves in a tree, null first; equal ones by leaf, so repeated rows (equal
            leaves) take consecutive places.
        carry: more columns to compute from ``docs`` and return.

    Returns:
        ``order`` under its name, leaf, subroot, root string, proof (per level, from the leaf's to
        the root's, the digests before and after the node; a level exists where more than one node
        does), then the carried columns. One row per input row; null values have a mark of their
        own, so null and empty text differ; an empty table gives an empty result. Texts of any
        length are hashed whole where they are read.
    """
    carry = carry or {}
    leaves = materialize(
        docs.select(
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
            F.struct(F.col(order).alias("id"), *[c.alias(k) for k, c in carry.items()]).alias("item"),
            leaf(*[F.col(f) for f in fields]).alias("digest"),
        ).withColumn("by", F.col("item.id")),
        "leaves",
    )
    layers = _rolled_up(_ranked(leaves, ["by", "digest"]))
    subroots = layers[-1].select("tree", "digest")
    trees = subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("item"))
    top_layers = _rolled_up(_ranked(trees.withColumn("by", F.col("item")), ["by"]))

    root = top_layers[-1].select("tree", F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("subroot"),
                                 F.col("digest").alias("root"), F.array().cast(PROOF).alias("path"))
    to_trees = _opened_layers(top_layers, root)
    paths = to_trees.select(
        F.col("item").alias("tree"),
        F.lit(0).cast("long").alias("block"),
        F.col("digest").alias("subroot"),
        "root",
        "path",
    )
    out = _opened_layers(layers, paths)
    return out.select(
        F.col("item.id").alias(order),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.col("path").alias("proof"),
        *[F.col("item")[k].alias(k) for k in carry],
    )


def _ranked(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(tree, rank, n, digest, item): 0-based rank of each node in its tree by ``keys``, and the
    tree's number of nodes. A tree is counted range by range, so its offsets are as many rows as
    there are ranges."""
    placed = in_ranges(nodes, ["tree", *keys], "ranked")
    counted = placed.groupBy("run", "tree").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select(
        "run",
        "tree",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(tree).alias("n"),
    )
    shifts = small_side(materialize(shifts, "shifts"))
    return placed.join(shifts, ["run", "tree"]).select(
        "tree", (F.col("place") + F.col("shift")).alias("rank"), "n", "digest", "item"
    )


def _is_level(up: int) -> Column:
    """Whether a tree of n nodes has more than one node ``up`` levels above them."""
    return F.col("n") > F.lit(FANOUT**up)


def _merged(kids: str, up: int) -> Column:
    """Digest of a run of nodes; a tree that is down to one node keeps it."""
    below = F.array_join(F.transform(kids, lambda k: k["digest"]), "")
    return F.when(_is_level(up), F.sha2(below, 256)).otherwise(F.col(kids)[0]["digest"])


def _digit(level: int) -> Column:
    return F.shiftright("rank", FANOUT_BITS * level).bitwiseAND(FANOUT - 1).cast("int")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, digest, kids): one nested struct per block of nodes. One shuffle deals out
    whole blocks, all groupings keep to it."""
    digits = [f"digit{level}" for level in range(DIGITS)]
    rolled = nodes.select(
        "tree",
        "n",
        F.shiftright("rank", BLOCK_BITS).alias("block"),
        *[_digit(level).alias(d) for level, d in enumerate(digits)],
        "digest",
        F.col("item").alias("kids"),
    ).repartition("tree", "block")
    for level, d in enumerate(digits):
        node = F.struct(F.col(d).alias("digit"), "digest", "kids")
        rolled = (
            rolled.groupBy("tree", "n", "block", *digits[level + 1 :])
            .agg(F.sort_array(F.collect_list(node)).alias("kids"))
            .withColumn("digest", _merged("kids", level))
        )
    return rolled


def _rolled_up(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every layer; the last has one block per tree, whose digest is the root."""
    layers = []
    while True:
        layers.append(materialize(_blocks(nodes), "blocks"))
        largest = layers[-1].agg(F.max("n")).first()[0]
        if largest is None or largest <= BLOCK:
            return layers
        nodes = layers[-1].select(
            "tree",
            F.col("block").alias("rank"),
            F.shiftright(F.col("n") + (BLOCK - 1), BLOCK_BITS).alias("n"),
            "digest",
            F.col("block").alias("item"),
        )


def _opened_layers(layers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Nodes of the lowest layer with their paths, from the ``paths`` of the highest blocks."""
    for layer in reversed(layers[1:]):
        opened = _opened(layer, paths)
        paths = opened.select("tree", F.col("item").alias("block"), "subroot", "root", "path")
    return _opened(layers[0], paths)


def _opened(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, digest, item, subroot, root, path) of every node in ``blocks``.

    A block and the path above it are one group of two rows."""
    both = blocks.select("tree", "block", "n", "kids").unionByName(paths, allowMissingColumns=True)
    opened = both.groupBy("tree", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "subroot", "root", "path")]
    )
    for level in reversed(range(DIGITS)):
        opened = opened.withColumn("digests", F.transform("kids", lambda k: k["digest"]))
        around = F.transform(
            "kids",
            lambda k, i: F.struct(
                k["digest"].alias("digest"),
                k["kids"].alias("kids"),
                F.array_join(F.slice("digests", F.lit(1), i), "").alias("before"),
                F.array_join(F.slice("digests", i + 2, F.lit(FANOUT)), "").alias("after"),
            ),
        )
        opened = opened.select("tree", "n", "subroot", "root", "path", F.inline(around))
        step = F.concat(F.array(F.struct("before", "after")), F.col("path"))
        path = F.when(_is_level(level), step).otherwise(F.col("path"))
        opened = opened.select("tree", "n", "digest", "kids", "subroot", "root", path.alias("path"))
    return opened.withColumnRenamed("kids", "item")
