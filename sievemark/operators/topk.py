"""Exact cosine top-k of stated queries over many vectors.

The corpus is scanned once. Each task multiplies its Arrow batches with the query
matrix and keeps only its own best k per query, so what leaves a task is k narrow
rows per query and never a (query, vector) pair table. Two grouped limits then merge
the task results.

A few queries travel with the task's function. Many are written in blocks, one row each,
and paired with chunks of the corpus, which is a grid of shares of blocks and corpus partitions:
every task reads its part of the corpus and one share of the blocks from their files, so no query
vector is on the driver and no task holds more than a share, however many queries there are. The
blocks come once, with a mark ahead of the corpus, and a chunk comes once for the whole share.

Inside a task, all queries of a share are multiplied with a chunk, and the pairs at or above the
score that a query's best k ask for are rescored and merged together, so no step goes query by
query. The products are quadratic, as every query meets every vector; all else is not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from sievemark.session import materialize

# What travels with a function: bytes of query vectors and queries. Beyond that it is blocks
# of this size that the tasks read.
BLOCK_BYTES = 8 << 20
BLOCK_QUERIES = 1024
# Bytes of query vectors and hits that one task holds. More queries mean more shares, each of which
# goes over the corpus in tasks of its own.
PASS_BYTES = 64 << 20
# Queries of a share, so many that reading a vector is little work beside multiplying it with them.
# More would leave fewer tasks.
SHARE_QUERIES = 8192
# What a query takes beside its vectors and hits.
QUERY_BYTES = 512
# Tasks of a grid for each core. Beyond that the corpus is cut into fewer parts, as every part
# returns k hits of every query.
TASKS_PER_CORE = 8
# Bytes of corpus vectors in a row that meets the blocks: small, as the JVM copies such rows, and an
# executor keeps room for large ones.
PIECE_BYTES = 512 << 10
# Bytes of corpus vectors and number of queries multiplied at once inside a task, to bound the
# score matrix and to keep it near the core.
CHUNK_BYTES = 2 << 20
STRIPE = 512
# Bytes of vectors that are rescored at once.
RESCORE_BYTES = 8 << 20
# Number of salted groups in the first merge.
MERGE_FAN_IN = 256


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def _reach(m: np.ndarray) -> float:
    """Length of the longest row, at least 1; next to the smallest doubles a unit row is longer."""
    lengths = np.sqrt(np.einsum("ij,ij->i", m, m))
    return max(1.0, lengths[np.isfinite(lengths)].max(initial=0.0))


def _to_matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _without_surplus(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Mask of the rows that can be a hit: of equal vectors, which score alike, only the ``k`` lowest
    ids. Keeps a vector that fills a chunk from being rescored for every query near it."""
    kept = np.ones(len(ids), bool)
    factors = np.random.default_rng(0).normal(size=vectors.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        mixed = np.einsum("ij,j->i", vectors, factors, dtype=np.float64)
    ordered = np.sort(mixed)
    if not (ordered[k:] == ordered[:-k]).any():
        return kept
    _, group, sizes = np.unique(mixed, return_inverse=True, return_counts=True)
    for g in np.flatnonzero(sizes > k):
        rows = np.flatnonzero(group == g)
        same = rows[(vectors[rows] == vectors[rows[0]]).all(axis=1)]
        kept[same[np.argsort(ids[same], kind="stable")[k:]]] = False
    return kept


class _Best:
    """Running best k of each query inside one task."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries = queries
        self.approx_queries = queries.astype(np.float32)
        self.k = k
        n, dim = queries.shape
        # Bound on the rounding error of a float32 dot product of unit vectors, with
        # room for the rounding of the final score and of the least score.
        self.slack = 4 * (dim + 4) * 2.0**-24 * _reach(queries)
        # The first filled[q] values of a row, best first; as wide as the fullest row.
        self.filled = np.zeros(n, np.int64)
        self.score_table = np.empty((n, 0))
        self.id_table: np.ndarray | None = None
        self.products = np.empty(0, np.float32)

    @property
    def scores(self) -> list[np.ndarray]:
        return [row[:m] for row, m in zip(self.score_table, self.filled)]

    @property
    def ids(self) -> list[np.ndarray | None]:
        if self.id_table is None:
            return [None] * len(self.filled)
        return [row[:m] if m else None for row, m in zip(self.id_table, self.filled)]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        squares = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        usable = np.isfinite(squares)
        if not usable.all():
            ids, vectors = ids[usable], vectors[usable]
        kept = _without_surplus(ids, vectors, self.k)
        if not kept.all():
            ids, vectors = ids[kept], vectors[kept]
        if not len(ids):
            return
        if self.id_table is None:
            self.id_table = np.empty(self.score_table.shape, ids.dtype)
        # Row-wise sums do not depend on the other rows of a batch, so equal vectors
        # get equal scores wherever they are.
        units = _unit_rows(vectors.astype(np.float64))
        slack = self.slack * _reach(units)
        narrow = units.astype(np.float32)
        size = min(STRIPE, len(self.queries)) * len(ids)
        if len(self.products) < size:
            self.products = np.empty(size, np.float32)
        step = max(1, RESCORE_BYTES // (units.shape[1] * 8))
        for start in range(0, len(self.queries), STRIPE):
            part = self.approx_queries[start : start + STRIPE]
            approx = self.products[: len(part) * len(ids)].reshape(len(part), len(ids))
            with np.errstate(invalid="ignore"):
                np.matmul(part, narrow.T, out=approx)
                rows, places = self._near(approx, start, slack)
            for first in range(0, len(rows), step):
                cut = slice(first, first + step)
                self._merge(start + rows[cut], ids[places[cut]], units[places[cut]])

    def _near(self, approx: np.ndarray, start: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the products that may be a hit, row by row."""
        stripe = slice(start, start + len(approx))
        width = approx.shape[1]

        def floor(some: np.ndarray) -> np.ndarray:
            """What the best k of these products alone ask for."""
            return np.partition(some, width - self.k, axis=1)[:, width - self.k] - np.float32(slack)

        least = np.full(len(approx), -np.inf, np.float32)
        full = self.filled[stripe] == self.k
        if full.any():
            least[full] = self.score_table[stripe][full, -1] - slack
        if width > self.k and not full.all():
            least[~full] = floor(approx[~full])
        rows = np.flatnonzero(approx.max(axis=1) >= least)
        if len(rows) < len(approx):
            approx, least = approx[rows], least[rows]
        near = approx >= least[:, None]
        flat = np.flatnonzero(near)
        if width > self.k:
            # Far more than k, as where a corpus gets nearer from chunk to chunk.
            crowded = np.flatnonzero(np.bincount(flat // width, minlength=len(rows)) > 2 * self.k + 32)
            if len(crowded):
                near[crowded] &= approx[crowded] >= floor(approx[crowded])[:, None]
                flat = np.flatnonzero(near)
        return rows[flat // width], flat % width

    def _merge(self, owner: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        """Take row after row for the query ``owner``; those of one query adjoin."""
        exact = (units * self.queries[owner]).sum(axis=1)
        # Scores are 32-bit values: vectors that differ only by rounding tie, and the id decides.
        exact = exact.astype(np.float32).astype(np.float64)
        touched = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
        held = np.arange(self.score_table.shape[1]) < self.filled[touched, None]
        owner = np.concatenate([np.repeat(touched, self.filled[touched]), owner])
        scores = np.concatenate([self.score_table[touched][held], exact])
        ids = np.concatenate([self.id_table[touched][held], ids])
        order = np.lexsort((ids, -scores, owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order, owner, rank = (x[rank < self.k] for x in (order, owner, rank))
        if (wider := rank.max() + 1 - self.score_table.shape[1]) > 0:
            pad = ((0, 0), (0, wider))
            self.score_table, self.id_table = (np.pad(x, pad) for x in (self.score_table, self.id_table))
        self.score_table[owner, rank] = scores[order]
        self.id_table[owner, rank] = ids[order]
        self.filled[owner] = rank + 1  # the last one of a query stays

    def hits(self, keys: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows (columns of ``keys``, id, score) of the hits so far."""
        if self.id_table is None:
            return
        for start in range(0, len(self.queries), STRIPE):
            stripe = slice(start, start + STRIPE)
            held = np.arange(self.score_table.shape[1]) < self.filled[stripe, None]
            if held.any():
                owner = start + np.nonzero(held)[0]
                columns = [
                    *keys.take(pa.array(owner)).columns,
                    pa.array(self.id_table[stripe][held].tolist(), type=schema.field(keys.num_columns).type),
                    pa.array(self.score_table[stripe][held]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _scanner(keys: pa.RecordBatch, queries: np.ndarray, k: int, schema: pa.Schema):
    """Function for ``mapInArrow``: (id, vector) batches to the task's best hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries, k)
        dim = queries.shape[1]
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                best.add(ids, flat.reshape(-1, dim))
        yield from best.hits(keys, schema)

    return scan


def merge_topk(
    partial: DataFrame, query_cols: Sequence[str], id_col: str, k: int, tasks: int | None = None
) -> DataFrame:
    """Best k per query with ``rank`` from 1; score descending, then id.

    Task results are merged per (query, salt) first, so that no single task sorts the
    results of all tasks for one query. At most ``MERGE_FAN_IN`` ``tasks`` for a query are
    merged at once.
    """
    best = [F.col("score").desc(), F.col(id_col)]
    salted = Window.partitionBy(*query_cols, "salt").orderBy(*best)
    whole = Window.partitionBy(*query_cols).orderBy(*best)
    if tasks is None or tasks > MERGE_FAN_IN:
        partial = (
            partial.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(MERGE_FAN_IN)))
            .withColumn("rank", F.row_number().over(salted))
            .where(F.col("rank") <= k)
        )
    return (
        partial.withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= k)
        .select(*query_cols, "rank", id_col, "score")
    )


def cosine_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    id_col: str,
    query_cols: Sequence[str],
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
    block_queries: int = BLOCK_QUERIES,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Hits (query_cols, rank, id, score) of every query, at most ``k`` each.

    Corpus rows without an id or a vector are left out; a vector of another width than the
    queries' stops the job, as ``filters.rejected_vectors`` shows beforehand. A zero vector
    scores 0. Fewer than ``k`` rows in the corpus give fewer hits.

    Up to ``block_bytes`` and ``block_queries``, query vectors are read now and the plan is lazy.
    More are written in blocks of that size, which the tasks read while they scan the corpus; if
    all blocks with their hits exceed ``pass_bytes`` or ``SHARE_QUERIES``, they are dealt into even
    shares below that, and tasks for every share and corpus partition scan the corpus once for each
    share.
    """
    query_cols = list(query_cols)
    fields = [queries.schema[c] for c in query_cols] + [corpus.schema[id_col]]
    out_type = StructType([*fields, StructField("score", DoubleType())])
    asked = queries.where(F.col(vector_col).isNotNull()).select(*query_cols, vector_col)
    n, low, high = asked.agg(
        F.count("*"), F.min(F.size(vector_col)), F.max(F.size(vector_col))
    ).first()
    if not n:
        return merge_topk(corpus.sparkSession.createDataFrame([], out_type), query_cols, id_col, k)
    if low != high:
        raise ValueError(f"Query vectors have different widths: {low} to {high}")
    wrong = F.raise_error(
        F.concat(F.lit(f"Vector width is not {high} but "), F.size(vector_col).cast("string"))
    ).cast("boolean")
    usable = (
        F.col(id_col).isNotNull()
        & F.col(vector_col).isNotNull()
        & F.when(F.col(vector_col).isNull() | (F.size(vector_col) == high), F.lit(True)).otherwise(wrong)
    )
    narrow = corpus.where(usable).select(id_col, vector_col)
    schema = to_arrow_schema(out_type)
    per_block = max(1, min(block_queries, block_bytes // (high * 8)))
    if n <= per_block:
        rows = asked.toArrow()
        keys = rows.select(query_cols).cast(pa.schema([schema.field(c) for c in query_cols]))
        matrix = _unit_rows(_to_matrix(rows.column(vector_col).combine_chunks(), high))
        scan = _scanner(keys.combine_chunks().to_batches()[0], matrix, k, schema)
        return merge_topk(narrow.mapInArrow(scan, out_type), query_cols, id_col, k)

    blocks = _blocks(asked, query_cols, vector_col, per_block)
    n_blocks = -(-n // per_block)
    # A query takes its vector twice, as 64 and 32 bits, and its hits.
    per_share = max(1, pass_bytes // (per_block * (high * 12 + k * 16 + QUERY_BYTES)))
    per_share = min(per_share, max(1, SHARE_QUERIES // per_block))
    n_shares = -(-n_blocks // per_share)
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    parts = -(-TASKS_PER_CORE * cores // n_shares)
    chunks = _chunks(narrow.coalesce(parts), id_col, vector_col, high)
    found = _grid(chunks, _shares(blocks, n_blocks, -(-n_blocks // n_shares)))
    dtype = _dtype(corpus, vector_col)
    scan = _grid_scanner(k, high, dtype, schema)
    return merge_topk(found.mapInArrow(scan, out_type), query_cols, id_col, k, parts)


def _blocks(asked: DataFrame, query_cols: Sequence[str], vector_col: str, per_block: int) -> DataFrame:
    """(block, queries): at most ``per_block`` queries as an array in one row. Queries are
    numbered over all partitions, so only the last block may be short."""
    query = F.struct(*[F.col(c).alias(f"key{i}") for i, c in enumerate(query_cols)], F.col(vector_col).alias("vector"))
    parts = asked.select(query.alias("query"), F.monotonically_increasing_id().alias("place"))
    parts = materialize(parts, "queries")
    part = F.shiftright("place", 33)
    # As many rows as the table of queries has partitions.
    sizes = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row.part, before))
        before += row.n
    offsets = asked.sparkSession.createDataFrame(offsets, "part long, before long")
    number = F.col("before") + F.col("place").bitwiseAND(2**33 - 1)
    numbered = parts.withColumn("part", part).join(F.broadcast(offsets), "part")
    block = F.floor(number / per_block).cast("int").alias("block")
    return materialize(numbered.groupBy(block).agg(F.collect_list("query").alias("queries")), "blocks")


def _dtype(corpus: DataFrame, vector_col: str) -> str:
    """What a chunk holds vectors as: floats as they are, all else as 64 bits."""
    return "<f4" if corpus.schema[vector_col].dataType.elementType == FloatType() else "<f8"


def _chunks(narrow: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(first, ids, vectors): the corpus with many vectors in a row, end to end as bytes. The first row
    of each partition that has any is empty, and ``first`` marks it."""
    rows = max(1, min(PIECE_BYTES, CHUNK_BYTES) // (dim * 8))
    dtype = _dtype(narrow, vector_col)
    id_type = narrow.schema[id_col].dataType

    def packed(first: bool, ids: pa.Array, vectors: pa.ListArray) -> pa.RecordBatch:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first]),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([flat.tobytes()], pa.binary()),
            ],
            names=["first", "ids", "vectors"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield packed(True, *batch.slice(0, 0).columns)
                first = False
            for start in range(0, batch.num_rows, rows):
                yield packed(False, *batch.slice(start, rows).columns)

    return narrow.mapInArrow(pack, f"first boolean, ids array<{id_type.simpleString()}>, vectors binary")


def _shares(blocks: DataFrame, n_blocks: int, per_share: int) -> DataFrame:
    """The blocks in partitions of exactly ``per_share`` of them, but for the last one."""
    if n_blocks <= per_share:
        return blocks.coalesce(1)
    return blocks.repartitionById(-(-n_blocks // per_share), F.floor(F.col("block") / per_share).cast("int"))


def _grid(chunks: DataFrame, shares: DataFrame) -> DataFrame:
    """Each task reads one partition of blocks from its files and one corpus partition: first all
    blocks, then all chunks beside the first of the blocks, so that a chunk is copied once and not
    for every block."""
    placed = shares.withColumn("place", F.monotonically_increasing_id().bitwiseAND(2**33 - 1))
    met = F.col("first") | (F.col("place") == 0)
    pairs = chunks.join(placed.hint("shuffle_replicate_nl"), met)
    return pairs.select("block", F.when(F.col("first"), F.col("queries")).alias("queries"), "ids", "vectors")


def _grid_scanner(k: int, dim: int, dtype: str, schema: pa.Schema):
    """Function for ``mapInArrow``: pairs of the grid to the task's best hits."""
    names = schema.names[:-2]
    key_schema = pa.schema([schema.field(c) for c in names])
    rows = max(1, CHUNK_BYTES // (dim * 8))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, matrices, best = [], [], None
        ids, vectors, held = [], [], 0
        for batch in batches:
            _, query_col, id_col, vector_col = batch.columns
            for i in range(batch.num_rows):
                if query_col[i].is_valid:
                    queries = query_col[i].values
                    fields = queries.flatten()
                    # Copies, as a view would keep the whole batch.
                    every = pa.array(range(len(queries)))
                    keys = [f.cast(schema.field(c).type).take(every) for f, c in zip(fields, names)]
                    matrices.append(_unit_rows(_to_matrix(fields[-1], dim)))
                    owners.append(pa.RecordBatch.from_arrays(keys, schema=key_schema))
                    continue
                ids.append(id_col[i].values.to_numpy(zero_copy_only=False))
                vectors.append(np.frombuffer(vector_col[i].as_buffer(), dtype).reshape(-1, dim))
                held += len(ids[-1])
                if held >= rows:
                    best = best or _Best(np.concatenate(matrices), k)
                    best.add(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors, held = [], [], 0
        if held:
            best = best or _Best(np.concatenate(matrices), k)
            best.add(np.concatenate(ids), np.concatenate(vectors))
        if best:
            keys = pa.Table.from_batches(owners, key_schema).combine_chunks()
            yield from best.hits(keys.to_batches()[0], schema)

    return scan
