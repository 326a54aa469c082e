"""Exact and approximate cosine top-k for a batch of question vectors.

Vectors have unit length, so the dot product is the cosine. Two plans:

``exact_topk``   the question matrix is small (checked) and goes to every task; each task multiplies
                 its Arrow batches with it and keeps its k best per question. One scan, no shuffle of
                 vectors. Beyond the bound, one job deals both sides into a grid of cells; a cell's
                 questions are scored in blocks of the bound.
``assign_cells`` / ``cell_topk``  the approximate index: vectors are labelled with their nearest
                 centroid, questions look only into their nearest cells. Stored partitioned by cell,
                 a search reads the probed cells alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.topk import BestPerQuery, grid, id_array, merge, partial_schema, rank_within
from citeloom.settings import MAX_SCORE_CELLS, MAX_SHIPPED_QUERY_CELLS, POOL, SCORE_DECIMALS
from citeloom.sources.scratch import staged

_BLOCK_ROWS = 2048
# Numbers of the vectors, and of the questions, that a cell of the grid holds: 4 MB of each as doubles.
_CELL_NUMBERS = 1 << 19


class DimensionMismatch(ValueError):
    """A vector's length differs from the length of the question vectors."""


def rows_at_once(questions: int) -> int:
    """Rows whose scores for all questions fit the bound on a block, at least one."""
    return max(1, min(_BLOCK_ROWS, MAX_SCORE_CELLS // max(1, questions)))


def no_hits(questions: DataFrame, chunk_id: T.DataType = T.StringType()) -> DataFrame:
    """What a search of nothing gives: the columns of a ranked list, no row."""
    schema = partial_schema(questions.schema["query_id"].dataType, chunk_id)
    return questions.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a rows x dim float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = len(column)
    width = dim if dim is not None else (len(flat) // rows if rows else 0)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
    if rows and (lengths != width).any():
        found = lengths[lengths != width][0]
        raise DimensionMismatch(f"expected vectors of dimension {width}, found {found}")
    return flat.reshape(rows, width)


def exact_topk(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = POOL,
    max_cells: int = MAX_SHIPPED_QUERY_CELLS,
) -> DataFrame:
    """vectors(chunk_id, vector), questions(query_id, vector) to query_id, chunk_id, score, rank."""
    vectors, questions = vectors.select("chunk_id", "vector"), questions.select("query_id", "vector")
    schema = partial_schema(questions.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType)
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    small = _collect_bounded(questions, max_cells)
    if small is not None:
        if not small.num_rows:
            return vectors.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
        partial = vectors.mapInArrow(_scan_kernel(vectors, small, k), schema)
    else:
        partial = _every_pair(vectors, questions, k, schema, max_cells)
    return merge(partial, k)


def _every_pair(vectors: DataFrame, questions: DataFrame, k: int, schema: T.StructType, max_cells: int) -> DataFrame:
    """All cells of (vector shard, question shard) in one job; in a cell, question blocks of at most ``max_cells`` numbers.

    Rows are copied once per shard of the other side, of _CELL_NUMBERS numbers, however small the blocks are.
    """

    def sides(frame: DataFrame) -> tuple[int, int]:
        got = frame.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
        dim = max(1, got["dim"] or 1)
        return max(1, math.ceil(got["n"] * dim / _CELL_NUMBERS)), max(1, max_cells // dim)

    (shards, _), (blocks, step) = sides(vectors), sides(questions)

    def best(stored: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        for low in range(0, asked.num_rows, step):
            part = asked.slice(low, step).combine_chunks()
            weights = matrix(part["vector"].combine_chunks()).T.copy()
            yield from _best_of(stored.to_batches(_BLOCK_ROWS), part["query_id"].combine_chunks(), weights, k)

    return grid(vectors, questions, shards, blocks, best, schema)


def _collect_bounded(questions: DataFrame, max_cells: int) -> pa.Table | None:
    """The questions, if they have at most ``max_cells`` numbers in all; at most that many are read."""
    one = questions.limit(1).toArrow()
    dim = max(1, len(one["vector"][0])) if one.num_rows else 1
    rows = max_cells // dim
    got = questions.limit(rows + 1).toArrow()
    return got.combine_chunks() if got.num_rows <= rows else None


def _scan_kernel(vectors: DataFrame, questions: pa.Table, k: int):
    query_ids = questions["query_id"].combine_chunks()
    weights = matrix(questions["vector"].combine_chunks()).T.copy()
    shipped = vectors.sparkSession.sparkContext.broadcast((query_ids, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best_of(batches, *shipped.value, k)

    return run


def _best_of(
    batches: Iterable[pa.RecordBatch], query_ids: pa.Array, weights: np.ndarray, k: int
) -> Iterator[pa.RecordBatch]:
    """Multiply batches of (chunk_id, vector) with dim x questions and give the k best per question."""
    best = BestPerQuery(len(query_ids), k, floor=-np.inf)
    id_type = None
    for batch in batches:
        id_type = batch.schema.field("chunk_id").type
        rows = matrix(batch.column("vector"), weights.shape[0])
        ids = id_array(batch.column("chunk_id"))
        step = rows_at_once(len(query_ids))
        for low in range(0, len(ids), step):
            best.offer(rows[low : low + step] @ weights, ids[low : low + step])
    if id_type is not None:
        yield from best.batch(query_ids, id_type)


def _grid(
    vectors: DataFrame,
    questions: DataFrame,
    k: int,
    schema: T.StructType,
    shard_rows: int,
    max_cells: int,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Both sides too large to ship: bounded cells of (vector shard, question block).

    ``within`` names columns that must be equal on both sides. Shards and blocks are counted for the
    fullest of their groups, so no cell of the grid is larger than planned, however skewed they are.
    """
    stored = vectors.groupBy(*within).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))
    most = stored.agg(F.max("n").alias("n"), F.max("dim").alias("dim")).first()
    asked = questions.groupBy(*within).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shards = max(1, math.ceil((most["n"] or 0) / shard_rows))
    per_block = max(1, max_cells // max(1, most["dim"] or 1))
    blocks = max(1, math.ceil(asked / per_block))

    def best(stored: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        query_ids = asked["query_id"].combine_chunks()
        weights = matrix(asked["vector"].combine_chunks()).T
        return _best_of(stored.to_batches(_BLOCK_ROWS), query_ids, weights, k)

    return grid(vectors, questions, shards, blocks, best, schema, within)


# --- approximate index -------------------------------------------------------------------------


def pick_centroids(vectors: DataFrame, count: int | None = None) -> DataFrame:
    """cell, vector: ``count`` stored vectors (square root of the table by default), chosen by the
    order of a digest of their ids, so that a rebuild picks the same ones. Cells are numbered by id.
    """
    if count is None:
        count = math.ceil(math.sqrt(max(1, vectors.count())))
    chosen = vectors.orderBy(F.md5(F.col("chunk_id").cast("string"))).limit(count)
    # Numbered in one task: as many rows as cells, by default the square root of the table.
    number = F.row_number().over(Window.orderBy("chunk_id")) - 1
    return chosen.select(number.alias("cell"), "vector")


def assign_cells(
    vectors: DataFrame, centroids: DataFrame, max_cells: int = MAX_SHIPPED_QUERY_CELLS, shard_rows: int = 50_000
) -> DataFrame:
    """The rows with ``cell``, the number of the nearest centroid (ties to the smaller cell).

    Other columns pass through. Centroids of at most ``max_cells`` numbers go to every task, so no join
    is needed to attach the cells; more of them meet the vectors in a grid of bounded blocks.
    """
    small = _collect_bounded(centroids.select("cell", "vector").orderBy("cell"), max_cells)
    if small is None:
        near = _grid(
            centroids.select(F.col("cell").alias("chunk_id"), "vector"),
            vectors.select(F.col("chunk_id").alias("query_id"), "vector"),
            1,
            partial_schema(vectors.schema["chunk_id"].dataType, T.IntegerType()),
            shard_rows,
            max_cells,
        )
        nearest = rank_within(near, "query_id", "score", "chunk_id", 1)
        return vectors.join(nearest.select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("cell")), "chunk_id")
    order = np.argsort(small["cell"].to_numpy())
    numbers = small["cell"].combine_chunks().take(pa.array(order))
    weights = matrix(small["vector"].combine_chunks())[order].T.copy()
    shipped = vectors.sparkSession.sparkContext.broadcast((numbers, weights))
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weights = shipped.value
        for batch in batches:
            rows, step, near = matrix(batch.column("vector"), weights.shape[0]), rows_at_once(len(numbers)), [np.zeros(0, np.int64)]
            for low in range(0, len(rows), step):
                near.append(np.round(rows[low : low + step] @ weights, SCORE_DECIMALS).argmax(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, numbers.take(pa.array(np.concatenate(near)))], names=[*batch.schema.names, "cell"]
            )

    return vectors.mapInArrow(run, schema)


def probed_cells(cells: DataFrame, centroids: DataFrame, questions: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, cell: the ``probes`` nearest cells, and further ones while those nearer hold fewer
    than ``k`` vectors together, so that every question gets as many results as there are.

    Only questions whose nearest cells hold too few look further, each time at twice as many cells.
    """
    near = centroids.select(F.col("cell").alias("chunk_id"), "vector")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    total, many = centroids.count(), probes
    nearer = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    asking, done = questions, None
    while True:
        ranked = exact_topk(near, asking, min(many, total)).select("query_id", F.col("chunk_id").alias("cell"), "rank")
        sized = ranked.join(sizes, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        held = staged(sized.withColumn("held", F.coalesce(F.sum("n").over(nearer), F.lit(0))), "probed")
        enough = held.groupBy("query_id").agg(F.sum("n").alias("all")).where(F.col("all") >= k).select("query_id")
        last = many >= total
        ready = held if last else held.join(enough, "query_id", "left_semi")
        ready = ready.where((F.col("rank") <= probes) | (F.col("held") < k)).select("query_id", "cell")
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        asking = staged(asking.select("query_id", "vector").join(enough, "query_id", "left_anti"), "asking")
        if asking.isEmpty():
            return done
        many *= 2


def cell_topk(
    cells: DataFrame,
    centroids: DataFrame,
    questions: DataFrame,
    k: int = POOL,
    probes: int = 8,
    max_cells: int = MAX_SHIPPED_QUERY_CELLS,
    shard_rows: int = 50_000,
) -> DataFrame:
    """Approximate top-k: each question looks into its ``probes`` nearest cells.

    With as many probes as cells the result is exact. A cell that holds a third of all vectors is
    still read by many tasks, because nothing is grouped by cell.
    """
    schema = partial_schema(questions.schema["query_id"].dataType, cells.schema["chunk_id"].dataType)
    if k <= 0:
        return cells.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    probed = probed_cells(cells, centroids, questions, k, probes)
    asked = questions.select("query_id", "vector").join(probed, "query_id")
    # Few (question, cell) rows are shipped and the vectors stay where they are.
    small = _collect_bounded(asked, max_cells)
    if small is None:
        stored = cells.select("chunk_id", "vector", "cell")
        partial = _grid(stored, asked, k, schema, shard_rows, max_cells, ("cell",))
    elif not small.num_rows:
        return cells.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    else:
        wanted = small["cell"].unique().to_pylist()
        partial = cells.where(F.col("cell").isin(wanted)).mapInArrow(_probe_kernel(cells, small, k), schema)
    return merge(partial, k)


def _probe_kernel(cells: DataFrame, asked: pa.Table, k: int):
    query_ids = asked["query_id"].unique()
    place = {q: i for i, q in enumerate(query_ids.to_pylist())}
    rows = matrix(asked["vector"].combine_chunks())
    weights = np.zeros((rows.shape[1], len(query_ids)))
    visitors: dict = {}
    for row, (query, cell) in enumerate(zip(asked["query_id"].to_pylist(), asked["cell"].to_pylist())):
        weights[:, place[query]] = rows[row]
        visitors.setdefault(cell, []).append(place[query])
    lists = {cell: np.array(sorted(q)) for cell, q in visitors.items()}
    shipped = cells.sparkSession.sparkContext.broadcast((query_ids, weights, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, weights, lists = shipped.value
        best = BestPerQuery(len(query_ids), k, floor=-np.inf)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("chunk_id").type
            vectors = matrix(batch.column("vector"), weights.shape[0])
            ids, cell = id_array(batch.column("chunk_id")), np.array(batch.column("cell").to_pylist())
            for one in np.unique(cell):
                who, here = lists.get(one.item()), np.nonzero(cell == one)[0]
                if who is not None:
                    step = rows_at_once(len(who))
                    for low in range(0, len(here), step):
                        rows = here[low : low + step]
                        best.offer(vectors[rows] @ weights[:, who], ids[rows], who)
        if id_type is not None:
            yield from best.batch(query_ids, id_type)

    return run
