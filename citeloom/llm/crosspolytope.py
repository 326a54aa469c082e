"""Approximate nearest neighbours by cross-polytope hashing.

In each table a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns the
unit vector, and its bucket is the nearest signed axis. Every vector is indexed in all tables; a
question probes the several nearest axes in each. Bucket members and questions are brought together
in blocks of bounded size, so a bucket that holds a third of all vectors is many blocks, none is
capped, and each block gives its k nearest by the exact distance. A question that collects fewer than
k candidates in all tables is searched exactly, in blocks over all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.frames import with_columns
from citeloom.sources.scratch import staged

#: Rows and questions that one block compares at most, about.
BLOCK_ROWS = 8192
BLOCK_QUESTIONS = 2048


@dataclass(frozen=True)
class Settings:
    """``tables`` rotations; a question looks into ``probes`` buckets of each. More find more, and cost more."""

    tables: int = 20
    probes: int = 5
    seed: int = 7


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; their length is a power of two."""
    n, size = rows.shape
    step = 1
    while step < size:
        parts = rows.reshape(n, size // (2 * step), 2, step)
        rows = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return rows


def axes_of(vectors: np.ndarray, settings: Settings, probes: int) -> np.ndarray:
    """For each vector its ``probes`` nearest signed axes in each table, nearest first: (rows, tables, probes)."""
    size = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    rows = np.zeros((len(vectors), size))
    rows[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(rows), settings.tables, min(probes, size)), np.int32)
    for table in range(settings.tables):
        signs = np.random.default_rng([settings.seed, table, size]).choice([-1.0, 1.0], (3, size))
        turned = rows
        for s in signs:
            turned = hadamard(turned * s)
        near = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, : out.shape[2]]
        negative = np.take_along_axis(turned, near, 1) < 0
        out[:, table] = table * 2 * size + 2 * near + negative
    return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, finite throughout, not zero."""
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(number, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def hashed(vectors: DataFrame, settings: Settings) -> DataFrame:
    """vec_id, vector, dim, asks -> also ``buckets`` and, for rows that ask, ``probes``; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                part = batch.filter(pc.equal(batch.column("dim"), dim))
                axes = axes_of(_matrix(part.column("vector"), dim), settings, settings.probes)
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                buckets = pa.array(list(axes[:, :, 0]), pa.list_(pa.int32()))
                probes = pa.array([a.reshape(-1) if q else None for a, q in zip(axes, asks)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, buckets, probes], names=[*part.schema.names, "buckets", "probes"])

    return vectors.mapInArrow(run, with_columns(vectors.schema, "", "buckets array<int>, probes array<int>"))


def _nearest(questions: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest ids of each question within one block, by (distance, vec_id), itself left out."""
    ids, scores, asked = [], [], []
    if questions.num_rows and rows.num_rows:
        dim = rows.column("dim")[0].as_py()
        repeated = rows.column("vec_id").to_numpy()
        order = np.argsort(repeated, kind="stable")
        vectors = _matrix(rows.column("vector"), dim)[order]
        # An id that stands in several rows takes one place, at its nearest row.
        own, starts = np.unique(repeated[order], return_index=True)
        for q, vector in zip(questions.column("vec_id").to_pylist(), _matrix(questions.column("vector"), dim)):
            apart = vectors - vector
            distance = np.minimum.reduceat(np.sqrt(np.einsum("ij,ij->i", apart, apart)), starts)
            distance[own == q] = np.inf
            near = np.arange(len(own))
            if len(own) > k:
                near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
            near = near[np.lexsort((own[near], distance[near]))][:k]
            near = near[own[near] != q]
            ids.append(own[near])
            scores.append(distance[near])
            asked.append(np.full(len(near), q))
    flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((asked, np.int64), (ids, np.int64), (scores, np.float64))]
    return pa.table(flat, names=["query_id", "vec_id", "score"])


def _met(rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """vec_id, vector, dim, bucket of both -> each question's k nearest of every block, once per pair.

    Buckets are counted first (their number is fixed by the settings and dimensions) and cut into
    blocks; a row goes to one block of rows and all blocks of questions, a question the other way.
    """
    key = ["dim", "bucket"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks")).join(
        questions.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_QUESTIONS).cast("int").alias("question_blocks")), key
    )
    sizes = F.broadcast(sizes)

    def own(n: str) -> Column:
        return F.array(F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int"))

    def every(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    def placed(side: DataFrame, row: Column, question: Column) -> DataFrame:
        spread = side.join(sizes, key).withColumn("row_block", F.explode(row)).withColumn("question_block", F.explode(question))
        return spread.drop("row_blocks", "question_blocks")

    block = [*key, "row_block", "question_block"]
    left = placed(questions, every("row_blocks"), own("question_blocks")).groupBy(*block)
    # New names for the other side, as both sides come from one table.
    right = placed(rows, own("row_blocks"), every("question_blocks"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns]).groupBy(*block)
    pairs = left.cogroup(right).applyInArrow(lambda q, r: _nearest(q, r, k), "query_id bigint, vec_id bigint, score double")
    return pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def nearest(vectors: DataFrame, asks: Column, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """vec_id, vector -> query_id, rank (from 1), vec_id, score for the rows for which ``asks`` holds.

    score is the Euclidean distance in double precision on the original vectors; ties go to the smaller
    vec_id; a row is no neighbour of itself, nor of a row that repeats its vec_id. Vectors that are
    null, empty, zero, or hold a null or non-finite component, and rows without id, take no part.
    Vectors are compared with those of the same number of components. Repeated ids count once, at their
    nearest. Other columns are ignored.
    """
    rows = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), "vector", F.size("vector").alias("dim"), F.coalesce(asks, F.lit(False)).alias("asks")
    )
    index = staged(hashed(rows, settings), "hashed")
    side = ["vec_id", "vector", "dim"]
    questions = index.where("asks").select(*side, F.explode("probes").alias("bucket"))
    found = _met(index.select(*side, F.explode("buckets").alias("bucket")), questions, k)
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = staged(found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), "nearest")
    # Questions with too few candidates, where there are more to be had: compared with all vectors.
    have = best.groupBy("query_id").agg(F.count("*").alias("n"))
    there = index.groupBy("dim").agg(F.count_distinct("vec_id").alias("all"))
    asked = index.where("asks").select(*side).join(have, F.col("vec_id") == F.col("query_id"), "left").join(F.broadcast(there), "dim")
    few = staged(asked.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("all") - 1)).select(*side), "few")
    if few.isEmpty():
        return best.select("query_id", "rank", "vec_id", "score")
    whole = _met(index.select(*side, F.lit(-1).alias("bucket")), few.select(*side, F.lit(-1).alias("bucket")), k)
    exact = whole.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    rest = best.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return rest.unionByName(exact, allowMissingColumns=False).select("query_id", "rank", "vec_id", "score")
