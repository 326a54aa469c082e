"""Top-k per question, in two stages.

Stage one runs where the data lies: each task keeps its own k best per question and emits at most
``k`` rows per question, however many rows it read. Stage two ranks those few survivors. The score
matrix of a batch never leaves the task and no (question, chunk) pair list is ever shuffled.

Order everywhere: score descending, then id ascending; scores are compared after rounding (see
``settings.SCORE_DECIMALS``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.settings import SCORE_DECIMALS


def rank_within(frame: DataFrame, group: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """Keep the ``k`` best rows per group and number them from 1.

    The plan prunes to ``k`` per group inside every map task (WindowGroupLimit) before it shuffles.
    """
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return frame.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


# Survivors are merged in two rounds, as every task hands on k rows per question: first within parts
# of them, so that no task ranks what all tasks have kept for one question.
_MERGE_PARTS = 64


def merge(partial: DataFrame, k: int) -> DataFrame:
    """The k best per question of what the tasks kept."""
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(_MERGE_PARTS))
    keyed = partial.withColumn("part", F.struct("query_id", part.alias("part")))
    return rank_within(rank_within(keyed, "part", "score", "chunk_id", k).drop("part", "rank"), "query_id", "score", "chunk_id", k)


def grid(
    stored: DataFrame,
    asked: DataFrame,
    shards: int,
    blocks: int,
    best: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]],
    schema: T.StructType,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Both sides too large to ship: deal them into cells of (stored shard, question block).

    ``best`` gives the k best per question of one cell. ``within`` names columns that must be equal
    on both sides. With enough shards and blocks every cell is bounded, however skewed the columns.
    """

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    left = stored.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards))).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("shard", every(shards))

    # Both sides may come from one table; new names keep their columns apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def cell(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        types = [questions.schema.field("query_id").type, chunks.schema.field("chunk_id").type, pa.float64()]
        into = pa.schema(list(zip(schema.fieldNames(), types)))
        if not chunks.num_rows or not questions.num_rows:
            return into.empty_table()
        return pa.Table.from_batches(best(chunks, questions), into)

    keys = [*within, "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DECIMALS)


def partial_schema(query_id: T.DataType, chunk_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_id),
            T.StructField("chunk_id", chunk_id),
            T.StructField("score", T.DoubleType()),
        ]
    )


# Survivors that wait for a merge, at least.
_FEWEST = 65_536


class BestPerQuery:
    """The k best (id, score) of every question seen so far in one task."""

    def __init__(self, queries: int, k: int, floor: float):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.float64)
        self.id: np.ndarray | None = None
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waits = 0
        # A row can only enter a question's list with a score of at least this.
        self.bar = np.full(queries, floor)

    def offer(self, scores: np.ndarray, ids: np.ndarray, columns: np.ndarray | None = None) -> None:
        """``scores``: rows x questions (or the given question columns); NaN-free."""
        scores = np.round(scores, SCORE_DECIMALS)
        bar = self.bar if columns is None else self.bar[columns]
        if len(scores) > self.k:
            # The block's own k-th best bounds the list as well.
            at = len(scores) - self.k
            bar = np.maximum(bar, np.partition(scores, at, axis=0)[at])
        row, col = np.nonzero(scores >= bar)
        if not len(row):
            return
        query = col if columns is None else columns[col]
        self._waiting.append((query, scores[row, col], ids[row]))
        self._waits += len(row)
        # Merged when as many wait as are kept, so that the kept ones are sorted a few times in all.
        if self._waits >= max(len(self.query), _FEWEST):
            self._merge()

    def _merge(self) -> None:
        if not self._waits:
            return
        kept = [] if self.id is None else [(self.query, self.score, self.id)]
        query, score, ids = (np.concatenate(part) for part in zip(*kept, *self._waiting))
        self._waiting, self._waits = [], 0
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        keep = place < self.k
        full = place == self.k - 1
        self.bar[query[full]] = score[full]
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]

    def batch(self, query_ids: pa.Array, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.id is None or not len(self.query):
            return
        yield pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(self.query)),
                pa.array(self.id.tolist(), type=id_type),
                pa.array(self.score),
            ],
            names=["query_id", "chunk_id", "score"],
        )


def id_array(column: pa.Array) -> np.ndarray:
    """Ids as a sortable numpy array: integers stay, strings sort by code point."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=np.str_)
