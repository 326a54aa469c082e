"""Approximate vector search by cells and product-quantised codes, with a measured recall.

A vector is stored with its cell (the nearest of about sqrt(n) centroids) and a code: each of its
``subspaces`` parts is replaced by the number of the nearest of at most 256 code words. A search scans the
codes of the nearest ``probes`` cells with one lookup table per question (a code's approximate product is a
sum of table entries), keeps the ``rerank`` best per question, and ranks those by their exact products. So the
vectors themselves are compared ``rerank`` times per question, and the scan reads one byte per subspace.

Nothing about the recall is assumed: ``tuned`` asks stored vectors, finds where their true neighbours
stand in both orders, and takes the smallest ``rerank`` and ``probes`` that keep the wanted share of them.

Questions that are too many to be sent at once are sent in blocks; the stored side is scanned once for each
block and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.vectors import dot
from citeloom.operators import knn
from citeloom.operators.topk import BestPerQuery, id_array, merge, partial_schema, rank_within, rounded
from citeloom.settings import MAX_SHIPPED_QUERY_CELLS
from citeloom.sources.scratch import staged

#: Dimensions of a subspace, code words of each, and rounds of refinement.
PART = 4
WORDS = 256
ROUNDS = 8
#: Vectors that centroids are fitted on, for each centroid, and that code words are fitted on in all.
SAMPLE_PER_CELL = 64
SAMPLE = 16_384
#: Stored vectors that are asked to measure recall.
ASKED = 256
#: Candidates per question that the measurement looks at, and their growth.
FEWEST, MOST = 32, 4096
#: (question, chunk) candidates that go to every task at once.
MAX_SENT_PAIRS = 500_000


@dataclass
class Codes:
    """Centroids (cells x dimensions) and code words (subspaces x words x dimensions of a part, zero-padded)."""

    centroids: np.ndarray
    words: np.ndarray

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as subspaces x rows x dimensions of a part."""
        subspaces, _, width = self.words.shape
        padded = np.zeros((len(vectors), subspaces * width))
        padded[:, : vectors.shape[1]] = vectors
        return padded.reshape(len(vectors), subspaces, width).transpose(1, 0, 2)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Rows x subspaces, a byte each."""
        return np.stack([_nearest(part, words) for part, words in zip(self.parts(vectors), self.words)], axis=1).astype(np.uint8)

    def tables(self, questions: np.ndarray) -> np.ndarray:
        """Subspaces x words x questions: what a code word adds to each question's product."""
        return np.einsum("swd,sqd->swq", self.words, self.parts(questions))

    def rows(self) -> list[tuple]:
        """kind, number, values: one row per centroid and per subspace."""
        return [("centroid", i, c.tolist()) for i, c in enumerate(self.centroids)] + [("words", i, w.ravel().tolist()) for i, w in enumerate(self.words)]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "kind string, number int, values array<double>")

    @classmethod
    def read(cls, frame: DataFrame) -> "Codes":
        rows = sorted(frame.collect())  # as many as centroids and subspaces
        centroids = np.array([r.values for r in rows if r.kind == "centroid"])
        words = [np.array(r.values) for r in rows if r.kind == "words"]
        width = -(-centroids.shape[1] // len(words))
        return cls(centroids, np.stack([w.reshape(-1, width) for w in words]))


def _nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Number of the nearest point (Euclidean, ties to the smaller) of each row, in bounded blocks."""
    half, step = (points**2).sum(axis=1) / 2, max(1, (1 << 22) // len(points))
    blocks = [np.argmax(rows[low : low + step] @ points.T - half, axis=1) for low in range(0, len(rows), step)]
    return np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


def _fitted_words(sample: np.ndarray, part: int, words: int) -> np.ndarray:
    subspaces = -(-sample.shape[1] // part)
    shape = Codes(np.zeros((0, sample.shape[1])), np.zeros((subspaces, 1, part)))
    fitted = []
    for rows in shape.parts(sample):
        points = rows[np.linspace(0, len(rows) - 1, min(words, len(rows))).astype(np.int64)].copy()
        for _ in range(ROUNDS):
            points = _moved(rows, points)
        fitted.append(points)
    return np.stack(fitted)


def _moved(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The mean of the rows nearest to each point; points without any stay."""
    near = _nearest(rows, points)
    count, sums, out = np.bincount(near, minlength=len(points)), np.zeros_like(points), points.copy()
    np.add.at(sums, near, rows)
    out[count > 0] = sums[count > 0] / count[count > 0, None]
    return out


def _refined(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round of Lloyd's refinement over the sample: tasks send sums per cell, not vectors."""
    shipped, dim = sample.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shipped.value
        sums, count = np.zeros_like(points), np.zeros(len(points), np.int64)
        for batch in batches:
            rows = knn.matrix(batch.column("vector"), dim)
            near = _nearest(rows, points)
            np.add.at(sums, near, rows)
            count += np.bincount(near, minlength=len(points))
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(count[hit]), pa.array(list(sums[hit]), pa.list_(pa.float64()))], names=["cell", "n", "sums"])

    def total(cell: pa.Table) -> pa.Table:
        summed = np.stack(cell["sums"].to_pylist()).sum(axis=0) / cell["n"].to_numpy().sum()
        return pa.table([cell["cell"][:1], pa.array([summed.tolist()], pa.list_(pa.float64()))], names=["cell", "vector"])

    parts = sample.select("vector").mapInArrow(run, "cell int, n bigint, sums array<double>")
    moved = parts.groupBy("cell").applyInArrow(total, "cell int, vector array<double>").collect()  # at most one row per centroid
    out = centroids.copy()
    for row in moved:
        out[row.cell] = row.vector
    return out


def fitted(vectors: DataFrame, part: int = PART, words: int = WORDS) -> Codes:
    """vectors(chunk_id, vector) -> centroids and code words, both fitted on samples of bounded size by the hash of the id."""
    total = vectors.count()
    if not total:
        raise ValueError("no vectors to fit codes on")
    dim = vectors.select(F.size("vector")).first()[0]
    cells = min(math.ceil(math.sqrt(total)), max(1, MAX_SHIPPED_QUERY_CELLS // dim))
    mixed = F.xxhash64(F.lit("sample"), "chunk_id")
    share = max(1, total // (SAMPLE_PER_CELL * cells))
    sample = staged(vectors.where(F.pmod(mixed, F.lit(share)) == 0).select("chunk_id", "vector"), "sample")
    chosen = sample.orderBy(mixed, "chunk_id").limit(max(cells, min(SAMPLE, MAX_SHIPPED_QUERY_CELLS // dim))).toArrow()
    rows = knn.matrix(chosen["vector"].combine_chunks(), dim)
    centroids, whole = rows[:cells].copy(), sample.limit(len(rows) + 1).count() <= len(rows)
    for _ in range(ROUNDS):
        # A sample that has come whole needs no job to go over it again.
        centroids = _moved(rows, centroids) if whole else _refined(sample, centroids)
    return Codes(centroids, _fitted_words(rows, part, words))


def encoded(vectors: DataFrame, codes: Codes) -> DataFrame:
    """The rows with ``cell`` and ``code``; other columns pass through, nothing is shuffled."""
    shipped, dim = vectors.sparkSession.sparkContext.broadcast(codes), codes.centroids.shape[1]
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = knn.matrix(batch.column("vector"), dim)
            cell = _nearest(rows, shipped.value.centroids).astype(np.int32)
            code = [c.tobytes() for c in shipped.value.encode(rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(code, pa.binary())], names=[*batch.schema.names, "cell", "code"])

    return vectors.mapInArrow(run, schema)


def _blocks(questions: DataFrame, max_cells: int) -> Iterator[pa.Table]:
    """The questions in tables of about ``max_cells`` numbers, one at a time."""
    questions = questions.select("query_id", "vector")
    sizes = questions.agg(F.count("*"), F.max(F.size("vector"))).first()
    count = math.ceil((sizes[0] or 0) * (sizes[1] or 0) / max_cells)
    for block in range(count):
        part = questions if count == 1 else questions.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == block)
        yield part.toArrow()


def _scanned(rows: DataFrame, codes: Codes, asked: pa.Table, keep: int, probes: int, schema: T.StructType) -> DataFrame:
    """query_id, chunk_id, score (approximate): the ``keep`` best of each task and question."""
    query_ids = asked["query_id"].combine_chunks()
    questions = knn.matrix(asked["vector"].combine_chunks(), codes.centroids.shape[1])
    near = np.argsort(-(questions @ codes.centroids.T - (codes.centroids**2).sum(axis=1) / 2), axis=1, kind="stable")[:, :probes]
    visits = np.zeros((len(codes.centroids), len(questions)), bool)
    visits[near, np.arange(len(questions))[:, None]] = True
    shipped = rows.sparkSession.sparkContext.broadcast((query_ids, codes.tables(questions), visits))
    if probes < len(codes.centroids):
        rows = rows.where(F.col("cell").isin(np.flatnonzero(visits.any(axis=1)).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, tables, visits = shipped.value
        best, id_type = BestPerQuery(len(query_ids), keep, floor=-1e300), None
        step = knn.rows_at_once(len(query_ids))
        for batch in batches:
            id_type = batch.schema.field("chunk_id").type
            ids, cell = id_array(batch.column("chunk_id")), batch.column("cell").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            for low in range(0, len(ids), step):
                part = slice(low, low + step)
                scores = sum(table[words] for table, words in zip(tables, code[part].T))
                best.offer(np.where(visits[cell[part]], scores, -np.inf), ids[part])
        if id_type is not None:
            yield from best.batch(query_ids, id_type)

    return rows.select("chunk_id", "cell", "code").mapInArrow(run, schema)


def candidates(rows: DataFrame, codes: Codes, questions: DataFrame, keep: int, probes: int, max_cells: int = MAX_SHIPPED_QUERY_CELLS) -> DataFrame:
    """query_id, chunk_id, score (approximate), rank: the ``keep`` best by code in the ``probes`` nearest cells."""
    schema = partial_schema(questions.schema["query_id"].dataType, rows.schema["chunk_id"].dataType)
    # Tables have as many entries per question as there are code words in all, and visits as there are cells.
    each = max(len(codes.centroids), codes.words.shape[0] * codes.words.shape[1])
    share = max(1, max_cells * codes.centroids.shape[1] // max(each, codes.centroids.shape[1]))
    found = None
    for asked in _blocks(questions, share):
        part = _scanned(rows, codes, asked, keep, probes, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    return merge(found, keep)


def search(rows: DataFrame, codes: Codes, questions: DataFrame, k: int, probes: int, rerank: int, max_cells: int = MAX_SHIPPED_QUERY_CELLS) -> DataFrame:
    """rows(chunk_id, vector, cell, code), questions(query_id, vector) -> query_id, chunk_id, score, rank.

    Fewer than ``k`` results only where there are fewer candidates in the probed cells.
    """
    if k <= 0:
        return knn.no_hits(questions, rows.schema["chunk_id"].dataType)
    pairs = staged(candidates(rows, codes, questions, max(k, rerank), probes, max_cells).select("query_id", "chunk_id"), "candidates")
    few = pairs.count() <= MAX_SENT_PAIRS
    met = rows.select("chunk_id", "vector").join(F.broadcast(pairs) if few else pairs, "chunk_id")
    scored = met.join(questions.select("query_id", F.col("vector").alias("_asked")), "query_id")
    ranked = scored.select("query_id", "chunk_id", rounded(dot(F.col("vector"), F.col("_asked"))).alias("score"))
    return rank_within(ranked, "query_id", "score", "chunk_id", k)


@dataclass
class Setting:
    """What a search looks at, and the share of true neighbours that it found when it was measured."""

    probes: int
    rerank: int
    recall: float


def tuned(rows: DataFrame, codes: Codes, k: int, recall: float, asked: int = ASKED, spare: int = 2) -> Setting:
    """The smallest setting with the wanted recall at ``k``, measured on ``asked`` stored vectors.

    ``rerank`` is then multiplied by ``spare``, as other questions may be harder than the measured ones. If not even the MOST best by
    code hold the wanted share, all cells and MOST are returned with the recall that they give.
    """
    questions = rows.orderBy(F.xxhash64(F.lit("asked"), "chunk_id"), "chunk_id").limit(asked).select(F.col("chunk_id").alias("query_id"), "vector")
    questions = staged(questions, "asked")
    truth = knn.exact_topk(rows.select("chunk_id", "vector"), questions, k).select("query_id", "chunk_id")
    cells = len(codes.centroids)
    order = candidates(rows, codes, questions, MOST, cells).select("query_id", "chunk_id", F.col("rank").alias("place"))
    held = truth.join(order, ["query_id", "chunk_id"], "left").join(rows.select("chunk_id", "cell"), "chunk_id")
    held = held.join(questions, "query_id").toArrow()  # asked x k rows
    if not held.num_rows:
        return Setting(cells, FEWEST, 1.0)
    vectors = knn.matrix(held["vector"].combine_chunks(), codes.centroids.shape[1])
    near = vectors @ codes.centroids.T - (codes.centroids**2).sum(axis=1) / 2
    own = near[np.arange(len(near)), held["cell"].to_numpy()]
    # Cells before the neighbour's own in the question's order.
    away = (near > own[:, None]).sum(axis=1) + 1
    place = held["place"].fill_null(MOST + 1).to_numpy()
    rerank = FEWEST
    while rerank < MOST and (place <= rerank).mean() < recall:
        rerank *= 2
    within = place <= rerank
    reached = np.array([(within & (away <= p)).mean() for p in range(1, cells + 1)])
    enough = np.flatnonzero(reached >= recall)
    probes = int(enough[0]) + 1 if len(enough) else cells
    return Setting(probes, min(MOST, max(rerank * spare, k)), float(reached[probes - 1]))
