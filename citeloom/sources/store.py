"""Chunk stores: chunks with their unit vectors as one table, so the two cannot fall out of step.

Both stores replace a chunk that is added again (by ``chunk_id``). ``TableStore`` searches exactly
and is written by ``persist``. ``CellStore`` writes on ``add``, keeps its rows partitioned by cell,
and searches the nearest cells only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.vectors import is_unit, norm
from citeloom.operators import knn
from citeloom.settings import POOL
from citeloom.sources.scratch import staged
from citeloom.sources.tables import read_stored

CHUNK_COLUMNS = ("chunk_id", "doc_id", "doc_title", "source_path", "section", "text", "index_text", "ordinal")
_WRITE_SALTS = 8


def paired(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Join chunks(chunk_id, ...) with vectors(chunk_id, vector); raise ValueError for what does not fit.

    Each side is counted by id before the two meet, so an id that stands twice on a side is an error
    and can neither multiply rows nor put one chunk's text beside another chunk's vector.
    """
    left = chunks.groupBy("chunk_id").agg(F.count("*").alias("n_chunks"))
    right = vectors.groupBy("chunk_id").agg(
        F.count("*").alias("n_vectors"),
        F.min(F.size("vector")).alias("low_dim"),
        F.max(F.size("vector")).alias("high_dim"),
        F.min(norm(F.col("vector"))).alias("low_norm"),
        F.max(norm(F.col("vector"))).alias("high_norm"),
        F.count_if(~is_unit(F.col("vector"))).alias("not_unit"),
    )
    found = (
        left.join(right, "chunk_id", "full")
        .agg(
            F.count_if(F.col("n_vectors").isNull()).alias("bare"),
            F.count_if(F.col("n_chunks").isNull()).alias("spare"),
            F.count_if((F.col("n_chunks") > 1) | (F.col("n_vectors") > 1)).alias("twice"),
            F.min(F.when((F.col("n_chunks") > 1) | (F.col("n_vectors") > 1), F.col("chunk_id"))).alias("one"),
            F.count("*").alias("ids"),
            F.coalesce(F.sum("not_unit"), F.lit(0)).alias("uneven"),
            *[F.min(c).alias(c) for c in ("low_dim", "low_norm")],
            *[F.max(c).alias(c) for c in ("high_dim", "high_norm")],
        )
        .first()
    )
    if not found["ids"]:
        raise ValueError("nothing to add: no chunk and no vector")
    if found["twice"]:
        raise ValueError(f"chunk ids must be unique, but {found['twice']} stand more than once, such as {found['one']}")
    if found["bare"] or found["spare"]:
        raise ValueError(f"{found['bare']} chunks lack a vector and {found['spare']} vectors lack a chunk")
    if found["low_dim"] != found["high_dim"]:
        raise ValueError(f"all vectors need one dimension; found {found['low_dim']} to {found['high_dim']}")
    if found["uneven"]:
        raise ValueError(f"all vectors need length 1; found {found['low_norm']:.4f} to {found['high_norm']:.4f}")
    return chunks.join(vectors.select("chunk_id", F.col("vector").cast("array<float>").alias("vector")), "chunk_id")


def _check_dimension(stored: DataFrame | None, added: DataFrame) -> None:
    """Both tables have one dimension each, so one row of each decides."""
    old = None if stored is None else stored.select(F.size("vector")).first()
    new = added.select(F.size("vector")).first()
    if old is not None and old[0] != new[0]:
        raise ValueError(f"the store holds vectors of dimension {old[0]}; these have {new[0]}")


def upserted(stored: DataFrame | None, added: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored rows whose key is not added, and the added rows, one for each key.

    Of added rows with one key the greatest stays, compared column by column in their order.
    """
    others = [c for c in added.columns if c != key]
    added = added.groupBy(key).agg(F.max(F.struct(*others)).alias("row")).select(key, "row.*").select(added.columns)
    if stored is None:
        return added
    return stored.join(added.select(key), key, "left_anti").unionByName(added)


def merged(stored: DataFrame | None, added: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``upserted`` for added rows whose keys are known to be unique."""
    return added if stored is None else stored.join(added.select(key), key, "left_anti").unionByName(added)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of every key. ``max_by`` keeps one row per key in each map task already."""
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("row"))
    return newest.select(key, "row.*")


class TableStore:
    """Exact search over a table of chunks and vectors."""

    def __init__(self, rows: DataFrame | None = None):
        self.rows = rows

    def add(self, chunks: DataFrame, vectors: DataFrame) -> None:
        added = staged(paired(chunks, vectors), "added")
        _check_dimension(self.rows, added)
        self.rows = staged(merged(self.rows, added), "store")

    def search(self, questions: DataFrame, k: int = POOL) -> DataFrame:
        """questions(query_id, vector) to query_id, chunk_id, score, rank."""
        if self.rows is None:
            return knn.no_hits(questions)
        return knn.exact_topk(self.rows, questions, k)

    def chunks(self) -> DataFrame:
        return self.rows.select(*[c for c in CHUNK_COLUMNS if c in self.rows.columns])

    def count(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def persist(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TableStore":
        return cls(read_stored(spark, f"{path}/rows"))


class CellStore:
    """Search by cells; bound to one folder, which ``add`` writes.

    ``probes`` is how many nearest cells a question looks into. None, the default, is all of them,
    which is exact; any number holds however many rows there are.
    """

    def __init__(self, spark: SparkSession, path: str, probes: int | None = None):
        self.spark, self.path, self.probes = spark, path, probes

    def _versions(self) -> DataFrame | None:
        try:
            return read_stored(self.spark, f"{self.path}/current")
        except FileNotFoundError:
            return None

    def _current(self) -> str | None:
        known = self._versions()
        row = None if known is None else known.orderBy(F.desc("version")).first()
        return None if row is None else f"{self.path}/{row['folder']}"

    def rows(self) -> DataFrame | None:
        folder = self._current()
        return None if folder is None else read_stored(self.spark, f"{folder}/rows")

    def add(self, chunks: DataFrame, vectors: DataFrame) -> None:
        stored = self.rows()
        kept = None if stored is None else stored.drop("cell")
        added = staged(paired(chunks, vectors), "added")
        _check_dimension(kept, added)
        rows = staged(merged(kept, added), "cells")
        centroids = staged(knn.pick_centroids(rows.select("chunk_id", "vector")), "centroids")
        # A new folder per version, named last: a lost job leaves the former version in use.
        known = self._versions()
        version = 1 if known is None else known.agg(F.max("version")).first()[0] + 1
        folder = f"v{version}-{uuid.uuid4().hex}"
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(_WRITE_SALTS))
        (
            knn.assign_cells(rows, centroids)
            .repartition("cell", salt)
            .write.partitionBy("cell")
            .parquet(f"{self.path}/{folder}/rows")
        )
        centroids.write.parquet(f"{self.path}/{folder}/centroids")
        named = self.spark.createDataFrame([(version, folder)], "version int, folder string")
        named.coalesce(1).write.mode("append").parquet(f"{self.path}/current")

    def search(self, questions: DataFrame, k: int = POOL) -> DataFrame:
        folder = self._current()
        if folder is None:
            return knn.no_hits(questions)
        centroids = read_stored(self.spark, f"{folder}/centroids")
        cells = self.rows()
        probes = max(1, centroids.count()) if self.probes is None else self.probes
        return knn.cell_topk(cells.select("chunk_id", "vector", "cell"), centroids, questions, k, probes)

    def chunks(self) -> DataFrame:
        rows = self.rows()
        return rows.select(*[c for c in CHUNK_COLUMNS if c in rows.columns])

    def count(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()

    def persist(self, path: str) -> None:
        """``add`` has already written; only the bound folder can be named."""
        if path != self.path:
            raise ValueError(f"rows are kept in {self.path} and are not copied to {path}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, probes: int | None = None) -> "CellStore":
        read_stored(spark, f"{path}/current")
        return cls(spark, path, probes)
