"""An approximate chunk store that grows by deltas.

``add`` and ``delete`` write what they are given and nothing else: a delta is a folder of rows (with cells
and codes, partitioned by cell) and of the ids that it replaces or removes. A reader sees, of every id, what the
last delta that names it says. ``compact`` writes the living rows as one new delta, with cells and codes fitted anew.
A manifest names the deltas in use; it is written last, so a lost job leaves the store as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import ann, knn
from citeloom.settings import POOL
from citeloom.sources.scratch import staged
from citeloom.sources.store import CHUNK_COLUMNS, paired
from citeloom.sources.tables import read_stored

#: Replaced or removed ids that may be sent to every task; more of them are joined.
MAX_SENT_IDS = 1_000_000
#: Files that a cell's rows are spread over when written, so that no cell is one task.
_WRITE_SALTS = 8
_MANIFEST = "version int, base boolean, folder string, codes string, probes int, rerank int, recall double"


class CodedStore:
    """Bound to one folder. ``recall``: share of true neighbours that a search is to find, at ``POOL``."""

    def __init__(self, spark: SparkSession, path: str, recall: float = 0.95):
        self.spark, self.path, self.recall = spark, path.rstrip("/"), recall

    # --- what is in use ---

    def _manifest(self) -> list:
        """The deltas in use, oldest first: the last base and what came after it."""
        try:
            rows = read_stored(self.spark, f"{self.path}/manifest", _MANIFEST).orderBy("version").collect()  # one row per delta
        except FileNotFoundError:
            return []
        base = max((i for i, r in enumerate(rows) if r.base), default=0)
        return rows[base:]

    def _delta(self, row) -> DataFrame:
        return read_stored(self.spark, f"{self.path}/{row.folder}/rows").withColumn("version", F.lit(row.version))

    def _named(self, deltas: list) -> DataFrame | None:
        """chunk_id, last: of every id that a later delta than the base names, the last version that does."""
        names = [read_stored(self.spark, f"{self.path}/{r.folder}/names").select("chunk_id", F.lit(r.version).alias("last")) for r in deltas[1:]]
        if not names:
            return None
        every = names[0]
        for more in names[1:]:
            every = every.unionByName(more)
        return every.groupBy("chunk_id").agg(F.max("last").alias("last"))

    def rows(self) -> DataFrame | None:
        """The living rows, with cell and code; None if nothing was ever added."""
        deltas = self._manifest()
        if not deltas:
            return None
        whole = None
        for row in deltas:
            if not row.folder.startswith("gone"):
                part = self._delta(row)
                whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
        named = self._named(deltas)
        if named is not None:
            named = staged(named, "named")
            few = named.count() <= MAX_SENT_IDS
            whole = whole.join(F.broadcast(named) if few else named, "chunk_id", "left").where(F.col("last").isNull() | (F.col("last") == F.col("version"))).drop("last")
        return whole.drop("version")

    def chunks(self) -> DataFrame:
        rows = self.rows()
        return rows.select(*[c for c in CHUNK_COLUMNS if c in rows.columns])

    def count(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()

    # --- writing ---

    def _write(self, rows: DataFrame, folder: str) -> None:
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(_WRITE_SALTS))
        rows.repartition("cell", salt).write.partitionBy("cell").parquet(f"{self.path}/{folder}/rows")
        rows.select("chunk_id").write.parquet(f"{self.path}/{folder}/names")

    def _commit(self, base: bool, folder: str, codes: str, setting: ann.Setting, version: int) -> None:
        row = [(version, base, folder, codes, setting.probes, setting.rerank, setting.recall)]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _new_base(self, rows: DataFrame, version: int) -> None:
        """Fit cells and codes on the rows, write them, and measure what a search needs."""
        name = uuid.uuid4().hex
        folder, codes = f"base-{version}-{name}", f"codes-{version}-{name}"
        made = ann.fitted(rows.select("chunk_id", "vector"))
        self._write(ann.encoded(rows, made), folder)
        made.frame(self.spark).coalesce(1).write.parquet(f"{self.path}/{codes}")
        setting = ann.tuned(read_stored(self.spark, f"{self.path}/{folder}/rows"), made, POOL, self.recall)
        self._commit(True, folder, codes, setting, version)

    def _setting(self, deltas: list) -> ann.Setting:
        return ann.Setting(deltas[-1].probes, deltas[-1].rerank, deltas[-1].recall)

    def add(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """chunks(chunk_id, ...) and vectors(chunk_id, vector) of the same ids; ids that are there are replaced.

        The first rows become the base. Later ones are written as they are, in the cells and codes of the base.
        """
        added, deltas = staged(paired(chunks, vectors), "added"), self._manifest()
        if not deltas:
            self._new_base(added, 1)
            return
        codes = ann.Codes.read(read_stored(self.spark, f"{self.path}/{deltas[-1].codes}"))
        dim = added.select(F.size("vector")).first()[0]
        if dim != codes.centroids.shape[1]:
            raise ValueError(f"the store holds vectors of dimension {codes.centroids.shape[1]}; these have {dim}")
        version = deltas[-1].version + 1
        folder = f"delta-{version}-{uuid.uuid4().hex}"
        self._write(ann.encoded(added, codes), folder)
        self._commit(False, folder, deltas[-1].codes, self._setting(deltas), version)

    def delete(self, ids: DataFrame) -> None:
        """Remove the chunk_ids of ``ids``; ids that are not there do no harm."""
        deltas = self._manifest()
        if not deltas:
            return
        version = deltas[-1].version + 1
        folder = f"gone-{version}-{uuid.uuid4().hex}"
        ids.select("chunk_id").distinct().write.parquet(f"{self.path}/{folder}/names")
        self._commit(False, folder, deltas[-1].codes, self._setting(deltas), version)

    def compact(self) -> None:
        """Write the living rows as a new base. Deltas stay on disk for readers that have begun, and are no longer read."""
        deltas = self._manifest()
        if deltas:
            self._new_base(self.rows().drop("cell", "code"), deltas[-1].version + 1)

    # --- searching ---

    def setting(self) -> ann.Setting:
        """Probes, candidates and the measured recall of a search."""
        return self._setting(self._manifest())

    def search(self, questions: DataFrame, k: int = POOL, max_cells: int | None = None) -> DataFrame:
        """questions(query_id, vector) -> query_id, chunk_id, score, rank."""
        deltas = self._manifest()
        if not deltas:
            return knn.no_hits(questions)
        codes, setting = ann.Codes.read(read_stored(self.spark, f"{self.path}/{deltas[-1].codes}")), self._setting(deltas)
        more = {} if max_cells is None else {"max_cells": max_cells}
        # More results than were measured for need as many more candidates.
        rerank = setting.rerank * -(-max(k, 1) // POOL)
        return ann.search(self.rows(), codes, questions, k, setting.probes, rerank, **more)

    @classmethod
    def load(cls, spark: SparkSession, path: str, recall: float = 0.95) -> "CodedStore":
        read_stored(spark, f"{path}/manifest", _MANIFEST)
        return cls(spark, path, recall)
