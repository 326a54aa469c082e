"""Content-addressed vectors: a cache table, its misses, and a model that fills them in.

A vector belongs to one model, one task and one text; its key is a digest of all three. A cached
vector of the wrong length counts as absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import sha256
from citeloom.functions.vectors import unit
from citeloom.providers import with_retries
from citeloom.settings import EMBED_ATTEMPTS, EMBED_BATCH, EMBEDDING_DIM

EmbedBatch = Callable[[list[str], str], list[list[float]]]


def vector_key(model: Column, task: Column, text: Column) -> Column:
    return sha256(model, task, text)


def keyed(texts: DataFrame, model: str, task: str, text: str = "text") -> DataFrame:
    return texts.withColumn("key", vector_key(F.lit(model), F.lit(task), F.col(text)))


def usable(cache: DataFrame, dim: int) -> DataFrame:
    return cache.where(F.size("vector") == dim).select("key", "vector")


def with_cached(keyed_texts: DataFrame, cache: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Every text with its vector, or null; only vectors of length ``dim`` count.

    Copies of one text share a key, and copies may be a large share of all texts: a key of the left side of
    this join, which Spark's adaptive join splits.
    """
    return keyed_texts.join(usable(cache, dim), "key", "left")


def misses(keyed_texts: DataFrame, cache: DataFrame, dim: int = EMBEDDING_DIM, text: str = "text") -> DataFrame:
    """key, text of every distinct text that the cache lacks.

    Keys are compared first, without their texts; then the texts of the missing keys alone are folded.
    """
    missing = keyed_texts.select("key").distinct().join(usable(cache, dim).select("key"), "key", "left_anti")
    texts = keyed_texts.select("key", F.col(text).alias("text")).join(missing, "key", "left_semi")
    return texts.groupBy("key").agg(F.first("text").alias("text"))


def cache_report(keyed_texts: DataFrame, cache: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """texts, cache_hits, cache_misses, calls: one row. Only keys and counts are joined."""
    counted = keyed_texts.groupBy("key").agg(F.count("*").alias("n"))
    have = usable(cache, dim).select("key", F.lit(True).alias("have"))
    joined = counted.join(have, "key", "left").withColumn("missing", F.col("have").isNull())

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return joined.agg(
        total(F.lit(True)).alias("texts"),
        total(~F.col("missing")).alias("cache_hits"),
        total(F.col("missing")).alias("cache_misses"),
        F.ceil(total(F.col("missing")) / EMBED_BATCH).cast("bigint").alias("calls"),
    )


def require_cached(embedded: DataFrame) -> DataFrame:
    """Offline use: a text without a vector fails the query, it never becomes a zero vector."""
    return embedded.withColumn(
        "vector",
        F.coalesce(
            F.col("vector"),
            F.raise_error(F.concat(F.lit("no cached vector for key "), F.col("key"))).cast("array<float>"),
        ),
    )


def embed_missing(
    missing: DataFrame, embed: EmbedBatch, task: str, batch: int = EMBED_BATCH, observed: Observation | None = None
) -> DataFrame:
    """key, vector (unit length) for texts without one. Calls run in the tasks, a batch at a time.

    ``observed`` gets ``calls``, the number of calls whose vectors the pass has given, when it has run.
    """
    schema = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("vector", T.ArrayType(T.FloatType())),
            T.StructField("calls", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low in range(0, rows.num_rows, batch):
                part = rows.slice(low, batch)
                texts = part.column("text").to_pylist()
                vectors = with_retries(lambda: embed(texts, task), EMBED_ATTEMPTS)
                if len(vectors) != len(texts):
                    raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(vectors, type=pa.list_(pa.float32())),
                        # The first row of a call counts it.
                        pa.array([1] + [0] * (len(texts) - 1), pa.int32()),
                    ],
                    names=["key", "vector", "calls"],
                )

    called = missing.select("key", "text").mapInArrow(run, schema)
    if observed is not None:
        called = called.observe(observed, F.sum("calls").alias("calls"))
    return called.select("key", unit(F.col("vector")).alias("vector"))
