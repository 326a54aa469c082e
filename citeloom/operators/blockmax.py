"""Keyword search that skips blocks of chunks which cannot reach a question's list.

The postings are dealt into blocks of about BLOCK_CHUNKS chunks. Of each term and block the largest part of a
score (without the term's weight) is kept; weighted and summed over a question's terms it bounds every score in
the block. A search first scores, for each question, the blocks of highest bound; the k-th score found there is
what any other list member must reach. Blocks whose bound does not are skipped, for that question; the rest are
scored. Lists are those of a full search, because a skipped block holds nothing that could enter them.

Bounds are a small table (one row per distinct term and block), read only for the asked terms. Blocks are
ranges of a sorted column, so a block that no question needs is not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import bm25
from citeloom.operators.topk import merge, partial_schema, rank_within
from citeloom.settings import BM25_B, BM25_K1, MAX_SHIPPED_WEIGHTS, POOL, SCORE_DECIMALS
from citeloom.sources.scratch import staged
from citeloom.sources.tables import read_stored

BLOCK_CHUNKS = 128
#: Blocks of highest bound that each question scores first.
SEEDS = 2
#: Bounds are sums of rounded parts in any order; they are raised by this share before they are compared.
SLACK = 1e-9


@dataclass(frozen=True)
class BlockIndex:
    """``postings``: chunk_id, dl, terms, counts, block. ``bounds``: term, block, top. ``terms``: term, df."""

    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    stats: bm25.CorpusStats


@dataclass(frozen=True)
class Skipped:
    """(question, block) pairs: all, of a positive bound, and scored."""

    pairs: int
    bounded: int
    scored: int


def _bounds(postings: DataFrame, avgdl: float) -> DataFrame:
    each = postings.select("block", "dl", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    tf = F.col("p.counts").cast("double")
    part = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.lit(avgdl)))
    return each.groupBy(F.col("p.terms").alias("term"), "block").agg(F.max(part).alias("top"))


def write(index: bm25.Bm25Index, path: str, block_chunks: int = BLOCK_CHUNKS) -> None:
    """Store postings by block, bounds by term, the vocabulary and the corpus statistics under ``path``."""
    rows = index.chunks if "terms" in index.chunks.columns else bm25.postings(index.chunks)
    blocks = max(1, math.ceil(index.stats.n / block_chunks))
    rows = staged(rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")), "postings")
    rows.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{path}/postings")
    bounds = _bounds(rows, index.stats.avgdl or 1.0)
    bounds.repartitionByRange("term").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/bounds")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    stats = [(index.stats.n, index.stats.avgdl, index.stats.mean_idf)]
    index.terms.sparkSession.createDataFrame(stats, "n bigint, avgdl double, mean_idf double").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> BlockIndex:
    row = read_stored(spark, f"{path}/stats").first()
    stats = bm25.CorpusStats(row["n"], row["avgdl"], row["mean_idf"])
    return BlockIndex(*[read_stored(spark, f"{path}/{name}") for name in ("postings", "bounds", "terms")], stats)


def _scored(index: BlockIndex, weights: pa.Table, wanted: DataFrame, k: int, query_type) -> DataFrame:
    """The k best of every task and question over the (query_id, block) pairs of ``wanted``."""
    table = bm25._Weights.of(weights)
    place = {q: i for i, q in enumerate(table.query_ids.to_pylist())}
    by_block: dict[int, list[int]] = {}
    rows = wanted.toArrow()  # as many as the bounds let through; checked by the caller
    for q, b in zip(rows["query_id"].to_pylist(), rows["block"].to_pylist()):
        by_block.setdefault(b, []).append(place[q])
    visits = {b: np.array(sorted(q)) for b, q in by_block.items()}
    shipped, avgdl = index.postings.sparkSession.sparkContext.broadcast((table, visits)), index.stats.avgdl
    schema = partial_schema(query_type, index.postings.schema["chunk_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, visits = shipped.value

        def visited() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            for batch in batches:
                block = batch.column("block").to_numpy()
                for one in np.unique(block).tolist():
                    if one in visits:
                        yield batch.filter(pa.array(block == one)), visits[one]

        yield from bm25._best_of_visits(visited(), table, avgdl, k)

    read = index.postings.where(F.col("block").isin(sorted(visits)))
    return read.mapInArrow(run, schema)


def search(
    index: BlockIndex, questions: DataFrame, k: int = POOL, query_id: str = "query_id", text: str = "question", max_weights: int = MAX_SHIPPED_WEIGHTS
) -> tuple[DataFrame, Skipped]:
    """query_id, chunk_id, score, rank as ``bm25.search`` gives them, and how much was skipped.

    Where question weights or (question, block) pairs are more than may be sent, all blocks are scored.
    """
    whole = bm25.Bm25Index(index.postings.drop("block"), index.terms, index.stats)
    weights = bm25.question_weights(index.terms, index.stats, questions, query_id, text)
    few = weights.limit(max_weights + 1).toArrow()
    if k <= 0 or not few.num_rows or few.num_rows > max_weights:
        return bm25.search(whole, questions, k, query_id, text, max_weights), Skipped(0, 0, 0)
    sent = F.broadcast(index.bounds.sparkSession.createDataFrame(few))
    # Weights may be negative; such a term adds at most nothing.
    bound = F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("top")) * (1 + SLACK)
    bounded = staged(index.bounds.join(sent, "term").groupBy("query_id", "block").agg(bound.alias("bound")).where("bound > 0"), "bounded")
    count = bounded.count()
    asked = len(few["query_id"].unique())
    pairs = asked * max(1, index.postings.select(F.max("block")).first()[0] + 1)
    if count > max_weights:
        return bm25.search(whole, questions, k, query_id, text, max_weights), Skipped(pairs, count, count)
    query_type = questions.schema[query_id].dataType
    seeds = staged(rank_within(bounded, "query_id", "bound", "block", SEEDS).select("query_id", "block"), "seeds")
    first = staged(merge(_scored(index, few, seeds, k, query_type), k), "first")
    reached = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    least = 10.0**-SCORE_DECIMALS
    rest = bounded.join(F.broadcast(reached), "query_id", "left").where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - least))
    rest = staged(rest.select("query_id", "block").join(F.broadcast(seeds), ["query_id", "block"], "left_anti"), "rest")
    more = merge(_scored(index, few, rest, k, query_type), k)
    both = merge(first.drop("rank").unionByName(more.drop("rank")), k)
    return both, Skipped(pairs, count, seeds.count() + rest.count())
