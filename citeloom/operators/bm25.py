"""Okapi BM25 over a chunk table, for a batch of questions.

Index (``build``): one scan tokenises the chunks; document frequencies are counted from each row's
*distinct* tokens, so they pre-aggregate in the map tasks and only (term, count) rows shuffle.

Search has three exact ways with the same result:

scan      question weights are few (checked): they go to every task, each task scores its own chunks
          and keeps its k best per question. The corpus is never shuffled; a term that occurs in
          every chunk costs no more than its occurrences.
blocks    more questions than may be shipped go in blocks. The postings are written once, and scanned
          for each block.
postings  the same two ways over rows that hold each chunk's terms with their counts instead of its
          tokens, as a stored index does. Counting needs no other row, so no term is ever a key of a
          shuffle, and no (question, chunk) pair leaves a task unless it is among its k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from citeloom.functions.text import tokenize
from citeloom.operators.topk import BestPerQuery, id_array, merge, partial_schema
from citeloom.settings import (
    BM25_B,
    BM25_EPSILON,
    BM25_K1,
    MAX_SHIPPED_WEIGHTS,
    MEAN_IDF_DECIMALS,
    POOL,
    SCORE_DECIMALS,
)
from citeloom.sources.scratch import staged

# Words of the rows that are counted at once, or those of one row if it has more: a task holds a dozen
# arrays of that length, whatever the batches it is handed.
_PIECE_WORDS = 250_000
# Scores of one block of rows are summed in one array of this many (row, question) cells at most.
_BLOCK_CELLS = 250_000
_BLOCK_CONTRIBUTIONS = 500_000


@dataclass(frozen=True)
class CorpusStats:
    """Chunks, mean chunk length in tokens, and the mean raw idf of the vocabulary."""

    n: int
    avgdl: float
    mean_idf: float


@dataclass(frozen=True)
class Bm25Index:
    """``chunks``: chunk_id, dl and tokens, or terms and counts (lazy). ``terms``: term, df (a written table)."""

    chunks: DataFrame
    terms: DataFrame
    stats: CorpusStats


def raw_idf(n: int, df: Column) -> Column:
    return F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)


def floored_idf(stats: CorpusStats, df: Column) -> Column:
    """A term in more than half of the chunks gets a fixed share of the mean idf instead."""
    idf = raw_idf(stats.n, df)
    return F.when(idf < 0, F.lit(BM25_EPSILON * stats.mean_idf)).otherwise(idf)


def tokenized(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "index_text") -> DataFrame:
    tokens = F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>"))
    return chunks.select(F.col(chunk_id).alias("chunk_id"), tokens.alias("tokens")).select(
        "chunk_id", F.size("tokens").alias("dl"), "tokens"
    )


def count_terms(tokens: DataFrame) -> DataFrame:
    """term, df, tokens: from one scan. The row with a null term counts chunks and all their tokens."""
    distinct = F.col("terms") if "terms" in tokens.columns else F.array_distinct("tokens")
    marks = F.array_append(distinct, F.lit(None).cast("string"))
    return (
        tokens.select("dl", F.explode(marks).alias("term"))
        .groupBy("term")
        .agg(
            F.count("*").alias("df"),
            F.sum(F.when(F.col("term").isNull(), F.col("dl")).otherwise(0)).alias("tokens"),
        )
    )


def corpus_stats(counted: DataFrame) -> CorpusStats:
    """The mean idf is taken over the histogram of document frequencies: few rows, and the same sum
    whatever the partitioning. Rounded before use, as it multiplies every very common term."""
    totals = counted.where(F.col("term").isNull()).first()
    if totals is None:
        return CorpusStats(0, 0.0, 0.0)
    n = int(totals["df"])
    histogram = counted.where(F.col("term").isNotNull()).groupBy("df").agg(F.count("*").alias("terms"))
    mean = F.round(
        F.sum(raw_idf(n, F.col("df")) * F.col("terms")) / F.sum("terms"), MEAN_IDF_DECIMALS
    )
    return CorpusStats(n, int(totals["tokens"]) / n, float(histogram.agg(mean).first()[0] or 0.0))


def build(
    chunks: DataFrame,
    chunk_id: str = "chunk_id",
    text: str = "index_text",
    keep_tokens: bool = False,
    keep_postings: bool = False,
) -> Bm25Index:
    """One pass over the chunks; the vocabulary table is written, so later steps do not repeat it.

    With ``keep_tokens`` the tokens are written as well, with ``keep_postings`` each chunk's terms and counts: worth
    the space where the chunks are costly to compute or the index is searched at all, as texts are then
    split once.
    """
    tokens = tokenized(chunks, chunk_id, text)
    if keep_postings:
        tokens = staged(postings(tokens), "postings")
    elif keep_tokens:
        tokens = staged(tokens, "tokens")
    counted = staged(count_terms(tokens), "terms")
    stats = corpus_stats(counted)
    return Bm25Index(tokens, counted.where(F.col("term").isNotNull()).select("term", "df"), stats)


def term_table(index: Bm25Index) -> DataFrame:
    """term, df and the idf that scoring uses."""
    return index.terms.select("term", "df", floored_idf(index.stats, F.col("df")).alias("idf"))


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, dl, tokens to chunk_id, dl, terms, counts: each chunk's postings, counted inside its row."""
    schema = StructType(
        [
            *chunks.select("chunk_id", "dl").schema.fields,
            StructField("terms", ArrayType(StringType())),
            StructField("counts", ArrayType(IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, "tokens"):
                row, term, tf, names = _counted(piece.column("tokens"))
                ends = pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(ends, names.take(pa.array(term)).cast(pa.string()))
                counts = pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("chunk_id"), piece.column("dl"), terms, counts], names=schema.fieldNames())

    return chunks.select("chunk_id", "dl", "tokens").mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows into pieces of at most _PIECE_WORDS words in a list column, or of one row."""
    ends = np.cumsum(pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + _PIECE_WORDS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _parents(lists: pa.Array) -> np.ndarray:
    """The row of every element of a list column."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))


def _counted(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term number and count of every distinct token of every row, by row; and the terms."""
    coded = tokens.flatten().dictionary_encode()
    row = _parents(tokens)
    width = max(1, len(coded.dictionary))
    key, tf = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return key // width, key % width, tf, coded.dictionary


def question_terms(questions: DataFrame, query_id: str = "query_id", text: str = "question") -> DataFrame:
    """query_id, term, times: a repeated word counts each time."""
    return (
        questions.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(text))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("times"))
    )


def question_weights(terms: DataFrame, stats: CorpusStats, questions: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, term, weight = times * idf, for the terms that the corpus has."""
    return (
        question_terms(questions, query_id, text)
        .join(terms, "term")
        .select("query_id", "term", (F.col("times") * floored_idf(stats, F.col("df"))).alias("weight"))
    )


def search(
    index: Bm25Index,
    questions: DataFrame,
    k: int = POOL,
    query_id: str = "query_id",
    text: str = "question",
    max_weights: int = MAX_SHIPPED_WEIGHTS,
) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks with a positive score."""
    if k <= 0:
        return _nothing(index, questions, query_id)
    weights = question_weights(index.terms, index.stats, questions, query_id, text)
    # Never more rows than the bound reach the driver.
    few = weights.limit(max_weights + 1).toArrow()
    if not few.num_rows:
        return _nothing(index, questions, query_id)
    schema = partial_schema(questions.schema[query_id].dataType, index.chunks.schema["chunk_id"].dataType)
    if few.num_rows > max_weights:
        partial = _in_blocks(index, weights, schema, k, max_weights)
    else:
        partial = _scan(index, few, schema, k)
    return merge(partial, k)


def _nothing(index: Bm25Index, questions: DataFrame, query_id: str) -> DataFrame:
    schema = partial_schema(questions.schema[query_id].dataType, index.chunks.schema["chunk_id"].dataType)
    return index.chunks.sparkSession.createDataFrame([], schema.add("rank", IntegerType()))


@dataclass(frozen=True)
class _Weights:
    """Question weights laid out by term: the questions of term t are ``start[t]:start[t + 1]``."""

    vocabulary: pa.Array
    query_ids: pa.Array
    query_of: np.ndarray
    start: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> "_Weights":
        rows = rows.sort_by([("term", "ascending"), ("query_id", "ascending")]).combine_chunks()
        vocabulary = pc.unique(rows["term"].combine_chunks())
        query_ids = pc.unique(rows["query_id"].combine_chunks())
        by_term = pc.index_in(rows["term"], value_set=vocabulary).to_numpy()
        query_of = pc.index_in(rows["query_id"], value_set=query_ids).to_numpy().astype(np.int64)
        start = np.searchsorted(by_term, np.arange(len(vocabulary) + 1))
        return cls(vocabulary, query_ids, query_of, start, rows["weight"].to_numpy())


def _asked(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the vocabulary and count of the asked terms of a batch, by row."""
    counted = "terms" in batch.schema.names
    words = batch.column("terms" if counted else "tokens")
    term = pc.index_in(words.flatten(), value_set=vocabulary)
    hit = term.is_valid().to_numpy(zero_copy_only=False)
    row = _parents(words)[hit]
    term = term.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    if counted:
        return row, term, batch.column("counts").flatten().to_numpy(zero_copy_only=False)[hit]
    key, tf = np.unique(row * len(vocabulary) + term, return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), tf


def _best_of(batches: Iterable[pa.RecordBatch], w: _Weights, avgdl: float, k: int) -> Iterator[pa.RecordBatch]:
    """Score batches of (chunk_id, dl, tokens) or (chunk_id, dl, terms, counts) sparsely and give the
    k best per question."""
    yield from _best_of_visits(((batch, None) for batch in batches), w, avgdl, k)


def _best_of_visits(
    visits: Iterable[tuple[pa.RecordBatch, np.ndarray | None]], w: _Weights, avgdl: float, k: int
) -> Iterator[pa.RecordBatch]:
    """``_best_of`` where each batch comes with the places of the questions it is for; None is all."""
    queries = len(w.query_ids)
    best = BestPerQuery(queries, k, floor=0.5 * 10.0**-SCORE_DECIMALS)
    id_type = None
    for batch, asking in ((piece, asking) for batch, asking in visits for piece in _pieces(batch, "terms" if "terms" in batch.schema.names else "tokens")):
        id_type = batch.schema.field("chunk_id").type
        ids = id_array(batch.column("chunk_id"))
        dl = batch.column("dl").to_numpy(zero_copy_only=False).astype(np.float64)
        row, term, tf = _asked(batch, w.vocabulary)
        part = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl[row] / avgdl))
        fan = w.start[term + 1] - w.start[term]
        for low, high in _blocks(row, fan, len(ids), queries):
            first, last = np.searchsorted(row, (low, high))
            n = fan[first:last]
            at = np.repeat(w.start[term[first:last]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(row[first:last] - low, n) * queries + w.query_of[at]
            gain = np.repeat(part[first:last], n) * w.weight[at]
            score = np.bincount(cell, weights=gain, minlength=(high - low) * queries)
            score = score.reshape(high - low, queries)
            if asking is None:
                best.offer(score, ids[low:high])
            else:
                best.offer(score[:, asking], ids[low:high], asking)
    if id_type is not None:
        yield from best.batch(w.query_ids, id_type)


def _scan(index: Bm25Index, weights: pa.Table, schema: StructType, k: int) -> DataFrame:
    """Score chunks where they lie. ``weights``: query_id, term, weight (size checked)."""
    avgdl = index.stats.avgdl
    shipped = index.chunks.sparkSession.sparkContext.broadcast(_Weights.of(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best_of(batches, shipped.value, avgdl, k)

    return index.chunks.mapInArrow(run, schema)


def _in_blocks(index: Bm25Index, weights: DataFrame, schema: StructType, k: int, max_weights: int) -> DataFrame:
    """Question blocks of about ``max_weights`` weights, sent one after another."""
    weights = staged(weights, "weights")
    blocks = math.ceil(2 * weights.count() / max(1, max_weights))
    rows = index.chunks if "terms" in index.chunks.columns else staged(postings(index.chunks), "postings")
    counted, found = Bm25Index(rows, index.terms, index.stats), None
    for block in range(blocks):
        asked = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if asked.num_rows:
            # Written at once, so that no more than one block is held.
            part = staged(_scan(counted, asked, schema, k), "best")
            found = part if found is None else found.unionByName(part)
    return found


def _blocks(row: np.ndarray, fan: np.ndarray, rows: int, queries: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose score cells and contributions stay within the block bounds."""
    per_row = np.bincount(row, weights=fan, minlength=rows)
    low, load = 0, 0.0
    most = max(1, _BLOCK_CELLS // max(1, queries))
    for i in range(rows):
        if i > low and (i - low >= most or load + per_row[i] > _BLOCK_CONTRIBUTIONS):
            yield low, i
            low, load = i, 0.0
        load += per_row[i]
    if rows > low:
        yield low, rows
