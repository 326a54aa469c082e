"""Reciprocal-rank fusion of the two ranked lists, with the evidence of each path kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.topk import rank_within
from citeloom.settings import RETRIEVAL_MODES, RRF_CONSTANT, TOP_K

EVIDENCE = ("vector_rank", "vector_score", "keyword_rank", "keyword_score")


def _path(hits: DataFrame, name: str) -> DataFrame:
    return hits.select(
        "query_id",
        "chunk_id",
        F.col("rank").cast("int").alias(f"{name}_rank"),
        F.col("score").alias(f"{name}_score"),
    )


def evidence(vector_hits: DataFrame | None, keyword_hits: DataFrame | None) -> DataFrame:
    """One row per (question, chunk) that either list holds, with both ranks and scores.

    Lists have at most a pool of rows per question, so the full outer join is small.
    """
    if vector_hits is None and keyword_hits is None:
        raise ValueError("fusion needs at least one ranked list")
    if keyword_hits is None:
        both = _path(vector_hits, "vector")
    elif vector_hits is None:
        both = _path(keyword_hits, "keyword")
    else:
        both = _path(vector_hits, "vector").join(
            _path(keyword_hits, "keyword"), ["query_id", "chunk_id"], "full"
        )
    kinds = {"rank": "int", "score": "double"}
    return both.select(
        "query_id",
        "chunk_id",
        *[
            F.col(c) if c in both.columns else F.lit(None).cast(kinds[c.split("_")[1]]).alias(c)
            for c in EVIDENCE
        ],
    )


def reciprocal(constant: Column) -> Column:
    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (constant + F.col(rank)), F.lit(0.0))

    return share("vector_rank") + share("keyword_rank")


def fuse(
    vector_hits: DataFrame | None,
    keyword_hits: DataFrame | None,
    k: int = TOP_K,
    constant: int = RRF_CONSTANT,
) -> DataFrame:
    """query_id, chunk_id, evidence, score, rank: the ``k`` best by summed reciprocal rank."""
    scored = evidence(vector_hits, keyword_hits).withColumn("score", reciprocal(F.lit(constant)))
    return rank_within(scored, "query_id", "score", "chunk_id", k)


def fuse_modes(
    vector_hits: DataFrame, keyword_hits: DataFrame, k: int = TOP_K, constant: int = RRF_CONSTANT
) -> DataFrame:
    """The list of every retrieval mode, from one evidence table, with a ``mode`` column.

    A single-path mode keeps that path's evidence only, exactly as if the other had not run.
    """

    def only(path: str, mode: str) -> Column:
        return F.when(F.col("mode").isin("hybrid", mode), F.col(path)).alias(path)

    kept = (
        evidence(vector_hits, keyword_hits)
        .withColumn("mode", F.explode(F.array(*[F.lit(m) for m in RETRIEVAL_MODES])))
        .select("mode", "query_id", "chunk_id", *[only(c, c.split("_")[0]) for c in EVIDENCE])
        .where(F.col("vector_rank").isNotNull() | F.col("keyword_rank").isNotNull())
        .withColumn("score", reciprocal(F.lit(constant)))
    )
    order = Window.partitionBy("mode", "query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sweep(
    vector_hits: DataFrame, keyword_hits: DataFrame, constants: Sequence[int], k: int = TOP_K
) -> DataFrame:
    """The fused list under each of several constants, from one evidence table."""
    tried = evidence(vector_hits, keyword_hits).withColumn(
        "constant", F.explode(F.array(*[F.lit(int(c)) for c in constants]))
    )
    scored = tried.withColumn("score", reciprocal(F.col("constant")))
    order = Window.partitionBy("constant", "query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def paths() -> Column:
    found = F.concat_ws(
        "+",
        F.when(F.col("vector_rank").isNotNull(), F.concat(F.lit("vector#"), F.col("vector_rank"))),
        F.when(F.col("keyword_rank").isNotNull(), F.concat(F.lit("bm25#"), F.col("keyword_rank"))),
    )
    return F.when(found == "", "none").otherwise(found)


def found_by() -> Column:
    return (
        F.when(F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull(), "both")
        .when(F.col("vector_rank").isNotNull(), "vector only")
        .otherwise("BM25 only")
    )


def evidence_rows(hits: DataFrame) -> DataFrame:
    """Retrieved chunks as display rows. ``hits`` carries source_path, section and the evidence."""

    def number(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("-"))

    return hits.select(
        "query_id",
        F.col("rank").alias("position"),
        F.col("source_path").alias("document"),
        F.when(F.col("section") == "", "(document header)").otherwise(F.col("section")).alias("section"),
        F.when(F.col("vector_score").isNull(), "-")
        .otherwise(F.format_string("%.3f", F.col("vector_score")))
        .alias("cosine"),
        number("vector_rank").alias("vector_rank"),
        number("keyword_rank").alias("keyword_rank"),
        F.format_string("%.4f", F.col("score")).alias("fused_score"),
        found_by().alias("found_by"),
    )
