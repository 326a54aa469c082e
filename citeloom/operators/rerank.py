"""Reordering of fused candidates by stored model judgements.

An ordering belongs to one model, one instruction text, one question and one candidate list in one
order; its key is a digest of all four. Stored orderings that are not a permutation of their list
count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import payload
from citeloom.functions.text import sha256
from citeloom.settings import TOP_K

# --- fixed values: how an ordering's key is put together ---
PROMPT_DIGEST_CHARS = 12


def candidate_lists(ranked: DataFrame) -> DataFrame:
    """query_id, candidates: chunk ids in rank order. At most a pool of rows per question."""
    listed = ranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("listed")
    )
    return listed.select("query_id", F.col("listed.chunk_id").cast("array<string>").alias("candidates"))


def ordering_key(model: Column, prompt: Column, question: Column, candidates: Column) -> Column:
    digest = F.substring(F.sha2(prompt, 256), 1, PROMPT_DIGEST_CHARS)
    return sha256(model, digest, question, F.array_join(candidates, ","))


def requests(ranked: DataFrame, questions: DataFrame, model: str, prompt: str) -> DataFrame:
    """query_id, question, candidates, key: what an ordering is needed for."""
    return (
        candidate_lists(ranked)
        .join(questions.select("query_id", "question"), "query_id")
        .withColumn(
            "key", ordering_key(F.lit(model), F.lit(prompt), F.col("question"), F.col("candidates"))
        )
    )


def usable_orderings(wanted: DataFrame, orderings: DataFrame) -> DataFrame:
    """``wanted`` with ``order``: the stored permutation, else null. Lists of one need no judgement."""
    joined = wanted.join(orderings.select("key", F.col("order").alias("stored")), "key", "left")
    n = F.size("candidates")
    return joined.withColumn(
        "order",
        F.when(n == 1, F.array(F.lit(0)))
        .when(payload.is_permutation(F.col("stored"), n), F.col("stored"))
        .otherwise(F.lit(None).cast("array<int>")),
    ).drop("stored")


def missing_orderings(wanted: DataFrame, orderings: DataFrame) -> DataFrame:
    return usable_orderings(wanted, orderings).where(F.col("order").isNull()).drop("order")


def rerank(
    ranked: DataFrame,
    questions: DataFrame,
    orderings: DataFrame,
    model: str,
    prompt: str,
    k: int = TOP_K,
) -> DataFrame:
    """The ``k`` candidates that the stored ordering puts first; every other column is kept.

    A question without a usable ordering fails the query: a silent fallback would report fusion
    results as reranked ones.
    """
    if k <= 0:
        return ranked.limit(0)
    wanted = usable_orderings(requests(ranked, questions, model, prompt), orderings)
    order = F.coalesce(
        F.col("order"),
        F.raise_error(F.concat(F.lit("no stored ordering for question: "), F.col("question"))).cast(
            "array<int>"
        ),
    )
    placed = wanted.select("query_id", F.posexplode(F.slice(order, 1, k)).alias("place", "position"))
    return (
        ranked.join(
            placed.select("query_id", (F.col("position") + 1).alias("rank"), "place"), ["query_id", "rank"]
        )
        .withColumn("rank", (F.col("place") + 1).cast("int"))
        .drop("place")
    )


def orderings_of_responses(responses: DataFrame) -> DataFrame:
    """(key, candidates, response text) to (key, order): parse and repair what a model returned."""
    value = payload.parse(F.col("response"))
    parsed = F.when(value.isNull(), F.raise_error(F.lit("reranker returned text that is not JSON"))).otherwise(
        payload.integers(value, "ranking")
    )
    return responses.select("key", payload.repair_ranking(parsed, F.size("candidates")).alias("order"))
