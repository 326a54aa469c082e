"""Prompt text from retrieved chunks. A question has at most k of them, so its text is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.chunking import citation_label

# --- fixed values: wording that surrounds the passages ---
NO_PASSAGES = "(no passages were retrieved)"


def _label() -> Column:
    return citation_label(F.col("doc_title"), F.col("section"))


def _numbered(hits: DataFrame, block: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context")
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    """query_id, context: ``[n] label (source: path)`` and the text, in rank order."""
    block = F.concat(
        F.lit("["), F.col("rank"), F.lit("] "), _label(), F.lit(" (source: "), F.col("source_path"),
        F.lit(")\n"), F.col("text"),
    )
    return _numbered(hits, block)


def answer_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, question, prompt: one for every question, also for those without passages."""
    context = F.coalesce(F.col("context"), F.lit(NO_PASSAGES))
    return questions.join(context_blocks(hits), "query_id", "left").select(
        "query_id",
        "question",
        F.concat(
            F.lit("Context passages:\n\n"), context, F.lit("\n\nQuestion: "), F.col("question")
        ).alias("prompt"),
    )


def rerank_prompts(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, prompt: the question and its numbered passages, without sources."""
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), _label(), F.lit("\n"), F.col("text"))
    return questions.join(_numbered(candidates, block), "query_id").select(
        "query_id",
        F.concat(
            F.lit("Question: "), F.col("question"), F.lit("\n\nPassages:\n\n"), F.col("context")
        ).alias("prompt"),
    )
