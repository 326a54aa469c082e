"""Evaluation metrics: one row per question, then one grouped pass for every breakdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import contains_flat, flatten_space, let

RETRIEVAL_METRICS = ("recall", "full_coverage", "mrr", "anchor_recall", "anchor_full")
_PASSAGE_SEPARATOR = " || "


def is_answerable(kind: Column) -> Column:
    return kind != "unanswerable"


def expected_of(questions: DataFrame) -> DataFrame:
    """query_id, doc_id: the expected documents of a golden set, one row each."""
    return questions.select("query_id", F.explode("expected_documents").alias("doc_id"))


def retrieval_results(
    hits: DataFrame, questions: DataFrame, modes: Sequence[str] = (), expected: DataFrame | None = None
) -> DataFrame:
    """Score the retrieved list of every answerable question.

    hits(query_id, rank, doc_id, text); questions(query_id, type, phrasing, cohort, anchors).
    ``expected``(query_id, doc_id) has the expected documents, by default those in the questions'
    ``expected_documents``. There may be any number: they are counted, and met by the at most k retrieved
    documents of a question in a join. With ``modes``, hits carry a ``mode`` and every question is scored
    once per mode. A question without expected documents has recall 0.
    """
    keys = ["mode", "query_id"] if modes else ["query_id"]
    wanted = (expected_of(questions) if expected is None else expected).select(
        "query_id", F.col("doc_id").cast("string").alias("doc_id")
    ).distinct()
    asked = questions.where(is_answerable(F.col("type"))).select("query_id", "type", "phrasing", "cohort", "anchors")
    asked = asked.join(wanted.groupBy("query_id").agg(F.count("*").alias("wanted")), "query_id", "left")
    if modes:
        asked = asked.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    hits = hits.select(*keys, "rank", F.col("doc_id").cast("string").alias("doc_id"), "text")
    # A document's place is among distinct documents, by its first passage.
    first = hits.groupBy(*keys, "doc_id").agg(F.min("rank").alias("rank"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    found = placed.join(wanted, ["query_id", "doc_id"]).groupBy(*keys).agg(F.count("*").alias("found"), F.min("place").alias("place"))
    lists = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("hits"))
    met = F.coalesce(F.col("hits"), F.array().cast("array<struct<rank:int,doc_id:string,text:string>>"))
    listed = asked.join(lists, keys, "left").join(found, keys, "left").select(
        *keys,
        "type",
        "phrasing",
        "cohort",
        F.coalesce("wanted", F.lit(0)).alias("wanted"),
        F.coalesce("found", F.lit(0)).alias("found"),
        "place",
        "anchors",
        F.array_distinct(F.transform(met, lambda h: h["doc_id"])).alias("retrieved_documents"),
        F.array_join(F.transform(met, lambda h: flatten_space(h["text"])), _PASSAGE_SEPARATOR).alias("seen"),
    )
    hit_anchors = F.size(F.filter("anchors", lambda a: contains_flat(F.col("seen"), a)))
    return listed.select(
        *keys,
        "type",
        "phrasing",
        "cohort",
        (F.col("found") / F.greatest("wanted", F.lit(1))).alias("recall"),
        F.when((F.col("wanted") > 0) & (F.col("found") == F.col("wanted")), 1.0).otherwise(0.0).alias("full_coverage"),
        F.coalesce(F.lit(1.0) / F.col("place"), F.lit(0.0)).alias("mrr"),
        let(
            hit_anchors,
            lambda n: F.when(F.size("anchors") > 0, n / F.size("anchors")).otherwise(0.0),
        ).alias("anchor_recall"),
        let(
            hit_anchors,
            lambda n: F.when((F.size("anchors") > 0) & (n == F.size("anchors")), 1.0).otherwise(0.0),
        ).alias("anchor_full"),
        "retrieved_documents",
    )


def _means() -> list[Column]:
    return [F.count("query_id").alias("questions")] + [
        F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in RETRIEVAL_METRICS
    ]


def retrieval_summary(results: DataFrame) -> DataFrame:
    """One row: the number of questions and the mean of every metric; zeros when there are none."""
    return results.agg(*_means())


def retrieval_breakdown(results: DataFrame) -> DataFrame:
    """Means by mode, and by mode with type, cohort and phrasing, in one grouped pass.

    ``results`` carries ``mode``. ``axis`` says which of the three splits a row belongs to.
    """
    sets = [["mode"], ["mode", "type"], ["mode", "cohort"], ["mode", "phrasing"]]
    keys = [F.col(c) for c in ("mode", "type", "cohort", "phrasing")]
    grouped = results.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        F.grouping("type").alias("no_type"),
        F.grouping("cohort").alias("no_cohort"),
        F.grouping("phrasing").alias("no_phrasing"),
        *_means(),
    )
    axis = (
        F.when(F.col("no_type") == 0, "type")
        .when(F.col("no_cohort") == 0, "cohort")
        .when(F.col("no_phrasing") == 0, "phrasing")
        .otherwise("all")
    )
    return grouped.select(
        "mode",
        axis.alias("axis"),
        F.coalesce("type", "cohort", "phrasing", F.lit("all")).alias("value"),
        "questions",
        *RETRIEVAL_METRICS,
    )


def rerank_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, change: five rows."""

    def long(results: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in RETRIEVAL_METRICS])
        return retrieval_summary(results).select(F.inline(pairs))

    return long(before, "before").join(long(after, "after"), "metric").withColumn(
        "change", F.col("after") - F.col("before")
    )


def moved_questions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Questions whose anchor recall differs between two runs, and which way."""
    left = before.select("query_id", F.col("anchor_recall").alias("before"))
    right = after.select("query_id", F.col("anchor_recall").alias("after"))
    direction = F.when(F.col("after") > F.col("before"), "recovered").otherwise("LOST")
    return left.join(right, "query_id").where(F.col("before") != F.col("after")).withColumn(
        "direction", direction
    )


def answer_results(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Score validated answers. questions(query_id, type, expected_facts)."""
    lowered = F.lower(F.col("text"))
    found = F.size(F.filter("expected_facts", lambda f: F.contains(lowered, F.lower(f))))
    return answers.join(questions.select("query_id", "type", "expected_facts"), "query_id").select(
        "query_id",
        "type",
        "refused",
        "conflict",
        "grounded",
        "invalid_citations",
        F.size("citations").alias("citation_count"),
        found.alias("facts_found"),
        F.size("expected_facts").alias("facts_expected"),
        (F.col("refused") != is_answerable(F.col("type"))).alias("refusal_correct"),
    )


def answer_summary(results: DataFrame) -> DataFrame:
    """One row. Every rate is a mean over its own group and 0 where that group is empty."""
    kind = F.col("type")
    answerable = is_answerable(kind)
    plain = answerable & ~kind.isin("contradiction", "underspecified")
    with_facts = answerable & (F.col("facts_expected") > 0)

    def rate(flag: Column, group: Column) -> Column:
        return F.coalesce(F.avg(F.when(group, flag.cast("double"))), F.lit(0.0))

    return results.agg(
        F.count("query_id").alias("questions"),
        rate(F.col("grounded"), F.lit(True)).alias("citation_validity"),
        rate(F.col("refused"), ~answerable).alias("refusal_accuracy"),
        rate(F.col("refused"), answerable).alias("false_refusal_rate"),
        rate(F.col("conflict"), kind == "contradiction").alias("conflict_detection"),
        rate(F.col("conflict"), plain).alias("false_conflict_rate"),
        rate(F.col("facts_found") == F.col("facts_expected"), with_facts).alias("fact_coverage"),
        F.count_if(~answerable).alias("unanswerable_questions"),
        F.count_if(answerable).alias("answerable_questions"),
    )


def question_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("type").agg(
        F.count("query_id").alias("questions"), F.count_if(is_answerable(F.col("type"))).alias("answerable")
    )
