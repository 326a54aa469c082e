"""Validation of generated answers against the passages that the model was given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import payload
from citeloom.functions.text import citation_numbers, is_blank, number_within, sorted_numbers, strip, strip_citations
from citeloom.operators.chunking import citation_label


def response_error(raw: Column) -> Column:
    """Why a response is unusable, or null."""
    value = payload.parse(raw)
    return (
        F.when(raw.isNull() | is_blank(raw), "empty response")
        .when(value.isNull(), "not JSON")
        .when(~payload.is_object(value), "not a JSON object")
    )


def validate(responses: DataFrame) -> DataFrame:
    """(query_id, response, passages) to the audited answer.

    ``passages`` is how many were given. Numbers may have any size, so invalid ones are decimal text. Inline and declared numbers are both checked; markers of
    passages that were never given are removed from the text and listed. Numbers that remain are
    ordered by their place in the text, then the merely declared ones ascending.
    """
    value = payload.parse(F.col("response"))
    raw = responses.select(
        "query_id",
        "passages",
        strip(payload.text_of(value, "answer")).alias("raw_text"),
        sorted_numbers(F.array_distinct(payload.whole_numbers(value, "citations"))).alias("declared"),
        payload.truthy(value, "refused").alias("refused"),
        payload.truthy(value, "conflict").alias("conflict"),
        response_error(F.col("response")).alias("error"),
    )
    inline = F.array_distinct(citation_numbers(F.col("raw_text")))
    checked = raw.withColumn(
        "invalid_citations",
        sorted_numbers(F.filter(F.array_union(inline, F.col("declared")), lambda n: ~number_within(n, F.col("passages")))),
    )
    cleaned = checked.withColumn(
        "text",
        F.when(F.size("invalid_citations") == 0, F.col("raw_text")).otherwise(
            strip_citations(F.col("raw_text"), F.col("invalid_citations"))
        ),
    )
    every = F.concat(citation_numbers(F.col("text")), F.col("declared"))
    given = F.transform(F.filter(every, lambda n: number_within(n, F.col("passages"))), lambda n: n.cast("bigint"))
    return cleaned.select(
        "query_id",
        "text",
        F.array_distinct(given).alias("citations"),
        "invalid_citations",
        "refused",
        "conflict",
        (F.size("invalid_citations") == 0).alias("grounded"),
        "error",
    )


def resolve(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, place, number, label, doc_id: each citation with the passage it points at."""
    cited = answers.select("query_id", F.posexplode(F.col("citations").cast("array<int>")).alias("place", "number"))
    passages = hits.select(
        "query_id",
        F.col("rank").alias("number"),
        "doc_id",
        citation_label(F.col("doc_title"), F.col("section")).alias("named"),
        "source_path",
    )
    return cited.join(passages, ["query_id", "number"]).select(
        "query_id",
        "place",
        "number",
        F.concat(
            F.lit("["), F.col("number"), F.lit("] "), F.col("named"), F.lit(" ("), F.col("source_path"), F.lit(")")
        ).alias("label"),
        "doc_id",
    )


def cited_documents(resolved: DataFrame) -> DataFrame:
    """query_id, cited_documents: distinct documents in the order of first citation."""
    return resolved.groupBy("query_id").agg(
        F.array_distinct(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda c: c["doc_id"])
        ).alias("cited_documents")
    )
