"""Inputs of the registered queries, all derived from the given tables (whole tables, whole texts).

The tables hold no headings, pipe tables, citation markers or model responses, so these are built
from their rows; ``oracle.py`` builds the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import sentences
from citeloom.operators import bm25, containment, knn
from citeloom.operators.chunking import chunk_documents
from citeloom.operators.joins import with_content
from citeloom.settings import POOL
from citeloom.sources.documents import structured
from citeloom.sources.scratch import staged
from citeloom.sources.tables import read_spread, read_table

MODEL = "model-a"
PROMPT = "Order the passages by how well each answers the question."
PASSAGES = 5


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_spread(spark, folder, "documents", *columns)


def notes_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a text file: BOM, CRLF, numbered headings, an indented table, a remark."""
    body = F.concat(
        F.lit("\ufeffNOTE "), F.col("doc_id"), F.lit("\n\n1. BODY\n\n"), F.col("text"),
        F.lit("\n\n2.1 ORIGIN\n\nThe origin is listed below.\n\n  source    "), F.col("source"),
        F.lit("\n  language  "), F.col("lang"), F.lit("\n\n3. EMPTY\n\n4. REMARK\n\nLength is "),
        F.col("n_chars"), F.lit(" characters.\n"),
    )
    return documents(spark, folder).select(
        F.concat(F.lit("note-"), F.col("doc_id"), F.lit(".TXT")).alias("source_path"),
        F.replace(body, F.lit("\n"), F.lit(" \r\n")).alias("raw"),
    )


def orders_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a markdown file whose fields are a pipe table under a short paragraph."""
    text = F.concat(
        F.lit("# Order "), F.col("o_orderkey"), F.lit("\n\nReference ORD-"), F.col("o_orderstatus"),
        F.lit("-"), F.col("o_orderkey"), F.lit(" for customer "), F.col("o_custkey"),
        F.lit(".\n\n## 1. Priority\n\nHandled as "), F.col("o_orderpriority"),
        F.lit(".\n# Not a section\nSee clause 2.\n\n## 2. Fields\n\nThe fields of this order follow.\n\n"),
        F.lit("| field | value |\n|---|---|\n| key | "), F.col("o_orderkey"),
        F.lit(" |\n| customer | "), F.col("o_custkey"), F.lit(" |\n| status | "), F.col("o_orderstatus"),
        F.lit(" |\n| price | "), F.floor("o_totalprice"), F.lit(" |\n\nPrices are rounded. (Fields are final.)"),
    )
    return read_spread(spark, folder, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey"), F.lit(".md")).alias("source_path"), text.alias("raw")
    )


def note_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_documents(structured(notes_raw(spark, folder)))


def order_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_documents(structured(orders_raw(spark, folder)))


def plain_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as they are, titled by their source."""
    return chunk_documents(
        documents(spark, folder).select(
            "doc_id",
            F.col("source").alias("title"),
            F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("source_path"),
            F.lit("text").alias("fmt"),
            "text",
        )
    )


# --- questions ---------------------------------------------------------------------------------


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, question: the benchmark texts."""
    return read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def holders(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, doc_id: documents that hold a benchmark text literally, all of them."""
    asked = questions(spark, folder).select(F.col("query_id").alias("short_id"), F.col("question").alias("short"))
    texts = documents(spark, folder, "doc_id", "text").withColumnRenamed("doc_id", "text_id")
    found = containment.holders(texts, asked)
    # Few and narrow, but a pass over all documents: written once for all that use them.
    return staged(found.select(F.col("short_id").alias("query_id"), F.col("text_id").alias("doc_id")), "holders")


def golden(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Questions whose type follows from the labels of the documents that hold their text, and
    (query_id, doc_id) of those documents. A question knows their number, ``expected``, not their names."""
    labels = read_table(spark, folder, "labels")
    held = holders(spark, folder)
    expected = (
        held.join(labels, "doc_id", "left")
        .groupBy("query_id")
        .agg(
            F.count_distinct("doc_id").alias("expected"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
            F.coalesce(F.bool_or(F.col("quality") == 0), F.lit(False)).alias("poor"),
        )
    )
    answerable = F.col("expected") > 0
    kind = (
        F.when(~answerable, "unanswerable")
        .when(F.col("toxic"), "contradiction")
        .when(F.col("poor"), "underspecified")
        .when(F.col("expected") > 1, "multi_hop")
        .otherwise("factual")
    )
    none = F.array().cast("array<string>")
    asked = (
        questions(spark, folder)
        .join(expected, "query_id", "left")
        .withColumn("expected", F.coalesce("expected", F.lit(0)))
        .select(
            "query_id",
            kind.alias("type"),
            "question",
            "expected",
            F.when(answerable, F.split("question", " ")).otherwise(none).alias("expected_facts"),
            F.lit("").alias("expected_answer"),
            F.when(F.substring("question", 1, 1) < "N", "prose").otherwise("code").alias("phrasing"),
            F.when(answerable, sentences(F.col("question"))).otherwise(none).alias("anchors"),
            F.when(F.length("question") % 2 == 0, "original").otherwise("extended").alias("cohort"),
        )
    )
    return asked, held


# --- ranked lists ------------------------------------------------------------------------------


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")
    )


def question_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """An artificial pairing: a question takes the vector with its number."""
    return questions(spark, folder).join(
        vectors(spark, folder).withColumnRenamed("chunk_id", "query_id"), "query_id"
    ).select("query_id", "vector")


def keyword_hits(spark: SparkSession, folder: str, k: int = POOL) -> DataFrame:
    index = bm25.build(documents(spark, folder, "doc_id", "text"), "doc_id", "text", keep_postings=True)
    return bm25.search(index, questions(spark, folder), k)


def vector_hits(spark: SparkSession, folder: str, k: int = POOL) -> DataFrame:
    return knn.exact_topk(vectors(spark, folder), question_vectors(spark, folder), k)


def payload(spark: SparkSession, folder: str) -> DataFrame:
    """What a passage shows."""
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("Document "), F.col("doc_id")).alias("doc_title"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("section"),
        F.concat(F.col("source"), F.lit(".txt")).alias("source_path"),
        "text",
    )


def with_documents(spark: SparkSession, folder: str, hits: DataFrame) -> DataFrame:
    """Add what a passage shows. The ranked lists are small, so only their texts are fetched."""
    return with_content(payload(spark, folder), hits)


# --- model responses ---------------------------------------------------------------------------


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as an answer response, with markers, odd members and broken JSON."""
    conv, turn = F.col("conv_id"), F.col("turn")
    marked = F.concat(
        F.replace(F.col("text"), F.lit(". "), F.concat(F.lit(" ["), turn + 1, F.lit("]. "))),
        F.lit(" ["), conv % 9, F.lit("] ."),
    )
    head = F.to_json(F.struct(marked.alias("answer")))
    numbers = (
        F.when(conv % 4 == 0, F.concat(F.lit("["), turn, F.lit(", 3, 9]")))
        .when(conv % 4 == 1, '["2", 1, true, 7]')
        .when(conv % 4 == 2, "[]")
        .otherwise(F.concat(F.lit("[1.5, 4, "), turn, F.lit(", null]")))
    )
    refused = (
        F.when(conv % 5 == 0, ', "refused": true')
        .when(conv % 5 == 1, ', "refused": "false"')
        .when(conv % 5 == 2, ', "refused": 0')
        .when(conv % 5 == 3, ', "refused": null')
        .otherwise("")
    )
    conflict = F.when(turn % 2 == 0, ', "conflict": true}').otherwise(', "conflict": false}')
    whole = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(', "citations": '), numbers, refused, conflict,
    )
    return read_table(spark, folder, "conversations").select(
        F.concat(conv, F.lit("-"), turn).alias("query_id"),
        F.lit(PASSAGES).alias("passages"),
        F.when((conv + turn) % 11 == 7, F.concat(F.lit("sorry: "), F.col("text")))
        .when((conv + turn) % 11 == 8, "[1, 2]")
        .when((conv + turn) % 11 == 9, " ")
        .otherwise(whole)
        .alias("response"),
    )


def response_questions(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, type, expected_facts for every conversation turn."""
    words = F.split("text", " ")
    kind = F.element_at(
        F.array(*[F.lit(t) for t in ("factual", "multi_hop", "contradiction", "underspecified", "unanswerable")]),
        ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"),
    )
    none = F.array().cast("array<string>")
    return read_table(spark, folder, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("query_id"),
        kind.alias("type"),
        F.when(F.col("role") == "system", none)
        .otherwise(F.concat(words, F.array(F.lit("[1]"))))
        .alias("expected_facts"),
    )


def ranking_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as a ranking response over six candidates."""
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.concat(
        F.lit('{"ranking": ['), conv % 7 + 1, F.lit(", "), turn, F.lit(", "), conv % 7 + 1,
        F.lit(', true, "2", 2.5, 0, '), (conv + turn) % 6 + 1, F.lit("]}"),
    )
    return read_table(spark, folder, "conversations").select(
        F.concat(conv, F.lit("-"), turn).alias("key"),
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: i.cast("string")).alias("candidates"),
        text.alias("response"),
    )


def error_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a service error message."""
    e, seconds = F.col("event_id"), F.col("user_id")
    text = (
        F.when(e % 6 == 0, F.concat(F.lit("429 RESOURCE_EXHAUSTED {'retryDelay': '"), seconds, F.lit("s'}")))
        .when(e % 6 == 1, F.concat(F.lit("Please Retry in "), seconds, F.lit(".25s")))
        .when(e % 6 == 2, "404 model not found")
        .when(e % 6 == 3, F.concat(F.lit("INVALID_ARGUMENT 429 "), F.col("event_type")))
        .when(e % 6 == 4, F.concat(F.lit("503 unavailable "), F.col("event_type")))
        .otherwise(F.concat(F.lit("400 bad "), F.col("props")))
    )
    return read_table(spark, folder, "events").select("event_id", text.alias("message"))
