"""Stored vectors and orderings, and the results file."""

from __future__ import annotations

import json
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import metrics
from citeloom.settings import COHORTS
from citeloom.sources import files
from citeloom.sources.tables import read_stored

VECTOR_SCHEMA = "key string, vector array<float>"
ORDERING_SCHEMA = "model string, prompt string, question string, candidates array<string>, `order` array<int>"


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return read_stored(spark, path, schema)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """key, vector; an absent cache is an empty one."""
    return _read_or_empty(spark, path, VECTOR_SCHEMA)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Only rows that were missing are appended; the commit of the job makes them visible at once."""
    vectors.select("key", F.col("vector").cast("array<float>").alias("vector")).write.mode("append").parquet(path)


def read_orderings(spark: SparkSession, path: str) -> DataFrame:
    """Stored orderings, one JSON object per file; the file name is the key. Bad files are absent."""
    try:
        files = spark.read.schema(ORDERING_SCHEMA).json(path, multiLine=True, mode="PERMISSIVE")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, " + ORDERING_SCHEMA)
    key = F.regexp_extract(F.col("_metadata.file_name"), r"\A(.*)\.json\z", 1)
    return files.select(key.alias("key"), "model", "prompt", "question", "candidates", "order").where(
        F.col("order").isNotNull()
    )


def read_ordering_table(spark: SparkSession, path: str) -> DataFrame:
    """key, model, prompt, question, candidates, order; an absent cache is an empty one.

    Of several rows with one key, any is as good as another; one is kept.
    """
    return _read_or_empty(spark, path, "key string, " + ORDERING_SCHEMA).dropDuplicates(["key"])


def append_orderings(orderings: DataFrame, path: str) -> None:
    columns = ["key", "model", "prompt", "question", "candidates", "order"]
    orderings.select(*columns).write.mode("append").parquet(path)


def results_payload(
    retrieval: DataFrame,
    answers: DataFrame,
    questions: DataFrame,
    k: int,
    generation_model: str,
    embedding_model: str,
    reranker: dict | None = None,
) -> dict:
    """The metrics of one full run with what is needed to read them.

    retrieval: results of every mode with a ``mode`` column; answers: answer results. Only grouped
    rows reach the driver.
    """
    table = {(r["mode"], r["axis"], r["value"]): r for r in metrics.retrieval_breakdown(retrieval).collect()}
    names = ("questions", *metrics.RETRIEVAL_METRICS)

    def line(mode: str, axis: str, value: str) -> dict:
        row = table.get((mode, axis, value))
        return {n: (row[n] if row is not None else 0 if n == "questions" else 0.0) for n in names}

    counts = metrics.question_counts(questions).orderBy("type").collect()
    total = metrics.answer_summary(answers).first().asDict()
    return {
        "generated_on": date.today().isoformat(),
        "generation_model": generation_model,
        "embedding_model": embedding_model,
        "reranker": reranker or {"enabled": False},
        "top_k": k,
        "golden_set": {
            "questions": sum(r["questions"] for r in counts),
            "by_type": {r["type"]: r["questions"] for r in counts},
            "answerable": sum(r["answerable"] for r in counts),
        },
        "retrieval": {mode: line(mode, "all", "all") for mode in sorted({m for m, _, _ in table})},
        "retrieval_by_cohort": {c: line("hybrid", "cohort", c) for c in COHORTS},
        "answers": total if total["questions"] else {},
    }


def write_results(payload: dict, path: str) -> str:
    """Write to any file system that Spark knows; the path comes back."""
    files.write_text(SparkSession.active(), path, json.dumps(payload, indent=2) + "\n")
    return path


def read_results(path: str) -> dict | None:
    """The last results, or None where there are none or they cannot be read."""
    try:
        return json.loads(files.read_text(SparkSession.active(), path))
    except (FileNotFoundError, json.JSONDecodeError):
        return None
