"""Files to documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, normalise, title

# --- fixed values: supported file types ---
_FILE_GLOB = "*.{[mM][dD],[tT][xX][tT]}"
_NAME = r"(?s)\A(.*)\.([^.]*)\z"


def load_documents(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, title, source_path, fmt, text of every .md and .txt file directly in ``directory``.

    ``doc_id`` is the file name without its suffix. Files without content are left out. As with
    every Spark file source, names that begin with a dot or an underscore are not listed.
    """
    try:
        raw = spark.read.text(directory, wholetext=True, pathGlobFilter=_FILE_GLOB)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"documents directory not found: {directory}") from error
        raise
    documents = structured(raw.select(F.col("_metadata.file_name").alias("source_path"), F.col("value").alias("raw")))
    if documents.isEmpty():
        raise ValueError(f"no .md or .txt files with content in {directory}")
    return documents


def structured(files: DataFrame) -> DataFrame:
    """(source_path, raw) to documents: a map-only projection, usable on any table of file contents."""
    name = F.col("source_path")
    stem = F.when(F.rlike(name, F.lit(_NAME)), F.regexp_extract(name, _NAME, 1)).otherwise(name)
    suffix = F.lower(F.regexp_extract(name, _NAME, 2))
    # Decided on the raw content: a filter on the normalised text would be pushed down with it, and
    # every file would be normalised twice.
    filled = files.where(~is_blank(F.ltrim(F.col("raw"), F.lit("\ufeff"))))
    named = filled.select(
        stem.alias("doc_id"),
        "source_path",
        F.when(suffix == "md", "markdown").otherwise("text").alias("fmt"),
        normalise(F.col("raw")).alias("text"),
    )
    return named.select(
        "doc_id",
        title(F.col("text"), F.col("fmt"), F.col("doc_id")).alias("title"),
        "source_path",
        "fmt",
        "text",
    )
