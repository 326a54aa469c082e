"""The corpus pipeline: quality, near duplicates, repeated passages, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the
shared folder and reads again for the next one. All but the last return the columns of documents. No stage
needs a column besides doc_id, text and source; others are carried along, whatever their names. An empty table
stays empty through all of them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import chosenpath, mixing, pieces, quality, substring
from citeloom.llm.frames import prepare, unused
from citeloom.llm.queries import MODEL
from citeloom.sources.scratch import released, remove, shared_folder
from citeloom.sources.tables import read_table


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged by their statistics like all others, whole texts however long. Equal rows
    and rows without an id are judged alike. Without usable labels every score is 0.5, and all stay.
    """
    prepare(spark)
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the five-word shingles of both) the document of the smallest id stays.

    Null texts and texts without words are one group. Rows that repeat the id that stays all stay. Rows without an
    id are one by that: they all stay if one of them is in no group with an id, and go otherwise. Sets are made of whole texts and confirmed in full.

    Pairs to confirm come from SimHash fingerprints of the shingles (operator 2) and, as most near copies are further
    apart than its 2 bits, from the chosen-path join.
    """
    prepare(spark)
    return chosenpath.kept_of_each(docs, SHINGLE, by_simhash=True)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too go; documents of which no word is left go with them.

    A text of which something goes is its remaining words joined by single spaces; others stay as they are, null and
    empty ones too. Rows without an id lose nothing, and rows that repeat an id do not repeat each other.
    """
    prepare(spark)
    words, removed, kept = unused(docs, "words", "removed", "kept")
    left = substring.without_repeats(docs, (words, removed, kept))
    text = F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))
    whole = left.where((F.col(removed) < F.col(words)) | (F.col(removed) == 0))
    size = F.when(F.col(removed) > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return whole.withColumns({"text": text, "n_chars": size}).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the weighted mix of their sources takes them.

    A document cut short is its first words joined by single spaces. Null texts and texts without words have size 0
    and go. A null source is a source of its own. Equal rows are taken one by one.
    """
    prepare(spark)
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to; other columns stay, ``text`` does not.

    A null or empty text has no ids and decodes to an empty one. Each row is encoded by itself, however long.
    """
    prepare(spark)
    vocabulary = pieces.broadcast_model(spark, public_tokenizers.path(MODEL))
    keep = [c for c in docs.columns if c != "text"]
    return pieces.round_trip(docs, vocabulary, "text", *keep)


#: Words of a shingle in the near-copy stage.
SHINGLE = 5

STAGES = [
    ("quality classifier", accept),
    ("near-dedup on five-word shingles", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenise),
]

#: Tree scores, near copies and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
