"""The registered queries of this package, one per operator, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import chosenpath, crosspolytope, divergence, licenses, mixing, multiset, pieces, prefixtrie, quality, simhash, substring, token_lengths, toxicity
from citeloom.llm.frames import prepare
from citeloom.sources.scratch import staged
from citeloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {"op1_mix_sources": mixing.SQL, "op10_substring_dedup": substring.SQL, "op11_source_divergence": divergence.SQL, "op12_chosen_path": chosenpath.SQL, "op13_conversation_trie": prefixtrie.SQL}
MODEL = "piece_bpe_32k.model"


def query(function: Query) -> Query:
    @wraps(function)
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return function(spark, folder)

    REGISTRY[function.__name__] = shipped
    return shipped


@query
def op1_mix_sources(spark, folder):
    mix = mixing.mix(read_table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_simhash_dedup(spark, folder):
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


@query
def op3_license_scan(spark, folder):
    return licenses.scan(read_table(spark, folder, "documents"))


@query
def op4_token_lengths(spark, folder):
    vocabulary = pieces.broadcast_model(spark, public_tokenizers.path(MODEL))
    # One row per length; written once, as its sort would encode the texts a second time to sample ranges.
    lengths = staged(token_lengths.histogram(read_table(spark, folder, "documents"), vocabulary), "lengths")
    return token_lengths.suffix_sums(lengths)


@query
def op5_document_fingerprints(spark, folder):
    return multiset.edited(read_table(spark, folder, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query
def op6_nearest_neighbours(spark, folder):
    vectors = read_table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")
    return crosspolytope.nearest(vectors, F.col("vec_id") % 100 == 0, k=10)


@query
def op7_sentencepiece(spark, folder):
    vocabulary = pieces.broadcast_model(spark, public_tokenizers.path(MODEL))
    encoded = pieces.round_trip(read_table(spark, folder, "documents"), vocabulary, "text", "doc_id")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_quality(spark, folder):
    return quality.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op9_toxicity(spark, folder):
    return toxicity.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op10_substring_dedup(spark, folder):
    left = substring.without_repeats(read_table(spark, folder, "documents").select("doc_id", "text"))
    return left.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256")
    )


@query
def op11_source_divergence(spark, folder):
    return divergence.audit(read_table(spark, folder, "documents"))


@query
def op12_chosen_path(spark, folder):
    copies = chosenpath.near_copies(read_table(spark, folder, "documents"))
    return copies.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query
def op13_conversation_trie(spark, folder):
    return prefixtrie.trie(read_table(spark, folder, "conversations"))
