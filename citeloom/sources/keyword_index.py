"""The keyword index as stored tables: the postings of each chunk, the vocabulary, the corpus statistics.

Postings are kept by chunk, so a search scores chunks where they lie and every task hands on its k best
per question; terms that no question asks for are dropped as a batch is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators import bm25
from citeloom.settings import POOL
from citeloom.sources.tables import read_stored


def write(index: bm25.Bm25Index, path: str) -> None:
    rows = index.chunks if "terms" in index.chunks.columns else bm25.postings(index.chunks)
    rows.write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    stats = index.stats
    index.terms.sparkSession.createDataFrame(
        [(stats.n, stats.avgdl, stats.mean_idf)], "n bigint, avgdl double, mean_idf double"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


class KeywordIndex:
    """A stored index."""

    def __init__(self, postings: DataFrame, terms: DataFrame, stats: bm25.CorpusStats):
        self.postings, self.terms, self.stats = postings, terms, stats

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "KeywordIndex":
        row = read_stored(spark, f"{path}/stats").first()
        stats = bm25.CorpusStats(row["n"], row["avgdl"], row["mean_idf"])
        return cls(read_stored(spark, f"{path}/postings"), read_stored(spark, f"{path}/terms"), stats)

    def search(self, questions: DataFrame, k: int = POOL, query_id: str = "query_id", text: str = "question") -> DataFrame:
        return bm25.search(bm25.Bm25Index(self.postings, self.terms, self.stats), questions, k, query_id, text)
