"""What a passage shows, as a table bucketed by chunk id.

Ranked lists name few of very many chunks. Where their ids are at most MAX_NAMED, the table is asked for just
those: Spark then reads only the buckets that can hold them, and of these the row groups, as rows are sorted by
id. Longer lists meet the table in a join that does not shuffle it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.scratch import staged

BUCKETS = 64
#: Ids that a plan may name one by one.
MAX_NAMED = 5_000


def write(content: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Store content(chunk_id, ...) as the table ``table`` of the session's catalog."""
    content.repartition(buckets, "chunk_id").write.bucketBy(buckets, "chunk_id").sortBy("chunk_id").mode("overwrite").saveAsTable(table)


def fetched(spark: SparkSession, table: str, hits: DataFrame) -> DataFrame:
    """Ranked lists with the content of their chunks; a chunk that is not stored leaves its row out."""
    hits, content = staged(hits, "lists"), spark.table(table)
    named = hits.select("chunk_id").distinct().limit(MAX_NAMED + 1).toArrow()["chunk_id"].to_pylist()
    if len(named) > MAX_NAMED:
        return content.join(hits, "chunk_id")
    # One row for each id named: their texts are sent to the lists.
    return F.broadcast(content.where(F.col("chunk_id").isin(named))).join(hits, "chunk_id")
