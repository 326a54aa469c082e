"""A stream of questions against a fixed index, one micro-batch at a time.

Each micro-batch is an ordinary batch of questions, so the lists are the same as in batch. The index
does not change within a query; state between batches is not needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.plans.retrieval import Retriever
from citeloom.sources.scratch import released, staged


def retrieve_stream(
    questions: DataFrame, retriever: Retriever, output: str, checkpoint: str, k: int | None = None, mode: str = "hybrid"
) -> StreamingQuery:
    """questions(query_id, question), streaming. Hits are appended to the parquet table ``output``.

    ``batch`` names the micro-batch. A batch that is repeated after a failure overwrites its own
    partition, so its rows appear once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        with released(batch.sparkSession):
            asked = staged(batch, "questions")
            found = retriever.retrieve(asked, k, mode).drop("vector").withColumn("batch", F.lit(number))
            found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)

    return (
        questions.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
