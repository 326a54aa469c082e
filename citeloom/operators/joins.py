"""Ranked lists and the content of their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.sources.scratch import staged

#: Rows of a ranked list that may be sent to every task: about 100 bytes each.
MAX_SENT_HITS = 500_000


def with_content(content: DataFrame, hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ranked lists with the content of their chunks.

    The lists are written and counted; up to MAX_SENT_HITS rows go to every task and the texts stay
    where they are. Longer lists meet the texts in a shuffled join.
    """
    hits = staged(hits, "lists")
    few = hits.limit(MAX_SENT_HITS + 1).count() <= MAX_SENT_HITS
    return content.join(F.broadcast(hits) if few else hits, key)
