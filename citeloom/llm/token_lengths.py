"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Documents are counted by encoded length (pre-aggregated in the map tasks). The suffix sums over the
histogram, in descending order of length, say how many documents and tokens lie beyond every context
limit, so totals, quantiles and truncated totals for any limit need no further pass over texts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import running_sum
from citeloom.llm.pieces import lengths


def histogram(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """``text`` -> n_tokens, n_docs: how many texts have each encoded length. Null and empty texts have 0."""
    return lengths(docs, vocabulary, "text").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counted: DataFrame) -> DataFrame:
    """n_tokens, n_docs -> one row per length, seen as a context limit.

    docs_longer, tokens_longer: of the documents above the limit; docs_total, tokens_total: of all;
    tokens_kept: all tokens if each document is cut at the limit; share_within: documents that fit.
    An empty histogram gives no rows.
    """
    sized = counted.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    totals = sized.agg(F.sum("n_docs").alias("docs_total"), F.sum("tokens").alias("tokens_total"))
    after = running_sum(sized, [F.col("n_tokens").desc()], {"docs_longer": "n_docs", "tokens_longer": "tokens"})
    return after.join(F.broadcast(totals)).select(  # totals: one row
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_kept"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("share_within"),
    )


def truncated_totals(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """Suffix sums -> limit, docs_cut, tokens_kept for any limits, also such as no document has.

    The shortest length above a limit has all that is cut in its suffix; no row of it, nothing is cut.
    """
    limits = sorted(set(limits))
    row = F.struct("n_docs", "docs_longer", "tokens_longer", "n_tokens")
    found = sums.agg(
        F.max("tokens_total").alias("total"),
        *[F.min_by(row, F.when(F.col("n_tokens") > c, F.col("n_tokens"))).alias(f"at_{c}") for c in limits],
    )

    def answer(c: int):
        at = F.col(f"at_{c}")
        cut = F.coalesce(at.n_docs + at.docs_longer, F.lit(0))
        over = F.coalesce(at.n_docs * at.n_tokens + at.tokens_longer, F.lit(0))
        return F.struct(F.lit(c).cast("long").alias("limit"), cut.alias("docs_cut"), (F.col("total") - over + cut * c).alias("tokens_kept"))

    return found.select(F.explode(F.array(*map(answer, limits))).alias("x")).select("x.*")


def quantiles(sums: DataFrame, shares: Iterable[float]) -> DataFrame:
    """Suffix sums -> share, n_tokens: the shortest length within which that share of documents lies."""
    shares = sorted(set(shares))
    found = sums.agg(*[F.min(F.when(F.col("share_within") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)])
    rows = [F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)]
    return found.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
