"""Mixing sources to target weights: how many words of each document a weighted mix takes.

Every document gets a hash-random key. The documents are range-sorted by (source, key); running sums
of their word counts over that order, found by partition, say where each source's exact budget ends.
A source whose budget exceeds its size is repeated whole as often as it fits, then once more up to
the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.frames import running_sum, unused, word_count, words
from citeloom.sources.scratch import staged

#: Weights of the sources in code-point order, repeating; and how often a source may be repeated.
CYCLE = (1, 2, 3)
MOST = 3


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also ``weight`` and ``target`` (double), one row per source.

    All sizes together are shared by weight; a share stops at MOST times its source's size and what is
    above it is shared again among the others. With the sources sorted by size per weight the capped
    ones come first: each is capped if its cap is below its share of what the earlier ones left.
    The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(CYCLE)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (place + 1).cast("int")).cast("long"))
    whole = Window.partitionBy()
    earlier = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    left = weighted.select(
        "*",
        (F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))).alias("rest"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("shares"),
    )
    big = "decimal(38,0)"
    capped = F.col("source_size").cast(big) * MOST * F.col("shares").cast(big) < F.col("rest").cast(big) * F.col("weight").cast(big)
    marked = left.withColumn("capped", capped)
    level = F.max_by(F.struct("rest", "shares"), F.when(~F.col("capped"), F.col("shares"))).over(whole)
    return marked.withColumn("level", level).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("capped"), (F.col("source_size") * MOST).cast("double"))
        .otherwise(F.col("level.rest").cast("double") * F.col("weight") / F.col("level.shares"))
        .alias("target"),
    )


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, source -> doc_id, source, size, source_size, target, taken, one row per input row.

    ``keep`` names further columns of the input to carry along.
    A null text has size 0 and gives 0 words; a null source is a source of its own, sorted last; null
    ids sort as the empty string; equal rows are told apart by the sort, and give the same set of
    results whichever comes first. Other columns are ignored. An empty table gives an empty table.
    """
    sized = staged(
        docs.select(
            *keep,
            "doc_id",
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        ),
        "sizes",
    )
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    # Where a source begins in the order over all documents.
    begins = Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("begins", F.coalesce(F.sum("source_size").over(begins), F.lit(0)))
    order = [F.col("source").asc_nulls_first(), F.col("key"), F.col("doc_id"), F.col("size")]
    placed = running_sum(sized, order, {"before": "size"}).withColumnRenamed("source", "own")
    joined = placed.join(sources, F.col("own").eqNullSafe(F.col("source")), "left")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before") - F.col("begins"))))
    return joined.select(
        *keep,
        "doc_id",
        F.col("own").alias("source"),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + cut).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in the columns of ``docs``.

    A document taken in part comes once more with its first words, joined by single spaces. Documents
    of which nothing is taken go; so do those without words. ``n_chars`` follows the text. Other columns may
    have any names and are left as they are.
    """
    row, size, taken, copy = unused(docs, "_row", "_size", "_taken", "_copy")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    narrow = numbered.select(row, "doc_id", "source", "text")
    share = mix(narrow, keep=(row,)).where("taken > 0").select(row, F.col("size").alias(size), F.col("taken").alias(taken))
    joined = numbered.join(share, row)
    whole = F.floor(F.col(taken) / F.greatest(size, F.lit(1))).cast("int")
    part = (F.col(taken) - whole * F.col(size)).cast("int")
    cut = F.when(part > 0, F.concat_ws(" ", F.slice(words(F.col("text")), 1, F.greatest(part, F.lit(1)))))
    texts = F.filter(F.concat(F.array_repeat("text", whole), F.array(cut)), lambda t: t.isNotNull())
    copies = joined.withColumn(copy, F.explode(texts))
    return copies.select(*[
        F.col(copy).alias("text") if c == "text" else F.length(copy).cast("long").alias(c) if c == "n_chars" else c
        for c in docs.columns
    ])


SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
weighted AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
lefts AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER earlier, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS shares
  FROM weighted
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 3 * source_size * shares < rest * weight AS capped FROM lefts),
level AS (SELECT rest, shares FROM marked WHERE NOT capped ORDER BY shares DESC LIMIT 1),
goals AS (
  SELECT m.source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(l.rest AS DOUBLE) * weight / CAST(l.shares AS DOUBLE) END AS target
  FROM marked m, level l),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized),
budgets AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, p.before, CAST(floor(g.target) AS BIGINT) AS budget,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END AS epochs
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM budgets
"""
