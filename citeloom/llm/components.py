"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import checkpointed

#: A star round at least halves the depth of a component; this many is out of reach.
ROUNDS = 100


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and the node.

    ``both``: larger neighbours of every node (large star); else smaller ones and the node (small star).
    The minimum is pre-aggregated; a node with very many links is split by the adaptive join.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    down = links.select(high.alias("u"), low.alias("v"))
    sides = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = sides.join(least, "u")
    if both:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any comparable ids -> (node, root): each linked node with the smallest id reachable.

    Nodes without a link to another do not appear. Each round is cut off by a checkpoint.
    """
    now = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = _digest(now)
    for _ in range(ROUNDS):
        now = checkpointed(_stars(_stars(now, both=True), both=False))
        before, digest = digest, _digest(now)
        if digest == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
