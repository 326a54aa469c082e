"""Prefix trie of conversations, with totals of every subtree.

Each conversation is rebuilt (its first turns come from the leader of its block), and every distinct
sequence of first turns is a node, named by its depth and a 128-bit hash of the sequence. A node's own
figures are one aggregation over all rebuilt turns. Its subtree's figures come by time-forward processing:
a node is visited after all nodes below it, and passes its totals to its parent through a priority queue.

A node is light if the conversations through it have at most SHARD_NODES turns at or below it, so that
its subtree is bounded. The topmost light nodes are shard roots: their subtrees are dealt into tasks, Spark
sorts each task's nodes by reverse level order (on disk where they do not fit), and the queue writes sorted
runs to a temporary file of the task when it grows. The totals of the shard roots are added up by parent, and the nodes
above, few and heavy, are processed in the same way in one more pass, by one task that holds a queue
and no table.

Positions in a conversation and the hashes of its beginnings are running counts and xors over range-sorted
rows, so a conversation of any length is many tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.frames import partitions
from citeloom.sources.scratch import staged

#: Conversations in a block, and the modulus of the number of turns that they share.
BLOCK = 5
SHARED = 9
#: Turns at or below a light node, at most.
SHARD_NODES = 50_000
#: Messages that a queue holds in memory before it writes a run.
QUEUE_ROWS = 100_000
RUN_ROWS = 1024
#: Rows that a broadcast may have.
MOST_HEAVY = 100_000


class SpillingQueue:
    """A priority queue of tuples. Beyond ``limit`` entries the heap is written as a sorted run and read back in order."""

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit = limit
        self.heap: list[tuple] = []
        #: First unread entry of each run, the rest of what was read of it, and the run.
        self.runs: list[tuple] = []

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for low in range(0, len(self.heap), RUN_ROWS):
                pickle.dump(self.heap[low : low + RUN_ROWS], run)
            run.seek(0)
            self.heap = []
            self._advance([], run, len(self.runs))

    def _advance(self, rest: list, run, number: int) -> None:
        if not rest:
            try:
                rest = pickle.load(run)[::-1]
            except EOFError:
                run.close()
                return
        heapq.heappush(self.runs, (rest.pop(), number, rest, run))

    def top(self) -> tuple | None:
        """The smallest entry, which stays."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, number, rest, run = heapq.heappop(self.runs)
            self._advance(rest, run, number)
            return entry
        return heapq.heappop(self.heap)


def within(frame: DataFrame, key: str, order: list[Column], xors: dict[str, str]) -> DataFrame:
    """Add ``place`` (from 1, in ``order`` within ``key``) and each ``name: value`` of ``xors``: the xor of ``value`` up to the row.

    Rows are range-sorted by key and order. A key that begins in an earlier range gets what that range and
    others before it hold of it: at most two (range, key) rows for each range.
    """
    ranged = staged(frame.repartitionByRange(partitions(frame.sparkSession), F.col(key), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    # A range can only go on with the first of its keys.
    first = F.broadcast(ranged.groupBy("_part").agg(F.min(key).alias(key)).select(key).distinct())
    spans = ranged.join(first, key).groupBy("_part", key).agg(F.count("*").alias("_n"), *[F.bit_xor(v).alias(f"_{name}") for name, v in xors.items()])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        "_part",
        key,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        *[F.coalesce(F.bit_xor(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in xors],
    )
    inside = Window.partitionBy("_part", key).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranged.withColumns({"place": F.row_number().over(inside).cast("long")} | {name: F.bit_xor(v).over(upto) for name, v in xors.items()})
    added = counted.join(F.broadcast(carried), ["_part", key], "left")
    added = added.withColumns(
        {"place": F.col("place") + F.coalesce("_n", F.lit(0))} | {name: F.col(name).bitwiseXOR(F.coalesce(F.col(f"_{name}"), F.lit(0))) for name in xors}
    )
    return added.drop("_part", "_n", *[f"_{name}" for name in xors])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, turn, role, text -> (conv_id, place, role, text) of the rebuilt conversations, and (conv_id, length) of every one."""
    read = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    placed = staged(within(read, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], {}), "placed")
    own = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED)).alias("own")
    leader = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("leader")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("turns"))
    convs = sizes.select("conv_id", "turns", own, leader)
    led = sizes.select(F.col("conv_id").alias("leader"), F.col("turns").alias("held"))
    convs = convs.join(led, "leader", "left").withColumn("begun", F.least("own", F.coalesce("held", F.lit(0))))
    convs = staged(convs.select("conv_id", "leader", "own", "begun", F.greatest(F.col("turns") - F.col("own"), F.lit(0)).alias("later")), "convs")
    # At most SHARED - 1 turns of a leader, for its block.
    heads = placed.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "leader")
    taken = convs.select("conv_id", "leader", "begun").join(heads, "leader").where(F.col("place") <= F.col("begun"))
    rest = placed.where(F.col("place") > 0).join(convs.select("conv_id", "own", "begun"), "conv_id").where(F.col("place") > F.col("own"))
    rest = rest.withColumn("place", F.col("place") - F.col("own") + F.col("begun"))
    columns = ["conv_id", "place", "role", "text"]
    return taken.select(columns).unionByName(rest.select(columns)), convs.select("conv_id", (F.col("begun") + F.col("later")).alias("length"))


def _joined_ids(ends: DataFrame) -> DataFrame:
    """p, q, depth, conv_id -> p, q, depth, ends_sha256, by streaming each node's sorted ids through the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []

        def flush():
            columns = zip(*done) if done else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["p", "q", "depth", "ends_sha256"])

        for part in batches:
            for p, q, depth, conv in zip(*(part.column(c).to_pylist() for c in ("p", "q", "depth", "conv_id"))):
                if (p, q, depth) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (p, q, depth), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            if len(done) >= 10_000:
                yield flush()
                done = []
        if node is not None:
            done.append((*node, digest.hexdigest()))
        yield flush()

    dealt = ends.repartition(partitions(ends.sparkSession), "p", "q", "depth").sortWithinPartitions("p", "q", "depth", "conv_id")
    return dealt.select("p", "q", "depth", "conv_id").mapInArrow(run, "p bigint, q bigint, depth bigint, ends_sha256 string")


_TOTALS = "p bigint, q bigint, depth bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, parent_p bigint, parent_q bigint, top boolean"


def _forward(nodes: DataFrame, limit: int = QUEUE_ROWS) -> DataFrame:
    """Nodes sorted by depth, deepest first, then p and q, each after its children -> totals of their subtrees.

    ``own``: what the node itself saves; ``children``, ``leaves``, ``saved``: what has been passed to it from
    elsewhere; ``top``: whether its parent is elsewhere. A message is (-depth, p, q, leaves, saved).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit)
        names = ["depth", "p", "q", "parent_p", "parent_q", "own", "children", "leaves", "saved", "top"]
        for part in batches:
            out = []
            for depth, p, q, parent_p, parent_q, own, children, leaves, saved, top in zip(*(part.column(c).to_pylist() for c in names)):
                saved += own
                while (first := queue.top()) is not None and first[:3] == (-depth, p, q):
                    message = queue.pop()
                    children, leaves, saved = children + 1, leaves + message[3], saved + message[4]
                leaves = leaves if children else 1
                out.append((p, q, depth, children, leaves, saved, parent_p, parent_q, top))
                if not top:
                    queue.push((1 - depth, parent_p, parent_q, leaves, saved))
            columns = list(zip(*out)) if out else [[]] * 9
            types = [*[pa.int64()] * 8, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _TOTALS.split(", ")])

    return nodes.mapInArrow(run, _TOTALS)


def _level_order(nodes: DataFrame) -> DataFrame:
    return nodes.sortWithinPartitions(F.desc("depth"), "p", "q")


def subtrees(nodes: DataFrame, paths: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Totals of every node of ``nodes`` (p, q, depth, parent_p, parent_q, conv_id, weight, own).

    ``paths``: (conv_id, depth, p, q) of every conversation's beginnings.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    heavy = staged(nodes.where(F.col("weight") > shard_nodes), "heavy")
    many = heavy.count()
    above = heavy.select("p", "q", "depth")
    above = F.broadcast(above) if many <= MOST_HEAVY else above
    # A light node's shard root is the first light node on its path: one below the deepest heavy one.
    deepest = paths.join(above, ["p", "q", "depth"]).groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    light = nodes.where(F.col("weight") <= shard_nodes).join(deepest, "conv_id", "left").withColumn("from", F.coalesce(F.col("deepest") + 1, F.lit(0)))
    roots = paths.select("conv_id", F.col("depth").alias("from"), F.col("p").alias("root_p"), F.col("q").alias("root_q"))
    light = light.join(roots, ["conv_id", "from"]).withColumn("top", F.col("depth") == F.col("from"))
    light = staged(light.select("p", "q", "depth", "parent_p", "parent_q", "own", "top", "root_p", "root_q"), "light")
    shards = max(partitions(nodes.sparkSession), math.ceil(light.count() / shard_nodes))
    dealt = _level_order(light.repartition(shards, "root_p", "root_q")).drop("root_p", "root_q")
    below = staged(_forward(dealt.select("*", *zero)), "below")
    passed = below.where("top").groupBy(F.col("parent_p").alias("p"), F.col("parent_q").alias("q"), (F.col("depth") - 1).alias("depth"))
    passed = passed.agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    top = heavy.join(passed, ["p", "q", "depth"], "left").na.fill(0, ["children", "leaves", "saved"]).withColumn("top", F.col("depth") == 0)
    top = top.select("p", "q", "depth", "parent_p", "parent_q", "own", "children", "leaves", "saved", "top")
    rest = _forward(_level_order(top.coalesce(1)))
    return below.unionByName(rest).select("p", "q", "depth", "n_children", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """conv_id, turn, role, text -> one row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id are left out. Null turns come first; equal turns are ordered by role and text, and
    repeated rows are turns of their own. Null role and text are read as ''. Other columns are ignored. An
    empty table has no conversation and gives no rows, not even a root.
    """
    rows, convs = rebuilt(turns)
    # The hash of a beginning is the xor of hashes of (place, role, text), twice for 128 bits.
    hashed = rows.select(
        "conv_id",
        "place",
        F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64("place", "role", "text").alias("a"),
        F.xxhash64(F.lit("second"), "place", "role", "text").alias("b"),
    ).withColumnRenamed("place", "depth")
    placed = within(hashed, "conv_id", [F.col("depth")], {"p": "a", "q": "b"}).drop("place")
    placed = placed.join(convs, "conv_id").withColumn("last", F.col("depth") == F.col("length"))
    placed = staged(placed.withColumn("below", F.col("length") - F.col("depth") + 1).drop("length"), "beginnings")
    parent = [F.col("p").bitwiseXOR(F.col("a")).alias("parent_p"), F.col("q").bitwiseXOR(F.col("b")).alias("parent_q")]
    nodes = (
        placed.select("p", "q", "depth", *parent, "conv_id", "bytes", "below")
        .groupBy("p", "q", "depth", "parent_p", "parent_q")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum("below").alias("weight"))
        .withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
    )
    none = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    root = root.select(*[none.alias(c) for c in ("p", "q", "depth", "parent_p", "parent_q")], "conv_id", "n_convs", none.alias("bytes"), "weight", none.alias("own"))
    nodes = staged(nodes.unionByName(root), "nodes")
    beginnings = placed.select("conv_id", "depth", "p", "q").unionByName(convs.select("conv_id", none.alias("depth"), none.alias("p"), none.alias("q")))
    totals = subtrees(nodes, beginnings, shard_nodes)
    empty = convs.where("length = 0").select(none.alias("p"), none.alias("q"), none.alias("depth"), "conv_id")
    ends = _joined_ids(placed.where("last").select("p", "q", "depth", "conv_id").unionByName(empty))
    # Children of heavy nodes may be very many, but heavy nodes are few; light ones have a bounded number.
    up = nodes.select(F.col("p").alias("parent_p"), F.col("q").alias("parent_q"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), "weight")
    child = nodes.drop("weight", "own", "bytes")
    heavy = up.where(F.col("weight") > shard_nodes).drop("weight")
    heavy = F.broadcast(heavy) if heavy.count() <= MOST_HEAVY else heavy
    child = child.join(heavy.withColumnRenamed("parent_conv_id", "of_heavy"), ["parent_p", "parent_q", "depth"], "left")
    light = up.where(F.col("weight") <= shard_nodes).drop("weight")
    left = child.where("of_heavy IS NULL").drop("of_heavy").join(light, ["parent_p", "parent_q", "depth"], "left")
    named = left.unionByName(child.where("of_heavy IS NOT NULL").withColumnRenamed("of_heavy", "parent_conv_id"))
    whole = named.join(totals, ["p", "q", "depth"]).join(ends, ["p", "q", "depth"], "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {BLOCK} AS leader, count(*) AS turns,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % {SHARED} AS h
  FROM placed GROUP BY conv_id),
taken AS (
  SELECT c.conv_id, c.h, least(c.h, coalesce(l.turns, 0)) AS begun FROM convs c LEFT JOIN convs l ON l.conv_id = c.leader),
rows AS (
  SELECT c.conv_id, p.place, role, text FROM convs c JOIN placed p ON p.conv_id = c.leader WHERE p.place <= c.h
  UNION ALL
  SELECT conv_id, place - h + begun, role, text FROM placed JOIN taken USING (conv_id) WHERE place > h),
beginnings AS (
  SELECT conv_id, place AS depth, strlen(text) AS bytes,
         sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY place)) AS node FROM rows
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
longest AS (SELECT conv_id, max(depth) AS length FROM beginnings GROUP BY conv_id),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE max(bytes) END AS own,
         coalesce(string_agg(CASE WHEN length = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM beginnings JOIN longest USING (conv_id) GROUP BY depth, node),
parents AS (
  SELECT n.depth, n.node, b.node AS parent FROM nodes n JOIN beginnings b ON b.conv_id = n.conv_id AND b.depth = n.depth - 1),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM parents GROUP BY ALL),
totals AS (
  SELECT b.depth, b.node, sum(own) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes n JOIN beginnings b ON b.conv_id = n.conv_id AND b.depth <= n.depth
  LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node GROUP BY b.depth, b.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN totals t ON t.depth = n.depth AND t.node = n.node
LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
LEFT JOIN parents p ON p.depth = n.depth AND p.node = n.node
LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.node = p.parent
"""
