"""Chosen-path similarity join: near copies by the Jaccard similarity of their sets of word shingles.

Every tree sends a set down several branches: at each node those of its shingles that are smallest under
the hash of that tree and level (BRANCHES of them), so that similar sets mostly choose the same. All sets that come
to a node together are compared there if they are few; larger nodes branch again. Independent trees are repeated
until a pair of the least similarity is missed with a chance of about (1 - 0.9974 ^ level) ^ TREES: 7e-6 at the
first level, 3e-5 at the second (0.9974: the chance that two sets of similarity 0.8 share one of their 3 smallest
shingles). More similar pairs are missed less often.

What is compared how:

- Nodes of up to LEAF sets: by sketches (the smallest hash of each of BINS bins), which must agree in LEAST_ALIKE of
  the bins, five to six standard deviations below what similarity 0.8 gives. What passes is confirmed on the full sets,
  first along a spanning forest of the most alike pairs of a node; then only pairs that are not connected yet.
- Larger nodes branch once more in any case. Of what is still together then, sets whose sketch agrees with none of the
  others go. The rest is mostly groups of copies: all sets are confirmed against one in the middle, and what is not connected by
  that is compared with all others of the node on the full sets, in the task that has them, so that only links leave it. Nodes of
  over BLOCK_ROWS sets go on branching; at the last level they are compared in blocks.

Pairs that another method suspects can be handed in: they are confirmed on the full sets with the first ones. The
pipeline hands in what SimHash (operator 2) finds: the sets whose fingerprints differ in at most 2 bits.

So a large group of near copies costs rows and links in proportion to its members. Two sets that meet in a node
and are in no confirmed chain together have been compared. Equal sets are one set from the start.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm import flat, simhash
from citeloom.llm.bits import broadcast_bits
from citeloom.llm.components import components
from citeloom.llm.frames import slices, unused, utf8, with_columns
from citeloom.sources.scratch import staged

SHINGLE = 2
#: Least similarity as a fraction, so that sizes are compared in whole numbers.
SIMILAR = (4, 5)
TREES = 2
BRANCHES = 3
LEVELS = 4
#: Sets of a node that are compared with each other at once.
LEAF = 32
BINS = 128
LEAST_ALIKE = 0.6
#: Rows of a task that compares small nodes, about, and sets of a large node that are compared at once.
SHARD_ROWS = 20_000
BLOCK_ROWS = 4096
#: Sets of a large node from which the one in the middle is chosen, and shingles that are counted at once.
MIDDLE = 64
COLUMNS = 2048

_SEEDS = np.random.default_rng(20240301).integers(0, 1 << 64, TREES * LEVELS, dtype=np.uint64)


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of texts, sorted within each text, and where each text's begin (and end).

    Only A-Z are lower-cased. Fewer words are one shingle, no words none.
    """
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    first, last, before = flat.places(data, offsets)
    word = flat.hashes(data, first, last) if len(first) else np.zeros(0, np.uint64)
    runs = flat.runs(word, shingle) if len(word) >= shingle else word[:0]
    found = []
    for begin, end in zip(before[:-1].tolist(), before[1:].tolist()):
        if end - begin >= shingle:
            hashes = np.sort(runs[begin : end - shingle + 1])
            found.append(hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])])
        elif end > begin:
            # Depends on how many words there are, as well as on each in its place.
            found.append(flat.mixed(flat.runs(word[begin:end], end - begin) + np.uint64(end - begin)))
        else:
            found.append(word[:0])
    bounds = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(f) for f in found], out=bounds[1:])
    return (np.concatenate(found) if found else word[:0]), bounds


def keys_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each whole set; 0 for empty ones."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(flat.mixed(hashes), out=sums[1:])
    sizes = np.diff(bounds).astype(np.uint64)
    return np.where(sizes > 0, flat.mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes), 0).astype(np.uint64).view(np.int64)


def sketches_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sets x BINS: 0 for an empty bin, else a byte of its smallest hash."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bin_ = of * BINS + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], bin_[1:] != bin_[:-1]])) if len(bin_) else bin_
    out = np.zeros((len(bounds) - 1) * BINS, np.uint8)
    out[bin_[lead]] = np.maximum(1, (hashes[lead] >> np.uint64(20)) & np.uint64(255))
    return out.reshape(-1, BINS)


def branches_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sets x TREES x LEVELS x BRANCHES: the smallest shingles under each hash (32 bits of it, never 0); 0 where a set has fewer."""
    sizes = np.diff(bounds)
    filled = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), TREES * LEVELS, BRANCHES), np.int32)
    if not len(filled):
        return out.reshape(len(sizes), -1)
    starts, of, last = bounds[:-1][filled], np.repeat(np.arange(len(filled)), sizes[filled]), np.uint64(2**64 - 1)
    for column, seed in enumerate(_SEEDS):
        order = flat.mixed(hashes ^ seed)
        for branch in range(BRANCHES):
            least = np.minimum.reduceat(order, starts)
            token = np.maximum(1, least >> np.uint64(33)).astype(np.int32)
            out[filled, column, branch] = np.where(least == last, 0, token)
            if branch + 1 < BRANCHES:
                order[order == least[of]] = last
    return out.reshape(len(sizes), -1)


def described(docs: DataFrame, shingle: int, by_simhash: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, ``key`` and ``n`` (size) of the set, ``sketch`` and ``branches``; the SimHash ``fingerprint`` if asked for."""
    names = ["doc_id", "key", "n", "sketch", "branches", *(["fingerprint"] if by_simhash else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, bounds = sets_of(*utf8(part.column("text")), shingle)
            sketch = np.ascontiguousarray(sketches_of(hashes, bounds))
            step = np.arange(part.num_rows + 1, dtype=np.int32)
            binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(step * BINS), pa.py_buffer(sketch)])
            tokens = branches_of(hashes, bounds)
            lists = pa.ListArray.from_arrays(pa.array(step * tokens.shape[1]), pa.array(tokens.ravel()))
            columns = [part.column("doc_id"), pa.array(keys_of(hashes, bounds)), pa.array(np.diff(bounds).astype(np.int32)), binary, lists]
            if by_simhash:
                columns.append(pa.array(simhash.fingerprints_of(part.column("text").to_pylist(), shingle).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted, more = docs.select("doc_id", "text"), ", fingerprint bigint" if by_simhash else ""
    return wanted.mapInArrow(run, with_columns(wanted.schema, "text", f"key bigint, n int, sketch binary, branches array<int>{more}"))


def _full_sets(docs: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """key, shingles of the sets named in ``keys``, each once; looked up in a second pass over the texts."""
    wanted = broadcast_bits(keys, keys.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, bounds = sets_of(*utf8(part.column("text")), shingle)
            own = keys_of(hashes, bounds)
            _, first = np.unique(own, return_index=True)
            hit = first[wanted.value.holds(own[first].view(np.uint64)) & (np.diff(bounds)[first] > 0)]
            sets = pa.array([hashes[bounds[i] : bounds[i + 1]].view(np.int64) for i in hit], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(own[hit]), sets], names=["key", "shingles"])

    found = docs.select("text").mapInArrow(run, "key bigint, shingles array<bigint>")
    return found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _branched(active: DataFrame | None, sets: DataFrame, level: int) -> DataFrame:
    """Rows (node, key) one level further down; all trees' roots if ``active`` is None."""

    def token(tree: int | Column, branch: int) -> Column:
        return F.get("branches", F.lit(level * BRANCHES + branch) + F.lit(LEVELS * BRANCHES) * tree)

    if active is None:
        ways = [F.struct(F.lit(t).alias("tree"), token(F.lit(t), b).alias("token")) for t in range(TREES) for b in range(BRANCHES)]
        rows = sets.where("n > 0").select("key", F.explode(F.array(*ways)).alias("way"), F.lit(0).cast("long").alias("node"))
    else:
        ways = [F.struct("tree", token(F.col("tree"), b).alias("token")) for b in range(BRANCHES)]
        rows = active.join(sets.select("key", "branches"), "key").select("key", F.explode(F.array(*ways)).alias("way"), "node")
    rows = rows.where(F.col("way.token") != 0)
    return rows.select("key", F.col("way.tree").alias("tree"), F.xxhash64("node", "way.tree", "way.token").alias("node"))


def _rooted(rows: DataFrame, roots: DataFrame | None, key: str = "key", root: str = "root") -> DataFrame:
    """Add the root of each row's component, the key itself where it has no link yet."""
    if roots is None:
        return rows.withColumn(root, F.col(key))
    joined = rows.join(roots.select(F.col("node").alias(key), F.col("root").alias("_root")), key, "left")
    return joined.withColumn(root, F.coalesce("_root", key)).drop("_root")


def _met(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of nodes in which not all are connected: node, tree, key, root, many."""
    rows = _rooted(rows, roots)
    nodes = rows.groupBy("node").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high"))
    return rows.join(nodes.where("low <> high").select("node", "many"), "node")


def _alike(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of sketches."""
    same, none = (one == other) & (one > 0), (one == 0) & (other == 0)
    return same.sum(axis=1) / np.maximum(1, BINS - none.sum(axis=1))


def _sketches(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _sized(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    part, whole = SIMILAR
    return (whole * n >= part * m) & (whole * m >= part * n)


def _forest(cell: np.ndarray, one: np.ndarray, other: np.ndarray, alike: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs are on a spanning forest of the most alike, for each cell; rows are told apart within their cell."""
    root = list(range(len(cell)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    on = np.zeros(len(one), bool)
    # Ties by key, so that different nodes choose the same pairs.
    for i in np.lexsort((key[other], key[one], -alike)).tolist():
        a, b = find(int(one[i])), find(int(other[i]))
        if a != b:
            root[a] = b
            on[i] = True
    return on


def _compared(rows: pa.Table) -> pa.Table:
    """Rows (cell, key, root, n, sketch) -> pairs (a, b, forest) of one cell each that may be similar."""
    rows = rows.take(pa.compute.sort_indices(rows, [("cell", "ascending"), ("key", "ascending")]))
    of, key, root, n = (rows[c].to_numpy() for c in ("cell", "key", "root", "n"))
    n, sketch = n.astype(np.int64), _sketches(rows["sketch"])
    found = []
    widest = int(np.diff(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))).max()) if len(of) else 0
    for step in range(1, widest):
        i = np.flatnonzero((of[:-step] == of[step:]) & (root[:-step] != root[step:]) & _sized(n[:-step], n[step:]))
        for low in range(0, len(i), BLOCK_ROWS):
            part = i[low : low + BLOCK_ROWS]
            alike = _alike(sketch[part], sketch[part + step])
            hit = alike >= LEAST_ALIKE
            if hit.any():
                found.append((part[hit], part[hit] + step, alike[hit]))
    one, other, alike = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([pa.array(key[one]), pa.array(key[other]), pa.array(_forest(of, one, other, alike, key))], names=["a", "b", "forest"])


_PAIRS = "a bigint, b bigint, forest boolean"


def _suspected(rows: pa.Table) -> pa.Table:
    """Rows (node, tree, key, root, n, sketch) -> those that may be similar to one of another root in their node."""
    rows = rows.take(pa.compute.sort_indices(rows, [("node", "ascending"), ("key", "ascending")]))
    node, root, n = (rows[c].to_numpy() for c in ("node", "root", "n"))
    n, sketch, hit = n.astype(np.int64), _sketches(rows["sketch"]), np.zeros(len(node), bool)
    widest = int(np.diff(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))).max()) if len(node) else 0
    for step in range(1, widest):
        i = np.flatnonzero((node[:-step] == node[step:]) & (root[:-step] != root[step:]) & ~(hit[:-step] & hit[step:]) & _sized(n[:-step], n[step:]))
        for low in range(0, len(i), BLOCK_ROWS):
            part = i[low : low + BLOCK_ROWS]
            part = part[_alike(sketch[part], sketch[part + step]) >= LEAST_ALIKE]
            hit[part] = hit[part + step] = True
    kept = rows.filter(pa.array(hit))
    return kept.select(["node", "tree", "key", "many"])


def _suspects(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Of nodes of at most BLOCK_ROWS sets, those that may be similar to another; nodes stay whole in a task."""
    shards = math.ceil(max(1, rows.count()) / SHARD_ROWS)
    held = rows.select("node", "tree", "key", "root", "many").join(sets.select("key", "n", "sketch"), "key")
    dealt = held.groupBy(F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"))
    return dealt.applyInArrow(_suspected, "node bigint, tree int, key bigint, many bigint")


def _pairs_of_small(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of nodes of at most LEAF sets; many nodes to a task."""
    shards = math.ceil(max(1, rows.count()) / SHARD_ROWS)
    held = rows.select(F.col("node").alias("cell"), "key", "root").join(sets.select("key", "n", "sketch"), "key")
    return held.groupBy(F.pmod(F.xxhash64("cell"), F.lit(shards)).alias("shard")).applyInArrow(_compared, _PAIRS)


def _counted(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` (places in ``sets``) shares with every set."""
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one set only are shared with none.
    several = np.cumsum(times > 1) - 1
    keep = times[code] > 1
    row, code = row[keep], several[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    shared = np.zeros((len(left), len(sets)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        part = slice(*np.searchsorted(code, (low, low + COLUMNS)))
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[row[part], code[part] - low] = 1
        shared += holds[left] @ holds.T
    return shared


def _linked(rows: pa.Table) -> pa.Table:
    """Rows (key, root, shingles) of one cell -> links (a, b) that connect all that can be connected in it."""
    part, whole = SIMILAR
    key, root = rows["key"].to_numpy(), rows["root"].to_numpy()
    sets = rows["shingles"].combine_chunks()
    flat_, bounds = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
    sets = [flat_[bounds[i] : bounds[i + 1]] for i in range(len(key))]
    size = np.diff(bounds)
    classes, of, many = np.unique(root, return_inverse=True, return_counts=True)
    above = list(range(len(classes)))

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    # All but the largest class are compared with everything; that one is connected within itself.
    rest, found = np.flatnonzero(of != many.argmax()), []
    for low in range(0, len(rest), 1024):
        left = rest[low : low + 1024]
        shared = _counted(sets, left).astype(np.int64)
        hit = whole * shared >= part * (size[left][:, None] + size[None, :] - shared)
        for i, j in zip(*np.nonzero(hit & (of[left][:, None] != of[None, :]))):
            a, b = find(int(of[left[i]])), find(int(of[j]))
            if a != b:
                above[a] = b
                found.append((key[left[i]], key[j]))
    one, other = zip(*found) if found else ((), ())
    return pa.table([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])


def _links_of_large(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Links within large nodes, found on the full sets. A node of over BLOCK_ROWS sets is blocks of them against blocks."""
    blocks = F.ceil(F.col("many") / BLOCK_ROWS).cast("int")
    own = rows.select("node", "key", "root", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    whole = own.where("blocks = 1").select(F.col("node").alias("cell"), "key", "root")
    split = own.where("blocks > 1").select("node", "key", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner"))
    cell = F.xxhash64("node", F.least("own", "partner"), F.greatest("own", "partner"))
    cells = whole.unionByName(split.select(cell.alias("cell"), "key", "root"))
    return cells.join(full, "key").groupBy("cell").applyInArrow(_linked, "a bigint, b bigint")


def _middle(rows: pa.Table) -> pa.Table:
    """Rows (node, place, key, sketch), at most MIDDLE of a node -> each node's set that is most like the others."""
    rows = rows.take(pa.compute.sort_indices(rows, [("node", "ascending"), ("place", "ascending")]))
    node, key, sketch = rows["node"].to_numpy(), rows["key"].to_numpy(), _sketches(rows["sketch"])
    edges = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]])) if len(node) else np.zeros(1, np.int64)
    chosen = []
    for low, high in zip(edges[:-1], edges[1:]):
        here = sketch[low:high]
        alike = [((here == one) & (one > 0)).sum() for one in here]
        chosen.append(low + int(np.argmax(alike)))
    return pa.table([pa.array(node[chosen]), pa.array(key[chosen])], names=["node", "center"])


def _stars(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a set in the middle of each large node with its other sets that may be similar."""
    # The same sets are looked at in all nodes of a group, so that the same one is chosen.
    order = Window.partitionBy("node").orderBy("mixed", "key")
    few = rows.select("node", "key", F.xxhash64("key").alias("mixed")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= MIDDLE)
    few = few.join(sets.select("key", "sketch"), "key").select("node", "place", "key", "sketch")
    shards = math.ceil(max(1, rows.count()) / SHARD_ROWS)
    centers = few.groupBy(F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard")).applyInArrow(_middle, "node bigint, center bigint")
    pairs = rows.join(centers, "node").where("key <> center").select(F.col("center").alias("a"), F.col("key").alias("b")).distinct()
    one, other = sets.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("left")), sets.select(F.col("key").alias("b"), "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            hit = _sized(part.column("m").to_numpy().astype(np.int64), part.column("n").to_numpy().astype(np.int64))
            hit &= _alike(_sketches(part.column("left")), _sketches(part.column("sketch"))) >= LEAST_ALIKE
            yield part.filter(pa.array(hit)).select(["a", "b"])

    return pairs.join(one, "a").join(other, "b").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) of set keys whose full sets are similar."""
    part, whole = SIMILAR
    one, other = full.toDF("a", "left"), full.toDF("b", "right")
    shared, both = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
    joined = pairs.select("a", "b").distinct().join(one, "a").join(other, "b")
    return joined.where(whole * shared >= part * (both - shared)).select("a", "b")


def links(docs: DataFrame, sets: DataFrame, shingle: int, suspected: DataFrame | None = None) -> DataFrame | None:
    """Distinct sets (key, n, sketch, branches) -> (node, root) of those connected to others; None if there are none.

    ``suspected`` pairs (a, b) of keys are compared as well.
    """

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = staged(rows, "met")
        return rows.where(F.col("many") <= LEAF), rows.where(F.col("many") > LEAF)

    def suspects(large: DataFrame) -> DataFrame:
        few = _suspects(large.where(F.col("many") <= BLOCK_ROWS), sets)
        return staged(few.unionByName(large.where(F.col("many") > BLOCK_ROWS).select(few.columns)), "suspects")

    small, large = split(_met(_branched(None, sets, 0), None))
    pairs = _pairs_of_small(small, sets)
    small, large = split(_met(_branched(large, sets, 1), None))
    large = suspects(large)
    pairs = pairs.unionByName(_pairs_of_small(small, sets))
    if suspected is not None:
        pairs = pairs.unionByName(suspected.withColumn("forest", F.lit(True)))
    pairs = staged(pairs.groupBy("a", "b").agg(F.bool_or("forest").alias("forest")), "pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select("key"))
    keys = staged(keys.distinct(), "keys")
    if keys.isEmpty():
        return None
    full = staged(_full_sets(docs, keys, shingle), "full")
    seen = [pairs]
    found = staged(_confirmed(pairs.where("forest").select("a", "b").unionByName(_stars(large, sets)), full), "links")
    roots = staged(components(found), "roots")
    for level in range(2, LEVELS + 1):
        left = staged(_met(large.select("key", "tree", "node"), roots), "left")
        if left.isEmpty():
            break
        at_once = F.lit(True) if level == LEVELS else F.col("many") <= BLOCK_ROWS
        inside = staged(_links_of_large(left.where(at_once), full), "links")
        if not inside.isEmpty():
            found = found.unionByName(inside)
            roots = staged(components(found), "roots")
        deeper = left.where(~at_once)
        if deeper.isEmpty():
            break
        small, large = split(_met(_branched(deeper, sets, level), roots))
        large = suspects(large)
        pairs = _pairs_of_small(small, sets).groupBy("a", "b").agg(F.bool_or("forest").alias("forest"))
        seen.append(staged(pairs, "pairs"))
        asked = seen[-1].where("forest").select("a", "b").unionByName(_stars(large, sets))
        found = found.unionByName(staged(_confirmed(asked, full), "links"))
        roots = staged(components(found), "roots")
    # What no forest had, and is still apart.
    rest = functools.reduce(DataFrame.unionByName, seen).where("NOT forest").select("a", "b")
    rest = _rooted(_rooted(rest, roots, "a", "at"), roots, "b", "to").where(F.col("at") != F.col("to")).select("a", "b")
    more = staged(_confirmed(rest, full), "links")
    return roots if more.isEmpty() else components(found.unionByName(more))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, *, empty_alike: bool = False, by_simhash: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles (size of the set), component_id, one row per input row.

    component_id is the smallest doc_id reachable over pairs of sets of similarity SIMILAR or more, the row's
    own included. Null texts and texts without words have no shingles: each is a component of its own, or
    all are one with ``empty_alike``. A null id is a component_id only where the whole component has none. Rows that
    repeat an id are rows of their own, linked by their texts and not by the id. Whole texts are read,
    however long. Other columns are ignored. An empty table gives no rows. With ``by_simhash``, pairs come
    from SimHash fingerprints of the same shingles too, and are confirmed like all others.
    """
    printed = staged(described(docs, shingle, by_simhash), "described")
    each = [F.min("fingerprint").alias("fingerprint")] if by_simhash else []
    distinct = printed.groupBy("key").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "sketch", "branches")], *each)
    distinct = staged(distinct, "distinct")
    suspected = simhash.candidates(distinct.where("n > 0").select("key", "fingerprint")) if by_simhash else None
    roots = links(docs, distinct.select("key", "n", "sketch", "branches"), shingle, suspected)
    rooted = _rooted(distinct.select("key", "first"), roots)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("key", "component_id")
    placed = printed.select("doc_id", "key", "n").join(classes, "key")
    alone = F.lit(False) if empty_alike else F.col("n") == 0
    return placed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def kept_of_each(docs: DataFrame, shingle: int = SHINGLE, *, by_simhash: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: of each component those of the smallest id, texts without words being one.

    Rows that repeat that id all stay, as one document. A component without any id stays whole, and with it all rows without an id.
    """
    (kept,) = unused(docs, "_kept_id")
    keep = near_copies(docs, shingle, empty_alike=True, by_simhash=by_simhash).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return docs.join(keep.select(F.col("doc_id").alias(kept)).distinct(), F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")


SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN w ELSE [] END AS s FROM split),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS shared FROM each a JOIN each b USING (t)
  WHERE a.doc_id <> b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL),
linked AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (n + m - shared)),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(l.b, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(l.b, doc_id)) AS kept
FROM sets LEFT JOIN least l ON l.a = doc_id
"""
