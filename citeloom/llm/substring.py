"""Substring dedup: words go that stand in a long run of words which an earlier document has too.

A window is SPAN consecutive words; it is repeated if it also starts in a document of smaller id. The
references are the passages around repeated anchors, each distinct one once with the smallest id that
has it, dealt into shards. Each shard's suffix automaton, its states marked with the smallest id of
their occurrences, is built in the tasks of the shard; passages stream through it and their matching
statistics say which windows have an earlier owner. Maximal runs of covered words are removed.

1. Every window chooses the run of GRAM words in it with the smallest hash, its anchor. Equal windows
   choose equal anchors, and there are far fewer anchors than windows. Anchors are counted over the
   corpus (pre-aggregated); those of two rows or more are candidates.
2. A second pass gives each candidate passage (the windows of one anchor) as a row of numbers: place,
   anchor, hash of its words. Equal passages are folded before and after the shuffle, so a passage in
   a third of all documents is one reference. An anchor with one distinct passage needs no automaton.
3. A third pass spells out the references of all other anchors, for the automata. An anchor with more
   than CROWD distinct passages (a common phrase in ever new surroundings) would make a shard of its
   own size: its windows are counted one by one instead, by an aggregation without hot tasks.
4. Owners return to the passages of each document by a join, and the documents drop their words.

What one pass finds is told to the next by a broadcast bitmap of BITS bits, the same size for any
corpus. A full bitmap lets more rows through, which later steps sort out; it never loses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from citeloom.llm import flat
from citeloom.llm.automaton import SuffixAutomaton
from citeloom.llm.frames import slices, unused, utf8
from citeloom.sources.scratch import staged

SPAN = 13
GRAM = 4
#: 8 MB.
BITS = 1 << 26
#: References in a shard, about.
SHARD = 2048
CROWD = 1024


def passages_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Passages of texts given as UTF-8 bytes: text, first window, number of windows, anchor, hash of all words."""
    first, last, before = flat.places(data, offsets)
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if len(first) < SPAN:
        return nothing
    word = flat.hashes(data, first, last)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    grams = flat.runs(word, GRAM)
    chosen = flat.lowest(grams, SPAN - GRAM + 1)
    start = np.flatnonzero(doc[: len(chosen)] == doc[SPAN - 1 :])
    if not len(start):
        return nothing
    at, of = chosen[start], doc[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    count = np.diff(np.append(new, len(start)))
    begin = start[new]
    return of[new], begin - before[of[new]], count, grams[at[new]], flat.spans(word, begin, begin + count + SPAN - 1)


class Bitmap:
    """Which slots of BITS are taken; a key's slot is its lowest bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys & np.uint64(BITS - 1)).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_of(keys: DataFrame) -> Broadcast:
    """A broadcast bitmap of the slots of all ``key`` values.

    Built by Spark in pieces of 4 kB; the driver receives at most BITS / 8 bytes, whatever the corpus.
    """
    slot = keys.select((F.col("key").bitwiseAND(F.lit(BITS - 1)) + 1).alias("slot"))
    parts = slot.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bits = np.zeros(BITS // 8, np.uint8)
    for row in parts.toLocalIterator():
        size = len(row.bits)
        bits[(row.part - 1) * size : row.part * size] = np.frombuffer(row.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(Bitmap(bits))


def _owned(mark: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """A key for a passage in one document."""
    return flat.mixed(mark + doc_id.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(docs: DataFrame) -> DataFrame:
    """``text`` -> ``slot`` of each anchor (32 bits of its hash), each once per row that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            of, _, _, anchor, _ = passages_of(*utf8(part.column("text")))
            slot = np.unique(of.astype(np.uint64) << np.uint64(32) | (anchor & np.uint64(2**32 - 1))) & np.uint64(2**32 - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64))], names=["slot"])

    return docs.select("text").mapInArrow(run, "slot bigint")


def candidates(docs: DataFrame, repeated: Broadcast) -> DataFrame:
    """doc_id, text, digest -> the passages whose anchor is repeated, as numbers.

    ``start``: word at which the first of its windows begins; ``windows``: how many; ``route``: the
    anchor; ``mark``: hash of its words; ``owned``: key of the mark in this document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            of, start, windows, anchor, mark = passages_of(*utf8(part.column("text")))
            hit = np.flatnonzero(repeated.value.holds(anchor))
            picked = pa.array(of[hit])
            columns = [
                part.column("doc_id").take(picked),
                part.column("digest").take(picked),
                pa.array(start[hit], pa.int32()),
                pa.array(windows[hit], pa.int32()),
                pa.array(anchor[hit].view(np.int64)),
                pa.array(mark[hit].view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "start", "windows", "route", "mark"])

    return docs.mapInArrow(run, "doc_id bigint, digest int, start int, windows int, route bigint, mark bigint")


def spelled(docs: DataFrame, several: Broadcast, crowded: Broadcast, owned: Broadcast) -> DataFrame:
    """doc_id, text -> the passages that are references of anchors with several, with their words.

    route, mark, passage (words joined by single spaces), doc_id, and whether the anchor has a crowd.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            of, start, windows, anchor, mark = passages_of(*utf8(part.column("text")))
            ids = part.column("doc_id").to_numpy()[of]
            hit = np.flatnonzero(several.value.holds(anchor) & owned.value.holds(_owned(mark, ids)))
            texts, words, held, passages = part.column("text"), [], -1, []
            for d, s, n in zip(of[hit].tolist(), start[hit].tolist(), windows[hit].tolist()):
                if d != held:
                    held, words = d, texts[d].as_py().encode().split()
                passages.append(b" ".join(words[s : s + n + SPAN - 1]))
            columns = [
                pa.array(anchor[hit].view(np.int64)),
                pa.array(mark[hit].view(np.int64)),
                pa.array(passages, pa.binary()).cast(pa.string()),
                pa.array(ids[hit]),
                pa.array(crowded.value.holds(anchor[hit])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["route", "mark", "passage", "doc_id", "crowd"])

    return docs.select("doc_id", "text").mapInArrow(run, "route bigint, mark bigint, passage string, doc_id bigint, crowd boolean")


def owned_keys(marks: DataFrame) -> DataFrame:
    """mark, owner -> ``key`` as ``_owned`` makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            key = _owned(part.column("mark").to_numpy().view(np.uint64), part.column("owner").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return marks.select("mark", "owner").mapInArrow(run, "key bigint")


def _through_automaton(shard: pa.Table) -> pa.Table:
    """References of one shard -> the smallest owner of each of their windows."""
    sequences = [p.split(" ") for p in shard.column("passage").to_pylist()]
    automaton = SuffixAutomaton(zip(sequences, shard.column("owner").to_pylist()))
    owners = [automaton.owners(words, SPAN) for words in sequences]
    return pa.table(
        [shard.column("route"), shard.column("mark"), pa.array(owners, pa.list_(pa.int64()))], names=["route", "mark", "owners"]
    )


def owners_of(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents and their candidate passages -> route, mark, owners (smallest id per window)."""
    marks = staged(passages.groupBy("route", "mark").agg(F.min("doc_id").alias("owner"), F.min("windows").alias("windows")), "marks")
    routes = marks.groupBy("route").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("mark", "owner", "windows")])
    routes = staged(routes, "routes")
    alone = routes.where("n = 1").select("route", "mark", F.array_repeat("owner", F.col("windows")).alias("owners"))
    several = bitmap_of(routes.where("n > 1").select(F.col("route").alias("key")))
    crowded = bitmap_of(routes.where(f"n > {CROWD}").select(F.col("route").alias("key")))
    words = spelled(docs, several, crowded, bitmap_of(owned_keys(marks)))
    references = staged(words.groupBy("route", "mark", "passage", "crowd").agg(F.min("doc_id").alias("owner")), "references")
    few = references.where("NOT crowd")
    shards = few.count() // SHARD + 1
    through = (
        few.select("route", "mark", "passage", "owner")
        .groupBy(F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard"))
        .applyInArrow(_through_automaton, "route bigint, mark bigint, owners array<bigint>")
    )
    split = F.split("passage", " ")
    window = F.transform(F.sequence(F.lit(1), F.size(split) - SPAN + 1), lambda i: F.array_join(F.slice(split, i, SPAN), " "))
    single = references.where("crowd").select("route", "mark", "owner", F.posexplode(window).alias("at", "window"))
    least = single.groupBy("window").agg(F.min("owner").alias("least"))
    each = (
        single.join(least, "window")
        .groupBy("route", "mark")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "least"))), lambda x: x.least).alias("owners"))
    )
    return alone.unionByName(through).unionByName(each)


def digest(text: Column) -> Column:
    """Tells apart rows that repeat an id with other texts."""
    return F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).cast("int")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, digest, starts: the words at which repeated windows begin; rows without any are left out."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", digest(F.col("text")).alias("digest")
    )
    counted = anchors(rows).groupBy("slot").agg(F.count("*").alias("n"))
    repeated = bitmap_of(counted.where("n > 1").select(F.col("slot").alias("key")))
    passages = staged(candidates(rows, repeated), "passages")
    met = passages.drop("windows").join(owners_of(rows, passages), ["route", "mark"])
    places = F.filter(
        F.transform("owners", lambda owner, i: F.when(owner < F.col("doc_id"), F.col("start") + i)), lambda at: at.isNotNull()
    )
    hits = met.select("doc_id", "digest", places.alias("places")).where(F.size("places") > 0)
    return hits.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("places")).alias("starts"))


def _held(part: pa.RecordBatch, ids: Broadcast) -> np.ndarray:
    """Whether the bitmap of ids has each row's doc_id; it has no null."""
    column = part.column("doc_id").cast(pa.int64())
    key = flat.mixed(column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
    return ids.value.holds(key) & column.is_valid().to_numpy(zero_copy_only=False)


def _chosen(docs: DataFrame, ids: Broadcast) -> DataFrame:
    """The rows whose doc_id the bitmap of ids has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array(_held(part, ids)))

    return docs.mapInArrow(run, docs.schema)


def _id_keys(marked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            key = flat.mixed(part.column("_id").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return marked.select("_id").mapInArrow(run, "key bigint")


def without_repeats(docs: DataFrame, added: tuple[str, str, str] = ("_words", "_removed", "_kept")) -> DataFrame:
    """``docs`` with all its columns and _words, _removed (long), _kept: the words left, joined by single spaces.

    ``added`` are the names of these three, which the columns of ``docs`` must not have.

    Windows are judged on the input, whatever is removed elsewhere. A null text has no words. A row
    without id keeps its words and is no reference. Rows that repeat an id do not repeat each other.
    """
    clash = set(added) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already; name others in added")
    id_, mark, starts_ = held = unused(docs, "_id", "_digest", "_starts")
    marked = staged(repeats(docs), "repeats").withColumnsRenamed(dict(zip(("doc_id", "digest", "starts"), held)))
    # Only documents that may have repeats are shuffled to meet them.
    ids = bitmap_of(_id_keys(marked.select(F.col(id_).alias("_id"))))
    joined = _chosen(docs, ids).join(
        marked, (F.col("doc_id") == F.col(id_)) & (digest(F.col("text")) == F.col(mark)), "left"
    )
    names = docs.columns
    none = F.lit(None).cast("array<int>").alias(starts_)

    def run(batches: Iterator[pa.RecordBatch], ids: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            part = part if ids is None else part.filter(pa.array(~_held(part, ids)))
            total, removed, kept = [], [], []
            for text, starts in zip(part.column("text").to_pylist(), part.column(starts_).to_pylist()):
                words = text.encode().split() if text else []
                total.append(len(words))
                if starts:
                    step = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.array(starts))
                    step[at] += 1
                    step[at + SPAN] -= 1
                    covered = np.cumsum(step[:-1]) > 0
                    removed.append(int(covered.sum()))
                    words = [words[i] for i in np.flatnonzero(~covered).tolist()]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*names, *added],
            )

    schema = StructType([*docs.schema.fields, *[StructField(n, t()) for n, t in zip(added, (LongType, LongType, StringType))]])
    others = docs.select("*", none).mapInArrow(lambda batches: run(batches, ids), schema)
    return others.unionByName(joined.drop(id_, mark).mapInArrow(run, schema))


SQL = """
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)),
firsts AS (SELECT words, min(doc_id) AS owner FROM windows GROUP BY words),
covered AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i
  FROM windows JOIN firsts USING (words) WHERE owner < doc_id),
gone AS (SELECT doc_id, list(i) AS gone FROM covered GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w
         ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM texts t LEFT JOIN gone g ON t.doc_id = g.doc_id
"""
