"""Document fingerprints: homomorphic multiset hashes of paragraphs.

Each paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, modulo 2^64 in LANES equality lanes and modulo 2^32 in SKETCH likeness lanes. So
the order of paragraphs does not matter, equal multisets have equal fingerprints, and a paragraph is
added or taken out by adding or subtracting its vector. An equality lane is a uniform hash of the
paragraph. The likeness lanes sum signed unit vectors of the paragraph's words and word pairs (and,
below FEW words, of its runs of four bytes), so the cosine of two fingerprints estimates how much two
documents share; its error is about 1/sqrt(SKETCH).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import flat
from citeloom.llm.frames import partitions, slices, utf8, with_columns

LANES = 4
SKETCH = 128
FEW = 4
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True
_LANE = np.random.default_rng(5).integers(0, 1 << 64, LANES, dtype=np.uint64)


def _signed(features: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document the sum of a signed unit vector for each feature."""
    lane = (features & np.uint64(SKETCH - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((features >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    return np.bincount(doc * SKETCH + lane, weights=sign, minlength=n * SKETCH)


def vectors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equality lanes (uint64) and likeness lanes (uint32) of texts given as UTF-8 bytes and offsets."""
    n = len(offsets) - 1
    if n == 0 or len(data) == 0:
        return np.zeros((n, LANES), np.uint64), np.zeros((n, SKETCH), np.uint32)
    begin, end, before = flat.places(data, offsets, _LINE)
    doc_of_line = np.repeat(np.arange(n), np.diff(before))
    line_hash = flat.hashes(data, begin, end)
    lanes = flat.mixed(line_hash[:, None] ^ _LANE[None, :])
    sums = np.zeros((len(lanes) + 1, LANES), np.uint64)
    np.cumsum(lanes, axis=0, out=sums[1:])
    equal = sums[before[1:]] - sums[before[:-1]]
    first, last, words_before = flat.places(data, offsets)
    word = flat.hashes(data, first, last)
    doc = np.repeat(np.arange(n), np.diff(words_before))
    line = np.searchsorted(begin, first, "right") - 1
    # A pair within a line: the two words follow each other in the same line.
    pair = np.flatnonzero(line[1:] == line[:-1])
    features = [word, flat.runs(word, 2)[pair]] if len(word) > 1 else [word]
    docs = [doc, doc[pair]] if len(word) > 1 else [doc]
    short = np.bincount(line, minlength=len(begin)) < FEW
    room = np.where(short, np.maximum(end - begin - 3, 0), 0)
    if room.any():
        at = np.repeat(begin - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
        features.append(flat.hashes(data, at, at + 4) ^ np.uint64(0xA5A5A5A5))
        docs.append(np.repeat(doc_of_line, room))
    alike = _signed(np.concatenate(features), np.concatenate(docs), n)
    return equal, alike.astype(np.int64).astype(np.uint32).reshape(n, SKETCH)


def _hex(equal: np.ndarray, alike: np.ndarray) -> list[str]:
    rows = np.concatenate([equal.astype(">u8").view(np.uint8).reshape(len(equal), -1), alike.astype(">u4").view(np.uint8).reshape(len(alike), -1)], axis=1)
    data, size = rows.tobytes().hex(), 2 * rows.shape[1]
    return [data[i * size : (i + 1) * size] for i in range(len(rows))]


def _parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * LANES], ">u8").astype(np.uint64), np.frombuffer(raw[8 * LANES :], ">u4").astype(np.uint32)


def combined(fingerprint: str, other: str, times: int = 1) -> str:
    """The fingerprint with the paragraphs of another inserted (times=1) or taken out (times=-1)."""
    (a, b), (c, d) = _parsed(fingerprint), _parsed(other)
    step = (lambda x, y: x + y) if times == 1 else (lambda x, y: x - y)
    return _hex(step(a, c)[None], step(b, d)[None])[0]


def fingerprint_of(text: str | None) -> str:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _hex(*vectors_of(raw, np.array([0, len(raw)])))[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of likeness lanes row by row, not below 0; 1 for equal rows, 0 where only one is zero."""
    x, y = a.view(np.int32).astype(np.float64), b.view(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (hex string) of ``text``; null is empty, empty is all zeros. One pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            found = _hex(*vectors_of(*utf8(part.column("_text"))))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(found, pa.string())], names=[*keep, "fingerprint"])

    wanted = docs.select(*keep, F.col("text").alias("_text"))
    return wanted.mapInArrow(run, with_columns(wanted.schema, "_text", "fingerprint string"))


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text -> rows sorted so that within a ``bucket`` each document is followed by the next one.

    The order is descending doc_id (null last), then text. Ids are dealt into ranges; the first document
    of each range comes once more (``again``) at the end of the range before it, that of the first range
    at the end of the last. So every range can be worked on alone and text is shuffled once. Collected
    are range bounds and one id per range, as many as shuffle partitions.
    """
    from pyspark.ml.feature import Bucketizer

    n = partitions(docs.sparkSession)
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", -F.col("key").cast("double"))
    cuts = rows.approxQuantile("place", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(rows)
    else:
        rows = rows.withColumn("bucket", F.lit(0.0))
    rows = rows.withColumn("bucket", F.col("bucket").cast("int")).drop("place")
    heads = sorted(rows.groupBy("bucket").agg(F.max("key").alias("key")).collect())
    before = [(h.key, heads[i - 1].bucket) for i, h in enumerate(heads)]
    again = docs.sparkSession.createDataFrame(before, "head long, before int")
    marked = rows.join(F.broadcast(again), F.col("key") == F.col("head"), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("again"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("again"))
    dealt = marked.select("key", "doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("at"))
    dealt = dealt.select("key", "doc_id", "text", "at.bucket", "at.again")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "again", F.col("key").desc(), "text")


_EDITED = "doc_id {}, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text -> what editing each text does to its fingerprint, one row per input row.

    The edited text has its last floor(n/3) code points replaced by as many (or all) first ones of the
    next document in descending doc_id order; after the last comes the first, and a document alone is
    followed by itself. Null texts are empty; equal ids follow each other by text; null ids come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # a document that waits for the one after it
        for part in slices(batches, "text"):
            both = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            yield _pairs(both)
            held = both.slice(len(both) - 1, 1)

    def _pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
        bucket, again = rows.column("bucket").to_numpy(), rows.column("again").to_numpy(zero_copy_only=False)
        texts = rows.column("text").to_pylist()
        at = np.flatnonzero((bucket[1:] == bucket[:-1]) & ~again[:-1])
        tails = [len(texts[i]) // 3 for i in at]
        made = [texts[i][: len(texts[i]) - t] + texts[i + 1][:t] for i, t in zip(at, tails)]
        equal, alike = vectors_of(*utf8(rows.column("text")))
        equal_made, alike_made = vectors_of(*utf8(pa.array(made, pa.large_string())))
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").take(pa.array(at)),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array(made, pa.string()),
                pa.array(_hex(equal[at], alike[at]), pa.string()),
                pa.array(_hex(equal_made, alike_made), pa.string()),
                pa.array(likeness(alike[at], alike_made), pa.float64()),
                pa.array(likeness(alike[at], alike[at + 1]), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    rows = followed(docs).drop("key")
    return rows.mapInArrow(run, _EDITED.format(rows.schema["doc_id"].dataType.simpleString()))
