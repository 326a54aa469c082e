"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance.

Candidates come from multi-index hashing. A fingerprint has four segments of 16 bits. In each segment
the ball of radius 1 is enumerated, the other segments kept: 64 probes, and the fingerprint itself.
All fingerprints put their probes into one table and look up the same probes in it. Two fingerprints
at distance 2 or less meet at a probe that is one bit from both, and all that meet at a probe are
within 2 of each other. So a probe never holds more than 65 fingerprints, however large a group of
near copies is, and linking each to the one before it in its probe loses no connection. Every link is
verified on the complete fingerprints. Probing segment values alone would put all fingerprints of a
large group that share a segment into one bucket, with a square number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.components import components
from citeloom.llm.frames import slices, unused, with_columns
from citeloom.sources.scratch import staged

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits at most; the probes above are for exactly this.
DISTANCE = 2
SEGMENTS = 4
SEGMENT_BITS = 64 // SEGMENTS


def _sum_bits(hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes beginning at ``starts``, how many have each of the 64 bits set."""
    bits = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if set in over half the shingle hashes."""
    digest = xxhash.xxh64_intdigest
    hashed: list[int] = []
    counts = []
    for text in texts:
        words = text.encode().lower().split() if text else []  # bytes: only A-Z, only ASCII white space
        if len(words) > shingle:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            hashed += [digest(s, SEED) for s in shingles]
            counts.append(len(words) - shingle + 1)
        elif words:
            hashed.append(digest(b" ".join(words), SEED))
            counts.append(1)
        else:
            counts.append(0)
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        ends = np.cumsum(n)
        sums = _sum_bits(np.array(hashed, np.uint64), (ends - n)[filled])
        ones = 2 * sums > n[filled, None]
        out[filled] = np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (long, the 64 bits) of ``text``; one pass over the rows.

    A null text, and one without words, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            values = fingerprints_of(part.column("_text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(values)], names=[*keep, "fingerprint"])

    wanted = docs.select(*keep, F.col("text").alias("_text"))
    return wanted.mapInArrow(run, with_columns(wanted.schema, "_text", "fingerprint bigint"))


def _ball(fingerprint: Column) -> Column:
    """The fingerprint and, segment by segment, its neighbours at distance 1; with the mask of each."""
    masks = [0] + [1 << (s * SEGMENT_BITS + b) for s in range(SEGMENTS) for b in range(SEGMENT_BITS)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.explode(F.array(*[F.struct(fingerprint.bitwiseXOR(F.lit(m).cast("long")).alias("probe"), F.lit(m).cast("long").alias("mask")) for m in signed]))


def links(distinct: DataFrame) -> DataFrame:
    """Distinct ``fingerprint`` values -> pairs (a, b) that connect all within DISTANCE of each other."""
    table = distinct.select(_ball(F.col("fingerprint")).alias("at")).select("at.probe", "at.mask")
    met = Window.partitionBy("probe").orderBy("mask")
    own = F.col("probe").bitwiseXOR(F.col("mask"))
    other = F.col("probe").bitwiseXOR(F.lag("mask").over(met))
    pairs = table.select(own.alias("a"), other.alias("b")).where("b IS NOT NULL")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)


def candidates(distinct: DataFrame) -> DataFrame:
    """Rows (key, fingerprint) -> pairs (a, b) of keys within DISTANCE bits, a < b, that connect all such.

    Keys of one fingerprint are paired with the smallest of them, and the smallest ones of linked fingerprints with
    each other: as many pairs as rows and links, however large a group is.
    """
    firsts = staged(distinct.groupBy("fingerprint").agg(F.min("key").alias("first")), "firsts")
    same = distinct.join(firsts, "fingerprint").where(F.col("key") != F.col("first")).select(F.col("first").alias("a"), F.col("key").alias("b"))
    one, other = (firsts.select(F.col("fingerprint").alias(f), F.col("first").alias(k)) for f, k in (("a", "one"), ("b", "other")))
    near = links(firsts.select("fingerprint")).join(one, "a").join(other, "b")
    return same.unionByName(near.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct())


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, fingerprint (16 hex digits), component_id, one row per input row.

    component_id is the smallest doc_id reachable over links, the row's own included. Empty and null
    texts share fingerprint 0, which links like any other. A null id never is a component_id unless
    the whole component has none. Equal rows stay rows of their own. Other columns are ignored.
    """
    printed = staged(fingerprints(docs, "doc_id"), "fingerprints")
    distinct = staged(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fingerprint")))
    rooted = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return printed.join(classes, "fingerprint").select("doc_id", hexed(F.col("fingerprint")).alias("fingerprint"), "component_id")


def kept_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: of each component those of the smallest id.

    Rows that repeat that id all stay, as one document. A component without any id stays whole.
    """
    printed = near_duplicates(docs)
    (kept,) = unused(docs, "_kept_id")
    keep = printed.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")
