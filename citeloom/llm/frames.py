"""What the operators of this package share: columns, batches of bounded size, running sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.deploy import ship
from citeloom.sources.scratch import shared_folder, staged

#: Words are what stands between these characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Python tasks work on so many bytes of text at a time, or on one document if that is longer.
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the tasks, and bound what they are handed at a time."""
    ship(spark)


def with_columns(schema: StructType, drop: str, added: str) -> StructType:
    """The schema without one column, and the columns of a DDL string after it."""
    return StructType([f for f in schema.fields if f.name != drop] + StructType.fromDDL(added).fields)


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores put before it as it takes to be no column of the frame."""
    taken, found = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; an empty array for null or where there is none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{GAP}|{GAP}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage through the folder in ``spark.checkpoint.dir``."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def running_sum(frame: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add each ``name: value`` of ``sums``: the sum of ``value`` over the rows before this one in the given order.

    The rows are range-sorted into partitions, each partition is summed, and the sums of the earlier
    partitions (one row per partition) are added to a running sum inside the partition. No task sees
    more than one range, however many rows share a leading key.
    """
    n = partitions(frame.sparkSession)
    ranged = staged(frame.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part").agg(*[F.sum(v).alias(name) for name, v in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({name: F.coalesce(F.sum(v).over(inside), F.lit(0)) for name, v in sums.items()})
    # One row per partition of the exchange above: bounded by the session's setting.
    placed = summed.join(F.broadcast(offsets), "_part").withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums})
    return placed.drop("_part", *[f"_{name}" for name in sums])


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings one after another, and the offsets where each begins and ends; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
