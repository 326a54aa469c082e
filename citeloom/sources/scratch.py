"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage and survives the loss of any executor. Only where the setting is
absent and the master is local (tests, a laptop) does a fresh temporary folder stand in.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_scope = threading.local()


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="citeloom-")
    return _local[app]


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write the rows once as a table and read them back."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for held in getattr(_scope, "open", ()):
        held.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever its file system is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Remove what this thread stages inside, once the block ends: its frames must be consumed by then."""
    held: list[str] = []
    _scope.open = (*getattr(_scope, "open", ()), held)
    try:
        yield
    finally:
        _scope.open = tuple(h for h in _scope.open if h is not held)
        for path in held:
            remove(spark, path)
