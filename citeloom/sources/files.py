"""Small text files in whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written whole under another name and then renamed, so that a reader never sees half of it."""
    system, target = _at(spark, path)
    part = target.suffix(".part")
    out = system.create(part, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    system, target = _at(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
