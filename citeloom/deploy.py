"""Make the package importable in Spark's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of rows that Spark hands to a Python task in one batch. Its own default, 64 MB, is held
#: several times over (in the JVM, in Arrow, as Python objects) by every core.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Add this package to the application's Python files, once per application, and bound what tasks are handed at a time.

    The files are not needed where the package is installed on every node or passed with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="citeloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
