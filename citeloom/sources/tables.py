"""Reading the input tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Session setting: number of tasks over which small inputs are dealt out.
SPREAD = "spark.citeloom.inputPartitions"


def read_stored(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A parquet table written earlier; FileNotFoundError where there is none."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"nothing stored at {path}") from error
        raise


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read for per-row work that costs much more than reading (tokenising, chunking).

    A table in one row group is one task, however many cores there are. A session that reads such
    tables says in SPREAD over how many tasks the rows are dealt out; unset, nothing is shuffled.
    """
    frame = read_table(spark, folder, name)
    frame = frame.select(*columns) if columns else frame
    parts = int(spark.conf.get(SPREAD, "0"))
    return frame.repartition(parts) if parts else frame
