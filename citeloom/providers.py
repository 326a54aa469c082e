"""Where external models plug in.

An embedder is ``(texts, task) -> vectors``; a text model is ``(system, prompt, schema) -> response
text``, the schema being that of the JSON object it is to return.
Both run inside Spark tasks, so they must be picklable and open their client on first use. Nothing
here calls a network by itself; without a model the engine is offline and a miss is an error.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeloom.functions.text import RETRY_ALWAYS, RETRY_DELAY, RETRY_NEVER
from citeloom.settings import MAX_RETRY_WAIT, MODEL_ATTEMPTS

TextModel = Callable[[str, str, dict], str]


def worth_retrying(message: str) -> bool:
    if any(mark in message for mark in RETRY_ALWAYS):
        return True
    return not any(mark in message for mark in RETRY_NEVER)


def asked_delay(message: str) -> float:
    found = re.search(RETRY_DELAY, message)
    return min(float(found.group(1)) + 0.5, MAX_RETRY_WAIT) if found else 0.0


def with_retries(
    call: Callable,
    attempts: int = MODEL_ATTEMPTS,
    judge: Callable[[str], bool] = lambda message: True,
    wait: Callable[[float], None] = time.sleep,
):
    """Call until it succeeds: 1, 2, 4 ... seconds apart, or as long as the service asks for."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:
            if attempt + 1 == attempts or not judge(str(error)):
                raise
            wait(max(2.0**attempt, asked_delay(str(error))))


def complete(prompts: DataFrame, model: TextModel, system: str, expected: dict, key: str = "query_id") -> DataFrame:
    """(key, prompt) to (key, response), one model call per row, inside the tasks."""
    schema = T.StructType([prompts.schema[key], T.StructField("response", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            answers = [
                with_retries(lambda: model(system, prompt, expected), MODEL_ATTEMPTS, worth_retrying)
                for prompt in rows.column("prompt").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array(answers, type=pa.string())], names=[key, "response"]
            )

    return prompts.select(key, "prompt").mapInArrow(run, schema)
