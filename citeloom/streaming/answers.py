"""Model calls on a stream of prompts that outlive failures of the model and of the stream.

Each prompt has one entry of state: how often its model was called and whether it has its response. A call that fails
and is worth repeating sets a timer, 1, 2, 4 ... seconds ahead or as far as the service asks for; no task sleeps. The entry is
kept in the stream's checkpoint with the timer, so a restarted stream goes on where it stood and a
prompt that comes again is not asked again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citeloom.providers import TextModel, asked_delay, worth_retrying
from citeloom.settings import MODEL_ATTEMPTS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Calls(StatefulProcessor):
    def __init__(self, model: TextModel, system: str, expected: dict, attempts: int, unit: float):
        self.model, self.system, self.expected, self.attempts, self.unit = model, system, expected, attempts, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "prompt string, calls int, done boolean")

    def _call(self, key, prompt: str, calls: int, now: int) -> Iterator[Row]:
        response, error = None, None
        try:
            response = self.model(self.system, prompt, self.expected)
        except Exception as failure:
            error = str(failure)
        calls += 1
        if error is not None and calls < self.attempts and worth_retrying(error):
            self.entry.update((prompt, calls, False))
            wait = max(2.0 ** (calls - 1), asked_delay(error)) * self.unit
            self.handle.registerTimer(now + max(1, int(1000 * wait)))
            return
        # The prompt is no longer needed.
        self.entry.update(("", calls, True))
        yield Row(query_id=key[0], response=response, error=error, calls=calls)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = next(iter(rows))
        if not self.entry.exists():
            yield from self._call(key, first.prompt, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        prompt, calls, done = self.entry.get()
        if not done:
            yield from self._call(key, prompt, calls, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def complete_stream(
    prompts: DataFrame, model: TextModel, system: str, expected: dict, attempts: int = MODEL_ATTEMPTS, unit: float = 1.0
) -> DataFrame:
    """A stream of (query_id, prompt) to query_id, response, error, calls: one row for each query_id, when it is settled.

    ``error`` is the last failure where there is no response: one not worth repeating, or the ``attempts``-th. ``unit`` is the
    first wait in seconds. The session's state store must be RocksDB (``PROVIDER``), as timers ask for.
    """
    schema = T.StructType([prompts.schema["query_id"], *T.StructType.fromDDL("response string, error string, calls int").fields])
    calls = _Calls(model, system, expected, attempts, unit)
    return prompts.select("query_id", "prompt").groupBy("query_id").transformWithState(calls, schema, "Append", "ProcessingTime")
