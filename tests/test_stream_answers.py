"""A failing model and a restarted stream: each prompt gets one row, and calls go on where they stood."""

import time
import uuid
from collections import Counter

import pytest

from citeloom.streaming.answers import PROVIDER, complete_stream


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def model_with(folder):
    """Counts its calls in a folder; prompts say how they fail."""

    def model(system, prompt, expected):
        (folder / f"{prompt.replace(' ', '_')}-{uuid.uuid4().hex}").touch()
        made = sum(1 for p in folder.iterdir() if p.name.startswith(prompt.replace(" ", "_")))
        if prompt.startswith("twice") and made <= 2:
            raise RuntimeError("503 unavailable")
        if prompt.startswith("never"):
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        if prompt.startswith("bad"):
            raise RuntimeError("INVALID_ARGUMENT in the prompt")
        return f"{system}: {prompt}"

    return model


def run_until(spark, incoming, out, checkpoint, model, wanted):
    stream = spark.readStream.schema("query_id string, prompt string").parquet(str(incoming))
    made = complete_stream(stream, model, "s", {}, unit=0.05)
    query = made.writeStream.option("checkpointLocation", str(checkpoint)).trigger(processingTime="100 milliseconds").start(str(out), format="parquet")
    end = time.time() + 120
    try:
        while time.time() < end and query.isActive:
            # The sink's log says which files count; there is none before the first batch.
            if any(out.glob("_spark_metadata/[0-9]*")) and len(rows := spark.read.schema(made.schema).parquet(str(out)).collect()) >= wanted:
                return rows
            time.sleep(0.5)
    finally:
        if query.exception():
            raise query.exception()
        query.stop()
    raise AssertionError("the stream did not settle")


def test_every_prompt_is_settled_once(rocks, tmp_path):
    spark = rocks
    calls = tmp_path / "calls"
    calls.mkdir()
    first = [("a", "fine one"), ("b", "twice one"), ("c", "bad one"), ("d", "never one"), ("a", "fine one")]
    spark.createDataFrame(first, "query_id string, prompt string").coalesce(1).write.parquet(str(tmp_path / "in"))
    args = (tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint", model_with(calls))
    rows = run_until(spark, *args, 4)
    got = {r.query_id: (r.response, r.error, r.calls) for r in rows}
    assert len(rows) == 4
    assert got["a"] == ("s: fine one", None, 1) and got["b"] == ("s: twice one", None, 3)
    assert got["c"] == (None, "INVALID_ARGUMENT in the prompt", 1) and got["d"] == (None, "429 RESOURCE_EXHAUSTED", 4)
    # Restarted, with a prompt that is settled and a new one.
    spark.createDataFrame([("a", "fine one"), ("e", "twice two")], "query_id string, prompt string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = run_until(spark, *args, 5)
    assert Counter(r.query_id for r in rows) == Counter("abcde")
    assert {r.query_id: r.calls for r in rows}["e"] == 3
    made = Counter(p.name.split("-")[0] for p in calls.iterdir())
    assert made == {"fine_one": 1, "twice_one": 3, "bad_one": 1, "never_one": 4, "twice_two": 3}
