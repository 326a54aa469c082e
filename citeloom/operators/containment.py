"""Which of many short texts stand literally in which of many long ones.

The short texts become Aho-Corasick automata, one for each shard of at most MAX_SHARD_CHARS characters.
A task runs its long texts through a shard's automaton once, however many short texts there are, and gives
one row for each short text found. Only ids leave the task. Long texts are read once per shard and never
shuffled. The short texts are counted before they are sent anywhere.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.sources.scratch import staged

#: Characters of short texts in one automaton; it takes some hundred bytes for each.
MAX_SHARD_CHARS = 1_000_000

_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, texts: list[str]) -> ahocorasick.Automaton:
    """One automaton at a time is kept in a worker process."""
    if name not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for place, text in enumerate(texts):
            made.add_word(text, place)
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def _found_in(texts: DataFrame, shard: DataFrame, schema: T.StructType) -> DataFrame:
    rows = shard.select("number", "short").toArrow()
    numbers, short = rows["number"].to_pylist(), rows["short"].to_pylist()
    shipped, name = texts.sparkSession.sparkContext.broadcast((numbers, short)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, short = shipped.value
        automaton = _automaton(name, short)
        for batch in batches:
            place, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                held = {value for _, value in automaton.iter(text)} if text else ()
                place += [row] * len(held)
                found += [numbers[value] for value in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), batch.column("text_id").take(pa.array(place, pa.int64()))], names=["number", "text_id"]
            )

    return texts.mapInArrow(run, schema)


def holders(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """texts(text_id, text), asked(short_id, short) -> short_id, text_id, each pair once, for every text that holds a short one.

    An empty or null text holds nothing and is held by nothing. Equal short texts are looked for once.
    Letters must agree in case. The result has the text ids of all holders, however many.
    """
    texts, asked = texts.select("text_id", "text"), asked.select("short_id", "short")
    distinct = asked.where(F.length("short") > 0).groupBy("short").agg(F.count("*").alias("asked"))
    total = distinct.agg(F.sum(F.length("short"))).first()[0] or 0
    shards = math.ceil(total / MAX_SHARD_CHARS)
    numbered = staged(
        distinct.select("short", F.xxhash64("short").alias("number"), F.pmod(F.xxhash64(F.lit("shard"), "short"), F.lit(max(1, shards))).alias("shard")),
        "short",
    )
    schema = T.StructType([T.StructField("number", T.LongType()), texts.schema["text_id"]])
    pairs = None
    for shard in range(shards):
        part = _found_in(texts.where(F.length("text") > 0), numbered.where(F.col("shard") == shard), schema)
        pairs = part if pairs is None else pairs.unionByName(part)
    if pairs is None:
        pairs = texts.sparkSession.createDataFrame([], schema)
    ids = asked.join(numbered, "short").select("short_id", "number")
    return pairs.join(ids, "number").select("short_id", "text_id")
