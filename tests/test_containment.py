"""Literal containment of many texts against plain Python."""

import random

import pytest

from citeloom.operators import containment


@pytest.mark.parametrize("shard", [1_000_000, 40])
def test_against_plain_search(spark, monkeypatch, shard):
    monkeypatch.setattr(containment, "MAX_SHARD_CHARS", shard)
    r = random.Random(shard)
    # Few letters, so that short texts overlap and stand within each other.
    short = ["".join(r.choices("abé\n😀", k=r.randint(1, 5))) for _ in range(60)] + ["", "zz", "a", "a", "AB"]
    texts = ["".join(r.choices("abé\n😀", k=r.randint(0, 60))) for _ in range(80)] + ["", "ab" * 20_000, "AB"]
    asked = spark.createDataFrame([*enumerate(short), (999, None)], "short_id long, short string")
    held = spark.createDataFrame([*enumerate(texts), (999, None)], "text_id long, text string")
    got = sorted(tuple(x) for x in containment.holders(held.repartition(5), asked).collect())
    assert got == sorted((i, j) for i, s in enumerate(short) for j, t in enumerate(texts) if s and s in t)


def test_nothing_asked(spark):
    asked = spark.createDataFrame([], "short_id string, short string")
    assert containment.holders(spark.createDataFrame([(1, "a")], "text_id int, text string"), asked).count() == 0


def test_plan_has_no_nested_loop(spark):
    asked = spark.createDataFrame([(1, "b"), (2, "")], "short_id long, short string")
    found = containment.holders(spark.createDataFrame([(1, "abc")], "text_id long, text string"), asked)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
