"""Block-max pruned keyword search gives the lists of a full search, and skips blocks."""

import random

import pytest

from citeloom.operators import blockmax, bm25


def corpus(spark, seed, n=400):
    r = random.Random(seed)
    common, rare = ["the", "of", "and", "is"], [f"r{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = r.choices(common, k=r.randint(1, 20)) + r.choices(rare, k=r.choice([0, 1, 3]))
        r.shuffle(words)
        rows.append((f"c{i:03d}", " ".join(words)))
    rows += [("empty", ""), ("null", None)]
    return spark.createDataFrame(rows, "chunk_id string, index_text string").repartition(3)


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_lists_are_those_of_a_full_search(spark, tmp_path, block):
    index = bm25.build(corpus(spark, block))
    r = random.Random(block)
    asked = [(i, " ".join(r.choices(["the", "is", *[f"r{j}" for j in range(150)]], k=r.randint(1, 4)))) for i in range(20)]
    questions = spark.createDataFrame([*asked, (90, "absent words"), (91, ""), (92, "r1 r1 R1")], "query_id int, question string")
    blockmax.write(index, str(tmp_path / "i"), block)
    for k in (1, 5, 500):
        got, skipped = blockmax.search(blockmax.load(spark, str(tmp_path / "i")), questions, k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.search(index, questions, k).collect()))
        assert skipped.scored <= skipped.bounded <= skipped.pairs
        if k == 1 and block == 7:
            assert skipped.scored < skipped.bounded / 2, skipped
    few, _ = blockmax.search(blockmax.load(spark, str(tmp_path / "i")), questions, 5, max_weights=3)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, bm25.search(index, questions, 5).collect()))


def test_nothing_to_search(spark, tmp_path):
    index = bm25.build(spark.createDataFrame([], "chunk_id string, index_text string"))
    blockmax.write(index, str(tmp_path / "i"))
    questions = spark.createDataFrame([(1, "a")], "query_id int, question string")
    assert blockmax.search(blockmax.load(spark, str(tmp_path / "i")), questions, 5)[0].count() == 0
