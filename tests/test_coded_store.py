"""The coded store: recall against brute force, what a search reads, growth by deltas."""

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import ann, knn
from citeloom.sources.coded_store import CodedStore
from workload import inputs

SIZES = [f for f in ("/root/testdata/sf0.01", "/root/testdata/sf0.1") if os.path.isdir(f)]


def ids(frame):
    found = {}
    for row in frame.collect():
        found.setdefault(row.query_id, set()).add(row.chunk_id)
    return found


@pytest.mark.parametrize("folder", SIZES)
def test_recall_on_the_given_tables(spark, tmp_path, folder):
    stored, asked = inputs.vectors(spark, folder), inputs.question_vectors(spark, folder)
    coded = CodedStore(spark, str(tmp_path / "s"), recall=0.95)
    coded.add(stored.select("chunk_id"), stored)
    exact, got = ids(knn.exact_topk(stored, asked, 20)), ids(coded.search(asked, 20))
    recall = np.mean([len(got[q] & exact[q]) / 20 for q in exact])
    setting = coded.setting()
    print(folder, setting, recall)
    assert recall >= 0.9 and setting.recall >= 0.95
    # Vectors that are compared with a question, of all.
    assert setting.rerank < stored.count() / 2


def unit_rows(n, dim, seed):
    v = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, numbers, seed, dim=10):
    rows = [(f"c{i:04d}", v.tolist()) for i, v in zip(numbers, unit_rows(len(numbers), dim, seed))]
    return spark.createDataFrame(rows, "chunk_id string, vector array<float>")


def weight(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_deltas_are_small_and_last_words_win(spark, tmp_path):
    path = str(tmp_path / "s")
    coded, base = CodedStore(spark, path), frame(spark, range(2000), 1)
    chunks = base.select("chunk_id", F.concat(F.lit("text "), "chunk_id").alias("text"))
    coded.add(chunks, base)
    before = {p.name for p in Path(path).iterdir()}
    delta = frame(spark, [5, 6, *range(2000, 2018)], 2)
    coded.add(delta.select("chunk_id", F.lit("new").alias("text")), delta)
    coded.delete(spark.createDataFrame([("c0006",), ("c0007",), ("absent",)], "chunk_id string"))
    new = {p.name for p in Path(path).iterdir()} - before
    rows = {p: sum(1 for _ in spark.read.parquet(f"{path}/{p}/rows").select("chunk_id").collect()) for p in new if p.startswith("delta")}
    assert list(rows.values()) == [20]
    base_folder = next(p for p in before if p.startswith("base"))
    assert sum(weight(f"{path}/{p}/names") for p in new) < weight(f"{path}/{base_folder}") / 10
    again = CodedStore.load(spark, path)
    held = {r.chunk_id: r.text for r in again.chunks().collect()}
    assert len(held) == again.count() == 2000 + 18 - 2
    assert held["c0005"] == held["c2000"] == "new" and held["c0008"] == "text c0008" and not held.keys() & {"c0006", "c0007", "absent"}
    asked = delta.limit(3).withColumnRenamed("chunk_id", "query_id")
    live = again.rows().select("chunk_id", "vector")
    exact, got = ids(knn.exact_topk(live, asked, 10)), ids(again.search(asked, 10))
    assert np.mean([len(got[q] & exact[q]) / 10 for q in exact]) >= 0.9
    coded.add(*[f(spark.createDataFrame([("c0006", delta.first().vector)], "chunk_id string, vector array<float>")) for f in (lambda d: d.selectExpr("chunk_id", "'back' AS text"), lambda d: d)])
    coded.compact()
    whole = CodedStore.load(spark, path)
    assert whole.count() == 2017 and len(whole._manifest()) == 1
    assert {r.text for r in whole.chunks().where("chunk_id = 'c0006'").collect()} == {"back"}


def test_questions_in_blocks_give_the_same_lists(spark, tmp_path):
    coded, stored, asked = CodedStore(spark, str(tmp_path / "s")), frame(spark, range(300), 3), frame(spark, range(40), 4)
    coded.add(stored.select("chunk_id"), stored)
    asked = asked.withColumnRenamed("chunk_id", "query_id")
    whole = sorted(map(tuple, coded.search(asked, 7).collect()))
    assert whole == sorted(map(tuple, coded.search(asked, 7, max_cells=20).collect())) and len(whole) == 280


def test_odd_stores(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        CodedStore.load(spark, str(tmp_path / "none"))
    coded = CodedStore(spark, str(tmp_path / "s"))
    asked = frame(spark, range(2), 4).withColumnRenamed("chunk_id", "query_id")
    assert coded.count() == 0 and coded.search(asked).count() == 0
    one = frame(spark, [1], 1)
    coded.add(one.select("chunk_id"), one)
    assert [r.chunk_id for r in coded.search(asked, 5).collect()] == ["c0001"] * 2
    assert coded.search(asked, 0).count() == 0
    with pytest.raises(ValueError):
        wide = frame(spark, [2], 1, dim=11)
        coded.add(wide.select("chunk_id"), wide)
    # Many copies of one vector, of which any k may be found: the smallest ids by exact rank among candidates.
    same = spark.createDataFrame([(f"s{i:04d}", one.first().vector) for i in range(500)], "chunk_id string, vector array<float>")
    coded.add(same.select("chunk_id"), same)
    assert coded.count() == 501 and {len(v) for v in ids(coded.search(asked, 5)).values()} == {5}


def test_code_words_of_an_odd_dimension():
    rows = unit_rows(50, 10, 5).astype(float)
    words = ann._fitted_words(rows, 4, 256)
    codes = ann.Codes(rows[:3], words)
    assert words.shape == (3, 50, 4)
    # With as many words as rows, codes are the rows themselves.
    tables, code = codes.tables(rows), codes.encode(rows)
    products = sum(t[c] for t, c in zip(tables, code.T))
    assert np.allclose(products, rows @ rows.T)
