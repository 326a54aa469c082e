"""Tables whose rows stand several times."""

import numpy as np
import pytest

from citeloom.llm import crosspolytope


@pytest.mark.parametrize("copies", [2, 20])
def test_neighbours_where_each_row_is_repeated(spark, copies):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=6) for i in range(40)}
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items() for _ in range(copies)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    # With k=30 one bucket is short of candidates, so the exact search has to give the lists.
    for k in (10, 30):
        got = crosspolytope.nearest(frame, frame.vec_id % 10 == 0, k=k, settings=crosspolytope.Settings(tables=1, probes=1)).collect()
        for q in (0, 10, 20, 30):
            want = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:k]
            found = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
            assert [n for n, _ in found] == list(range(1, k + 1))
            assert len({i for _, i in found}) == k and (k == 10 or [i for _, i in found] == [i for _, i in want])


def test_a_repeated_id_counts_at_its_nearest_row(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 5.0]), (1, [1.0, 0.1]), (2, [1.0, 1.0]), (2, [1.0, 9.0]), (3, [1.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = crosspolytope.nearest(frame, frame.vec_id == 0, k=2).collect()
    assert sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in got) == [(1, 1, 0.1), (2, 2, 1.0)]
