import math

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from citeloom.operators import bm25, fusion, knn, topk
from citeloom.sources.keyword_index import KeywordIndex, write

CORPUS = {
    "d::000": "the late penalty is 0.5 percent of the order",
    "d::001": "the frame FRM-CRB-52 ships in 35 days",
    "d::002": "the warranty on frames runs for 24 months",
    "d::003": "the escalation goes to the manager of the chain",
    "d::004": "frames and more frames",
    "d::005": "",
}


def words(text):
    import re

    out = []
    for w in re.findall(r"[a-z0-9]+(?:[-./][a-z0-9]+)*", text.lower()):
        out += [w] + (re.split("[-./]", w) if re.search("[-./]", w) else [])
    return out


def brute_force(corpus, question):
    docs = {c: words(t) for c, t in corpus.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    vocabulary = {w for d in docs.values() for w in d}
    df = {w: sum(w in d for d in docs.values()) for w in vocabulary}
    raw = {w: math.log(n - df[w] + 0.5) - math.log(df[w] + 0.5) for w in vocabulary}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if raw[w] < 0 else raw[w] for w in vocabulary}
    scores = {}
    for c, d in docs.items():
        total = 0.0
        for w in words(question):
            f = d.count(w)
            if f:
                total += idf[w] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
        if total > 0:
            scores[c] = total
    return sorted(scores.items(), key=lambda x: (-round(x[1], 8), x[0]))


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame(list(CORPUS.items()), "chunk_id string, index_text string").repartition(3)
    return bm25.build(chunks)


QUESTIONS = ["FRM-CRB lead time", "the the frames", "frames months penalty", "nothing known", "", "THE"]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, question string")


def lists(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


def test_bm25_is_the_published_formula(index, questions):
    got = lists(bm25.search(index, questions, 20))
    for i, question in enumerate(QUESTIONS):
        want = brute_force(CORPUS, question)
        assert [c for c, _ in got.get(i, [])] == [c for c, _ in want]
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want], abs=1e-7)


def test_all_ways_to_search_agree(spark, index, questions, tmp_path):
    shipped = lists(bm25.search(index, questions, 3))
    grid = lists(bm25.search(index, questions, 3, max_weights=2))
    counted = bm25.Bm25Index(bm25.postings(index.chunks), index.terms, index.stats)
    joined = lists(bm25.search(counted, questions, 3))
    assert lists(bm25.search(counted, questions, 3, max_weights=2)) == grid
    write(index, str(tmp_path / "keywords"))
    stored = lists(KeywordIndex.load(spark, str(tmp_path / "keywords")).search(questions, 3))
    assert shipped == grid == joined == stored


def test_terms_in_exactly_half_the_chunks_do_not_match(spark):
    chunks = spark.createDataFrame([(f"c{i}", "half x" if i < 2 else "y z") for i in range(4)], "chunk_id string, index_text string")
    asked = spark.createDataFrame([(1, "half")], "query_id int, question string")
    assert bm25.search(bm25.build(chunks), asked, 5).count() == 0


def test_k_of_zero_and_an_empty_corpus(spark, index, questions):
    assert bm25.search(index, questions, 0).count() == 0
    nothing = bm25.build(spark.createDataFrame([], "chunk_id string, index_text string"))
    assert bm25.search(nothing, questions, 5).count() == 0
    with pytest.raises(FileNotFoundError):
        KeywordIndex.load(spark, "/tmp/no-such-keyword-index")


def test_searching_the_corpus_does_not_shuffle_it(index, questions):
    plan = bm25.search(index, questions, 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    # The only exchange under the scoring step is the fixture's own repartitioning.
    assert below.count("Exchange") == 1 and "REPARTITION" in below
    assert plan.index("WindowGroupLimit") < plan.index("MapInArrow")


def unit_rows(n, dim, seed):
    v = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(f"doc::{i:03d}", v.tolist()) for i, v in enumerate(unit_rows(300, 16, 7))]
    return spark.createDataFrame(rows, "chunk_id string, vector array<float>").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(unit_rows(25, 16, 99))]
    return spark.createDataFrame(rows, "query_id int, vector array<float>")


def test_exact_search_is_brute_force(stored, asked):
    got = lists(knn.exact_topk(stored, asked, 10))
    v, q = unit_rows(300, 16, 7).astype(float), unit_rows(25, 16, 99).astype(float)
    for i in range(25):
        scores = np.round(v @ q[i], 8)
        order = sorted(range(300), key=lambda j: (-scores[j], f"doc::{j:03d}"))[:10]
        assert [c for c, _ in got[i]] == [f"doc::{j:03d}" for j in order]


def test_grid_and_full_probing_give_the_exact_lists(stored, asked):
    exact = lists(knn.exact_topk(stored, asked, 10))
    assert lists(knn.exact_topk(stored, asked, 10, max_cells=100)) == exact
    centroids = knn.pick_centroids(stored)
    count = centroids.count()
    assert count == 18
    cells = knn.assign_cells(stored, centroids)
    assert lists(knn.cell_topk(cells, centroids, asked, 10, probes=count)) == exact
    few = lists(knn.cell_topk(cells, centroids, asked, 10, probes=4))
    assert lists(knn.cell_topk(cells, centroids, asked, 10, probes=4, max_cells=50, shard_rows=7)) == few


def test_one_cell_with_most_rows(spark, asked):
    hot = unit_rows(1, 16, 3)[0]
    rows = [(f"h{i:03d}", hot.tolist()) for i in range(200)] + [(f"x{i}", v.tolist()) for i, v in enumerate(unit_rows(50, 16, 5))]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    centroids = spark.createDataFrame([(0, hot.tolist()), (1, rows[210][1])], "cell int, vector array<float>")
    cells = knn.assign_cells(vectors, centroids)
    exact = lists(knn.exact_topk(vectors, asked, 7))
    assert lists(knn.cell_topk(cells, centroids, asked, 7, probes=2)) == exact
    assert lists(knn.cell_topk(cells, centroids, asked, 7, probes=2, max_cells=64, shard_rows=20)) == exact


def test_small_cells_are_topped_up(spark, stored, asked):
    centroids = knn.pick_centroids(stored, 150)
    cells = knn.assign_cells(stored, centroids)
    got = lists(knn.cell_topk(cells, centroids, asked, 30, probes=1))
    assert {len(hits) for hits in got.values()} == {30}
    assert {len(hits) for hits in lists(knn.cell_topk(cells, centroids, asked, 400, probes=1)).values()} == {300}


def test_survivors_of_many_tasks_are_merged_in_two_rounds(spark, stored, asked):
    partial = knn.exact_topk(stored, asked, 10).drop("rank")
    twice = topk.merge(partial, 4)
    assert lists(topk.rank_within(partial, "query_id", "score", "chunk_id", 4)) == lists(twice)
    assert twice.columns == ["query_id", "chunk_id", "score", "rank"]


def test_survivors_wait_for_few_merges():
    rng = np.random.default_rng(1)
    scores = np.round(rng.random((3000, 40)), 2)
    whole, best = topk.BestPerQuery(40, 7, -np.inf), topk.BestPerQuery(40, 7, -np.inf)
    whole.offer(scores, np.arange(3000))
    for low in range(0, 3000, 11):
        best.offer(scores[low : low + 11], np.arange(low, min(low + 11, 3000)))
    for kept in (whole, best):
        kept._merge()
    assert (whole.query == best.query).all() and (whole.id == best.id).all() and (whole.score == best.score).all()
    for q in range(40):
        want = np.lexsort((np.arange(3000), -scores[:, q]))[:7]
        assert best.id[best.query == q].tolist() == want.tolist()


def test_postings_leave_no_pairs_and_no_term_exchange(spark, index, questions):
    counted = bm25.Bm25Index(bm25.postings(index.chunks), index.terms, index.stats)
    plan = bm25.search(counted, questions, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(term" not in plan


def test_more_centroids_than_are_shipped(spark, stored):
    centroids = knn.pick_centroids(stored, 60)
    one, other = knn.assign_cells(stored, centroids), knn.assign_cells(stored, centroids, max_cells=100, shard_rows=20)
    both = one.select("chunk_id", "cell").join(other.select("chunk_id", F.col("cell").alias("again")), "chunk_id")
    assert both.count() == stored.count() and both.where("cell <> again").count() == 0


def test_chunks_without_text_are_counted_as_empty(spark):
    chunks = spark.createDataFrame([("a", "word"), ("b", None), ("c", "other")], "chunk_id string, index_text string")
    found = bm25.build(chunks)
    assert (found.stats.n, found.stats.avgdl) == (3, pytest.approx(2 / 3))
    asked = spark.createDataFrame([(1, "word")], "query_id int, question string")
    assert [r["chunk_id"] for r in bm25.search(found, asked, 5).collect()] == ["a"]


def test_ties_and_bounds(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    tied = spark.createDataFrame([("doc::002", v), ("doc::001", v)], "chunk_id string, vector array<float>")
    question = spark.createDataFrame([(1, v)], "query_id int, vector array<float>")
    assert [r["chunk_id"] for r in knn.exact_topk(tied, question, 9).orderBy("rank").collect()] == ["doc::001", "doc::002"]
    assert knn.exact_topk(tied, question, 0).count() == 0
    assert knn.exact_topk(tied.limit(0), question, 3).count() == 0
    wrong = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    with pytest.raises(PythonException, match="dimension"):
        knn.exact_topk(tied, wrong, 1).collect()


def test_fusion_adds_reciprocal_ranks_and_keeps_evidence(spark):
    schema = "query_id int, chunk_id string, score double, rank int"
    vector = spark.createDataFrame([(1, "both", 0.9, 1), (1, "only-v", 0.8, 2)], schema)
    keyword = spark.createDataFrame([(1, "only-k", 7.0, 1), (1, "both", 6.0, 2), (2, "solo", 1.0, 1)], schema)
    got = {(r["query_id"], r["chunk_id"]): r for r in fusion.fuse(vector, keyword, 5).withColumn("paths", fusion.paths()).collect()}
    assert got[1, "both"]["score"] == pytest.approx(1 / 4 + 1 / 5) and got[1, "both"]["rank"] == 1
    assert got[1, "both"]["paths"] == "vector#1+bm25#2" and got[1, "only-v"]["paths"] == "vector#2"
    assert got[1, "only-k"]["vector_rank"] is None and got[1, "only-k"]["keyword_score"] == 7.0
    assert got[2, "solo"]["score"] == 1 / 4
    single = {(r["query_id"], r["chunk_id"]): r["score"] for r in fusion.fuse(None, keyword, 5).collect()}
    assert single[1, "only-k"] == 1 / 4 and (1, "only-v") not in single
    modes = fusion.fuse_modes(vector, keyword, 5)
    for mode, lists_ in (("hybrid", (vector, keyword)), ("vector", (vector, None)), ("keyword", (None, keyword))):
        one = fusion.fuse(*lists_, 5).select("query_id", "chunk_id", "rank", "score", *fusion.EVIDENCE)
        same = modes.where(F.col("mode") == mode).select("query_id", "chunk_id", "rank", "score", *fusion.EVIDENCE)
        assert sorted(map(str, one.collect())) == sorted(map(str, same.collect()))
    assert fusion.fuse(vector, keyword, 0).count() == 0
    with pytest.raises(ValueError):
        fusion.fuse(None, None)


def test_questions_beyond_the_bound_take_one_job_not_one_per_block(spark, stored, monkeypatch):
    asked = stored.withColumnRenamed("chunk_id", "query_id")
    exact = lists(knn.exact_topk(stored, asked, 5))
    monkeypatch.setattr(knn, "_CELL_NUMBERS", 16 * 90)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("every pair", "")
    found = knn.exact_topk(stored, asked, 5, max_cells=32)
    context.setLocalProperty("spark.jobGroup.id", None)
    # 300 questions in blocks of two: bounded looks at both sides, and no job for each block.
    assert len(tracker.getJobIdsForGroup("every pair")) < 12
    assert lists(found) == exact


def test_no_array_of_a_search_grows_with_the_batch(spark, index, questions, monkeypatch):
    text = " ".join(f"w{i % 50} frames" for i in range(200))
    chunks = spark.createDataFrame([(f"c{i:04d}", f"once{i} more{i} " * 3 + ("frames months" if i % 3 else text)) for i in range(900)], "chunk_id string, index_text string").coalesce(1)
    asked = spark.createDataFrame([(1, "once7 more8"), (2, "w3 w4")], "query_id int, question string")
    whole = bm25.build(chunks)
    counted = bm25.Bm25Index(bm25.postings(whole.chunks), whole.terms, whole.stats)
    want = lists(bm25.search(whole, asked, 30))
    assert [c for c, _ in want[1]] == ["c0007", "c0008"] and len(want[2]) == 30 and lists(bm25.search(counted, asked, 30)) == want
    batch = whole.chunks.toArrow().combine_chunks().to_batches()[0]
    pieces = list(bm25._pieces(batch, "tokens"))
    sizes = [len(p.column("tokens").flatten()) for p in pieces]
    assert len(pieces) == 1 and sum(p.num_rows for p in pieces) == 900
    monkeypatch.setattr(bm25, "_PIECE_WORDS", 1000)
    pieces = list(bm25._pieces(batch, "tokens"))
    assert sum(sizes) == sum(len(p.column("tokens").flatten()) for p in pieces) and max(len(p.column("tokens").flatten()) for p in pieces) <= 1000
    # Cut or whole, the same rows are counted.
    row, term, tf = bm25._asked(batch.slice(5, 3), batch.column("tokens").flatten().unique())
    assert row.tolist() == sorted(row.tolist()) and set(row.tolist()) == {0, 1, 2} and tf.sum() == len(batch.slice(5, 3).column("tokens").flatten())


def test_tasks_are_handed_bounded_batches(spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    rows = spark.range(40_000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 8 << 20
