import json
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import embedding, fusion
from citeloom.plans import cli, reports, retrieval
from citeloom.plans.models import Embedder, EmbeddingCacheMiss, Reranker, RerankCacheMiss
from citeloom.plans.prompts import RERANK_PROMPTS
from citeloom.sources import payload, store
from citeloom.sources.golden import load_golden_set
from citeloom.streaming.questions import retrieve_stream
from stub_models import stub_complete, stub_embed

DIM = 16


FILES = {
    "terms.md": "# Supply Terms\n\nReference ST-1.\n\n## 1. Payment\n\nPayment is net 45 days from the invoice.\n\n## 2. Delivery\n\nDelivery takes 35 days for FRM-CRB frames.",
    "faq.txt": "PROCUREMENT FAQ\n\n1. LATE DELIVERY\n\nThe penalty is 1 percent per day.\n\n2. RETURNS\n\nA restocking fee of 10 percent applies.",
}
GOLDEN = """
- {id: q1, type: factual, phrasing: prose, question: "When is payment due?", expected_documents: [terms], expected_facts: ["45"], anchors: [net 45 days]}
- {id: q2, type: multi_hop, phrasing: code, cohort: extended, question: "What applies to FRM-CRB and returns?", expected_documents: [terms, faq], anchors: [FRM-CRB frames, restocking fee]}
- {id: q3, type: unanswerable, question: "How far is the moon?"}
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs").mkdir()
    for name, content in FILES.items():
        (tmp_path / "docs" / name).write_text(content)
    (tmp_path / "golden.yaml").write_text(GOLDEN)
    return tmp_path


@pytest.fixture
def embedder(spark, folder):
    return Embedder(spark, "m", str(folder / "vectors"), stub_embed, DIM)


def test_end_to_end(spark, folder, embedder):
    questions = load_golden_set(spark, str(folder / "golden.yaml"))
    retriever = retrieval.build_retriever(spark, str(folder / "docs"), embedder)
    hits = retriever.retrieve(questions, 3)
    top = {r["query_id"]: r["chunk_id"] for r in hits.where("keyword_rank = 1").collect()}
    assert top["q1"].startswith("terms::") and hits.groupBy("query_id").count().agg(F.max("count")).first()[0] == 3
    keyword = retriever.retrieve(questions, 3, "keyword")
    assert keyword.where("vector_rank is not null").count() == 0
    assert retriever.retrieve(questions, 0).count() == 0
    with pytest.raises(ValueError, match="unknown retrieval mode"):
        retriever.retrieve(questions, 3, "psychic")

    table = reports.evidence_markdown(fusion.evidence_rows(hits.where("query_id = 'q1'"))).splitlines()
    assert table[0].startswith("| # | document | section |") and len(table) == 5
    assert reports.evidence_markdown(fusion.evidence_rows(hits.limit(0))) == "Nothing was found."

    results = retrieval.evaluate_modes(retriever, questions, 3)
    alone = {r["query_id"]: r["recall"] for r in retrieval.evaluate_retrieval(retriever, questions, 3, "keyword").collect()}
    assert {r["query_id"]: r["recall"] for r in results.where("mode = 'keyword'").collect()} == alone
    assert "Means of each type, hybrid lists" in reports.retrieval_report(results, 3)

    answerer = retrieval.Answerer(retriever, "g", stub_complete)
    scored = {r["query_id"]: r for r in retrieval.evaluate_answers(answerer, questions, 3).collect()}
    assert scored["q1"]["facts_found"] == 1 and scored["q1"]["invalid_citations"] == ["9"]
    assert scored["q3"]["refused"] and scored["q3"]["refusal_correct"]
    with pytest.raises(ValueError, match="empty"):
        answerer.answer(spark.createDataFrame([("e", "  ")], "query_id string, question string"))
    with pytest.raises(retrieval.AnswerError):
        retrieval.Answerer(retriever, "g", lambda system, prompt, schema: "oops").answer(questions)


def test_vectors_are_cached_by_model_task_and_text(spark, folder, embedder):
    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one")], "chunk_id string, index_text string")
    first = {r["chunk_id"]: r["vector"] for r in embedder.documents(texts).collect()}
    assert first["a"] == first["c"] and embedder.cache_hits == 0 and embedder.api_calls == 1
    assert np.linalg.norm(first["a"]) == pytest.approx(1.0, abs=1e-6)
    offline = Embedder(spark, "m", embedder.cache, None, DIM)
    assert {r["chunk_id"]: r["vector"] for r in offline.documents(texts).collect()} == first
    assert offline.cache_hits == 3
    for changed in (Embedder(spark, "other", embedder.cache, None, DIM), Embedder(spark, "m", embedder.cache, None, DIM + 1)):
        with pytest.raises(EmbeddingCacheMiss):
            changed.documents(texts)
    with pytest.raises(EmbeddingCacheMiss):
        offline.questions(texts, "chunk_id", "index_text")


def test_a_model_that_returns_too_few_or_zero_vectors(spark):
    missing = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, text string").coalesce(1)
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        embedding.embed_missing(missing, lambda texts, task: [[1.0]], "T").collect()
    with pytest.raises(Exception, match="zero vector"):
        embedding.embed_missing(missing, lambda texts, task: [[0.0]] * len(texts), "T").collect()


def test_reranking_fills_and_reuses_its_cache(spark, folder, embedder):
    questions = load_golden_set(spark, str(folder / "golden.yaml"))
    retriever = retrieval.build_retriever(spark, str(folder / "docs"), embedder)
    plain = retriever.retrieve(questions, 20).where("query_id = 'q1'").orderBy("rank").collect()
    retriever.reranker = Reranker(spark, "r", str(folder / "orders"), stub_complete)
    first = retriever.retrieve(questions, 2).where("query_id = 'q1'").orderBy("rank").collect()
    assert [r["chunk_id"] for r in first] == [r["chunk_id"] for r in plain[::-1][:2]]
    assert retriever.reranker.api_calls == 3
    retriever.reranker = Reranker(spark, "r", str(folder / "orders"))
    again = retriever.retrieve(questions, 2).where("query_id = 'q1'").orderBy("rank").collect()
    assert again == first and retriever.reranker.cache_hits == 3
    retriever.reranker = Reranker(spark, "r", str(folder / "orders"), prompt="base")
    with pytest.raises(RerankCacheMiss):
        retriever.retrieve(questions, 2)
    with pytest.raises(ValueError, match="unknown reranker prompt"):
        Reranker(spark, "r", "x", prompt="other")
    assert RERANK_PROMPTS["conflict-aware"].startswith(RERANK_PROMPTS["base"])


def chunk_rows(spark, n, seed=1, dim=8):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    chunks = [(f"d::{i:03d}", "d", "D", "d.md", "", f"t{seed}-{i}", f"D t{i}", i) for i in range(n)]
    schema = "chunk_id string, doc_id string, doc_title string, source_path string, section string, text string, index_text string, ordinal int"
    vectors = [(c[0], x.tolist()) for c, x in zip(chunks, v)]
    return spark.createDataFrame(chunks, schema), spark.createDataFrame(vectors, "chunk_id string, vector array<float>")


def test_stores_refuse_what_does_not_fit(spark):
    chunks, vectors = chunk_rows(spark, 4)
    target = store.TableStore()
    for bad_chunks, bad_vectors, message in (
        (chunks, vectors.where("chunk_id <> 'd::001'"), "lack a vector"),
        (chunks.unionByName(chunks.limit(1)), vectors, "unique"),
        (chunks, vectors.unionByName(vectors.limit(1)), "unique"),
        (chunks.unionByName(chunks.limit(1)), vectors.unionByName(vectors.limit(1)), "unique"),
        (chunks.limit(0), vectors.limit(0), "nothing to add"),
        (chunks, vectors.withColumn("vector", F.transform("vector", lambda x: x * 2)), "length 1"),
        (chunks, vectors.withColumn("vector", F.when(F.col("chunk_id") == "d::000", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector"))), "one dimension"),
    ):
        with pytest.raises(ValueError, match=message):
            target.add(bad_chunks, bad_vectors)
    target.add(chunks, vectors)
    with pytest.raises(ValueError, match="holds vectors of dimension"):
        target.add(*chunk_rows(spark, 2, dim=4))


@pytest.mark.parametrize("kind", ["table", "cells"])
def test_stores_replace_persist_and_reload(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    target = store.TableStore() if kind == "table" else store.CellStore(spark, path)
    assert target.count() == 0
    assert target.search(chunk_rows(spark, 1)[1].withColumnRenamed("chunk_id", "query_id")).count() == 0
    target.add(*chunk_rows(spark, 40))
    target.add(*chunk_rows(spark, 10, seed=2))
    assert target.count() == 40
    texts = {r["chunk_id"]: r["text"] for r in target.chunks().collect()}
    assert texts["d::003"] == "t2-3" and texts["d::030"] == "t1-30"
    target.persist(path)
    again = (store.TableStore if kind == "table" else store.CellStore).load(spark, path)
    asked = chunk_rows(spark, 6, seed=9)[1].withColumnRenamed("chunk_id", "query_id")
    rows = sorted(map(str, again.search(asked, 5).collect()))
    assert rows == sorted(map(str, target.search(asked, 5).collect())) and len(rows) == 30
    with pytest.raises(FileNotFoundError):
        type(again).load(spark, str(tmp_path / "absent"))


def test_the_two_stores_agree_and_a_cell_store_is_bound_to_its_folder(spark, tmp_path):
    table, cells = store.TableStore(), store.CellStore(spark, str(tmp_path / "c"))
    for target in (table, cells):
        target.add(*chunk_rows(spark, 60))
    asked = chunk_rows(spark, 5, seed=4)[1].withColumnRenamed("chunk_id", "query_id")
    assert sorted(map(str, table.search(asked, 10).collect())) == sorted(map(str, cells.search(asked, 10).collect()))
    with pytest.raises(ValueError, match="holds vectors of dimension"):
        cells.add(*chunk_rows(spark, 2, dim=4))
    with pytest.raises(ValueError, match="not copied"):
        cells.persist(str(tmp_path / "elsewhere"))
    with pytest.raises(ValueError, match="unknown store"):
        retrieval.build_retriever(spark, "x", None, store="shelf")


def test_command_line(spark, folder, capsys):
    shared = [
        "--documents", str(folder / "docs"), "--golden", str(folder / "golden.yaml"), "--index", str(folder / "index"),
        "--vectors", str(folder / "vectors"), "--orderings", str(folder / "orders"), "--results", str(folder / "results.json"), "--dim", str(DIM),
    ]
    models = ["--embed", "stub_models:stub_embed", "--complete", "stub_models:stub_complete"]
    with pytest.raises(EmbeddingCacheMiss):
        cli.main([*shared, "index", "--offline"], spark)
    assert cli.main([*shared, *models, "index", "--rerank"], spark) == 0
    assert "documents: 2" in capsys.readouterr().out
    assert cli.main([*shared, "eval", "--retrieval-only", "--rerank", "--k", "3"], spark) == 0
    assert "Reordered lists of 3" in capsys.readouterr().out
    assert cli.main([*shared, *models, "eval", "--k", "3"], spark) == 0
    assert json.loads((folder / "results.json").read_text())["top_k"] == 3
    assert cli.main([*shared, *models, "ask", "When is payment due?", "--verbose"], spark) == 0
    assert "Cited:\n- [1]" in capsys.readouterr().out
    assert cli.main([*shared, "ask", "When?"], spark) == 1
    assert cli.main([*shared, "ask", "When is payment due?"], spark) == 0
    assert "| # | document |" in capsys.readouterr().out
    (folder / "index" / "table" / "left").mkdir()
    assert cli.main([*shared, *models, "index", "--refresh"], spark) == 0
    assert not (folder / "index" / "table" / "left").exists()


def test_orderings_in_json_files_are_used(spark, folder, embedder):
    questions = load_golden_set(spark, str(folder / "golden.yaml"))
    retriever = retrieval.build_retriever(spark, str(folder / "docs"), embedder)
    retriever.reranker = Reranker(spark, "r", str(folder / "orders"), stub_complete)
    first = sorted(map(str, retriever.retrieve(questions, 2).collect()))
    (folder / "files").mkdir()
    for row in spark.read.parquet(str(folder / "orders")).collect():
        stored = {name: row[name] for name in ("model", "prompt", "question", "candidates", "order")}
        (folder / "files" / f"{row['key']}.json").write_text(json.dumps(stored))
    retriever.reranker = Reranker(spark, "r", str(folder / "none"), files=str(folder / "files"))
    assert sorted(map(str, retriever.retrieve(questions, 2).collect())) == first and retriever.reranker.cache_hits == 3


def test_a_stream_of_questions_gets_the_batch_lists(spark, folder, embedder):
    retriever = retrieval.build_retriever(spark, str(folder / "docs"), embedder)
    questions = load_golden_set(spark, str(folder / "golden.yaml")).select("query_id", "question")
    questions.repartition(3).write.parquet(str(folder / "incoming"))
    stream = spark.readStream.schema(questions.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "incoming"))
    running = retrieve_stream(stream, retriever, str(folder / "out"), str(folder / "checkpoint"), 3)
    running.awaitTermination(120)
    columns = ["query_id", "rank", "chunk_id", "score"]
    got = spark.read.parquet(str(folder / "out")).select(*columns)
    want = retriever.retrieve(questions, 3).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_asking_reads_the_stored_index_and_not_the_documents(spark, folder, capsys):
    shared = [
        "--documents", str(folder / "docs"), "--golden", str(folder / "golden.yaml"), "--index", str(folder / "index"),
        "--vectors", str(folder / "vectors"), "--results", str(folder / "results.json"), "--dim", str(DIM),
        "--embed", "stub_models:stub_embed", "--complete", "stub_models:stub_complete",
    ]
    for store_kind in ("table", "cells"):
        chosen = ["--store", store_kind, *shared]
        capsys.readouterr()
        assert cli.main([*chosen, "ask", "When is payment due?", "--verbose"], spark) == 0  # nothing stored yet
        built = capsys.readouterr().out
        assert cli.main([*chosen, "index"], spark) == 0
        (folder / "docs").rename(folder / "away")
        capsys.readouterr()
        assert cli.main([*chosen, "ask", "When is payment due?", "--verbose"], spark) == 0
        assert capsys.readouterr().out == built
        assert cli.main([*chosen, "eval", "--k", "2"], spark) == 0
        with pytest.raises(FileNotFoundError):
            cli.main([*chosen, "ask", "When is payment due?", "--rebuild"], spark)
        (folder / "away").rename(folder / "docs")


def test_calls_are_counted_where_they_are_made(spark, folder):
    calls = folder / "calls"
    calls.mkdir()

    def counted(texts, task):
        (calls / uuid.uuid4().hex).touch()
        return stub_embed(texts, task)

    texts = spark.range(450).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("index_text")).repartition(7)
    used = Embedder(spark, "m", str(folder / "vectors"), counted, DIM)
    assert used.documents(texts).count() == 450
    assert used.api_calls == len(list(calls.iterdir())) >= 5 and used.cache_hits == 0
    assert used.documents(texts).count() == 450 and used.api_calls == len(list(calls.iterdir())) and used.cache_hits == 450


def test_texts_are_read_from_the_buckets_of_the_hits_alone(spark):
    table = f"payload_{uuid.uuid4().hex}"
    content = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text"))
    payload.write(content, table, 16)
    hits = spark.createDataFrame([("q", "c5", 1), ("q", "c7", 2), ("p", "c5", 1), ("p", "absent", 2)], "query_id string, chunk_id string, rank int")
    got = payload.fetched(spark, table, hits)
    assert {(r.query_id, r.rank, r.text) for r in got.collect()} == {("q", 1, "text 5"), ("q", 2, "text 7"), ("p", 1, "text 5")}
    # Without this the plan reads the same files but does not say how many buckets they are.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    shown = payload.fetched(spark, table, hits)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    read = re.search(r"SelectedBucketsCount: (\d+) out of 16", shown)
    assert read and int(read.group(1)) <= 3
    many = hits.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(5100))).alias("i")).select("query_id", F.concat(F.lit("c"), F.col("i") % 2000, F.when(F.col("i") > 1999, "x").otherwise("")).alias("chunk_id"))
    joined = payload.fetched(spark, table, many)
    assert joined.count() == 4 * 2000
