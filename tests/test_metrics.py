import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators import metrics
from citeloom.sources import caches
from citeloom.sources.golden import SCHEMA, examples, load_golden_set, validated

HITS = "query_id string, rank int, doc_id string, text string"


def question(id, type="factual", docs=("a",), anchors=("x",), facts=(), phrasing="prose", cohort="original"):
    return (id, type, f"{id}?", list(docs), list(facts), "", phrasing, list(anchors), cohort)


def scored(spark, questions, hits):
    rows = metrics.retrieval_results(spark.createDataFrame(hits, HITS), spark.createDataFrame(questions, SCHEMA))
    return {r["query_id"]: r for r in rows.collect()}


def test_recall_coverage_and_reciprocal_rank(spark):
    got = scored(
        spark,
        [question("half", docs=["a", "b"]), question("third"), question("miss"), question("none"), question("u", "unanswerable", [], [])],
        [
            ("half", 1, "x", ""), ("half", 2, "a", ""),
            ("third", 1, "x", ""), ("third", 2, "x", ""), ("third", 3, "y", ""), ("third", 4, "a", ""),
            ("miss", 1, "x", ""), ("u", 1, "a", ""),
        ],
    )
    assert set(got) == {"half", "third", "miss", "none"}
    assert [got["half"][m] for m in ("recall", "full_coverage", "mrr")] == [0.5, 0.0, 0.5]
    # Rank counts distinct documents, not chunks.
    assert got["third"]["mrr"] == pytest.approx(1 / 3) and got["third"]["recall"] == 1.0
    assert [got["miss"][m] for m in ("recall", "full_coverage", "mrr")] == [0.0, 0.0, 0.0]
    assert got["none"]["retrieved_documents"] == [] and got["none"]["mrr"] == 0.0


def test_anchors_ignore_line_wraps_but_do_not_span_chunks(spark):
    got = scored(
        spark,
        [question("w", anchors=["net 45 days", "from  date"]), question("s", anchors=["end start"])],
        [("w", 1, "a", "net\n45 days"), ("w", 2, "a", "other"), ("s", 1, "a", "the end"), ("s", 2, "a", "start of")],
    )
    assert (got["w"]["anchor_recall"], got["w"]["anchor_full"]) == (0.5, 0.0)
    assert got["s"]["anchor_recall"] == 0.0


def test_summaries_and_breakdowns(spark):
    rows = metrics.retrieval_results(
        spark.createDataFrame([("1", 1, "a", "x"), ("2", 1, "b", "x")], HITS),
        spark.createDataFrame([question("1"), question("2", "multi_hop", ["a", "b"], phrasing="code", cohort="extended")], SCHEMA),
    )
    total = metrics.retrieval_summary(rows).first()
    assert (total["questions"], total["recall"], total["full_coverage"]) == (2, 0.75, 0.5)
    table = {(r["axis"], r["value"]): r for r in metrics.retrieval_breakdown(rows.withColumn("mode", F.lit("hybrid"))).collect()}
    assert len(table) == 7
    assert table["type", "multi_hop"]["recall"] == 0.5 and table["phrasing", "code"]["questions"] == 1
    nothing = metrics.retrieval_summary(rows.limit(0)).first()
    assert nothing["questions"] == 0 and nothing["mrr"] == 0.0


def test_rerank_comparison_and_moves(spark):
    asked = spark.createDataFrame([question("1"), question("2")], SCHEMA)
    before = metrics.retrieval_results(spark.createDataFrame([("1", 1, "a", "no"), ("2", 1, "a", "x")], HITS), asked)
    after = metrics.retrieval_results(spark.createDataFrame([("1", 1, "a", "x"), ("2", 1, "a", "no")], HITS), asked)
    moves = {r["query_id"]: r["direction"] for r in metrics.moved_questions(before, after).collect()}
    assert moves == {"1": "recovered", "2": "LOST"}
    change = {r["metric"]: r["change"] for r in metrics.rerank_comparison(before, after).collect()}
    assert change["anchor_recall"] == 0.0 and len(change) == 5


ANSWERS = "query_id string, text string, citations array<int>, invalid_citations array<int>, refused boolean, conflict boolean, grounded boolean"


def answered(spark, kinds, refused, conflict=False, grounded=True):
    asked = spark.createDataFrame([question(str(i), t, facts=["45"] if t == "factual" else []) for i, t in enumerate(kinds)], SCHEMA)
    rows = [(str(i), "net 145 days [1]", [1], [], refused, conflict, grounded) for i in range(len(kinds))]
    return metrics.answer_results(spark.createDataFrame(rows, ANSWERS), asked)


def test_refusing_everything_and_nothing(spark):
    kinds = ["factual", "unanswerable"]
    always = metrics.answer_summary(answered(spark, kinds, True)).first()
    never = metrics.answer_summary(answered(spark, kinds, False)).first()
    assert (always["refusal_accuracy"], always["false_refusal_rate"]) == (1.0, 1.0)
    assert (never["refusal_accuracy"], never["false_refusal_rate"]) == (0.0, 0.0)
    # Facts are raw substrings.
    assert never["fact_coverage"] == 1.0 and never["citation_validity"] == 1.0
    correct = {r["query_id"]: r["refusal_correct"] for r in answered(spark, kinds, True).collect()}
    assert correct == {"0": False, "1": True}


def test_conflict_rates_leave_out_underspecified_questions(spark):
    got = metrics.answer_summary(answered(spark, ["contradiction", "underspecified", "factual", "unanswerable"], False, True)).first()
    assert (got["conflict_detection"], got["false_conflict_rate"]) == (1.0, 1.0)
    only = metrics.answer_summary(answered(spark, ["underspecified"], False, True)).first()
    assert (only["conflict_detection"], only["false_conflict_rate"]) == (0.0, 0.0)


@pytest.mark.parametrize(
    "bad, message",
    [
        (question("q", "riddle"), "unknown type"),
        (question("q", phrasing="verse"), "unknown phrasing"),
        (question("q", cohort="later"), "unknown cohort"),
        (question("q", docs=[]), "names no expected"),
        (question("q", "unanswerable", ["a"], []), "names expected documents"),
        (question("q", anchors=[]), "has no anchor"),
        (question("q", "unanswerable", [], ["x"]), "has anchor texts"),
        (question("p"), "duplicate"),
    ],
)
def test_golden_sets_are_validated(spark, bad, message):
    with pytest.raises(ValueError, match=message):
        validated(spark.createDataFrame([question("p"), bad], SCHEMA))


def test_golden_sets_are_read_from_yaml(spark, tmp_path):
    path = tmp_path / "golden.yaml"
    path.write_text('- {id: q1, type: factual, question: "How long?", expected_documents: [a], expected_facts: [45], anchors: ["net 45"]}\n')
    row = load_golden_set(spark, str(path)).first()
    assert (row["query_id"], row["expected_facts"], row["phrasing"], row["cohort"]) == ("q1", ["45"], "prose", "original")
    path.write_text("{}")
    with pytest.raises(ValueError, match="list of questions"):
        load_golden_set(spark, str(path))
    with pytest.raises(FileNotFoundError):
        load_golden_set(spark, str(tmp_path / "absent.yaml"))


def test_examples_keep_their_order(spark):
    asked = spark.createDataFrame([question("1"), question("2"), question("3")], SCHEMA)
    got = examples(asked, {"3": "last first", "x": "absent", "1": "then this"}).orderBy("place").collect()
    assert [(r["label"], r["question"]) for r in got] == [("last first", "3?"), ("then this", "1?")]


def test_results_files(spark, tmp_path):
    asked = spark.createDataFrame([question("1"), question("u", "unanswerable", [], [])], SCHEMA)
    rows = metrics.retrieval_results(spark.createDataFrame([("1", 1, "a", "x")], HITS), asked).withColumn("mode", F.lit("hybrid"))
    payload = caches.results_payload(rows, answered(spark, ["factual"], False), asked, 5, "g", "e")
    path = caches.write_results(payload, str(tmp_path / "results.json"))
    got = caches.read_results(path)
    assert got == json.loads(json.dumps(payload))
    assert got["golden_set"] == {"questions": 2, "by_type": {"factual": 1, "unanswerable": 1}, "answerable": 1}
    assert got["retrieval"]["hybrid"]["recall"] == 1.0 and got["reranker"] == {"enabled": False}
    assert got["retrieval_by_cohort"]["extended"] == dict.fromkeys(("questions", *metrics.RETRIEVAL_METRICS), 0)
    assert caches.read_results(str(tmp_path / "absent.json")) is None
    (tmp_path / "bad.json").write_text("{")
    assert caches.read_results(str(tmp_path / "bad.json")) is None
