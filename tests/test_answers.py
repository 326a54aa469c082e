import hashlib
import json

import pytest

from citeloom.operators import answers, context, rerank


def validated(spark, payload, passages=3):
    raw = payload if isinstance(payload, str) else json.dumps(payload)
    rows = spark.createDataFrame([("q", raw, passages)], "query_id string, response string, passages int")
    return answers.validate(rows).first()


def body(answer, citations=(), **flags):
    return {"answer": answer, "citations": list(citations), **flags}


def test_valid_answer(spark):
    got = validated(spark, body(" Net 45 days [1]. ", [1], refused=False, conflict=False))
    assert (got["text"], got["citations"], got["invalid_citations"], got["grounded"]) == ("Net 45 days [1].", [1], [], True)
    assert got["error"] is None


def test_markers_outside_the_context_are_removed(spark):
    got = validated(spark, body("Fine [1]. Made up [7] .", [1]))
    assert (got["text"], got["citations"], got["invalid_citations"], got["grounded"]) == ("Fine [1]. Made up.", [1], ["7"], False)


def test_numbers_of_any_size(spark):
    got = validated(spark, body("Far [5000000000] off [99999999999999999999999]", [3, 20000000000000000000]))
    assert got["invalid_citations"] == ["5000000000", "20000000000000000000", "99999999999999999999999"]
    assert (got["citations"], got["text"], got["grounded"]) == ([3], "Far off", False)


def test_declared_only_and_malformed_members(spark):
    got = validated(spark, body("No marker", [9, "2", True, 1.0, None, 2]))
    assert (got["citations"], got["invalid_citations"]) == ([2], ["9"])


def test_order_is_by_first_use_then_declared(spark):
    assert validated(spark, body("B [3] a [1] again [3]", [2, 1]))["citations"] == [3, 1, 2]


def test_text_is_tidied_only_when_something_was_removed(spark):
    assert validated(spark, body("a  b , c [1]"))["text"] == "a  b , c [1]"
    assert validated(spark, body("a  b , c [8]"))["text"] == "a b, c"


def test_flags_follow_truth(spark):
    got = validated(spark, body("x", refused="false", conflict=None))
    assert (got["refused"], got["conflict"]) == (True, False)


@pytest.mark.parametrize("raw, error", [("", "empty response"), ("nope", "not JSON"), ("[1]", "not a JSON object"), ("3", "not a JSON object")])
def test_unusable_responses(spark, raw, error):
    assert validated(spark, raw)["error"] == error


@pytest.fixture
def hits(spark):
    return spark.createDataFrame(
        [
            ("q", 1, "a::000", "a", "Doc A", "1. One", "a.md", "text one"),
            ("q", 2, "b::000", "b", "Doc B", "", "b.md", "text two"),
            ("q", 3, "a::001", "a", "Doc A", "2. Two", "a.md", "text three"),
        ],
        "query_id string, rank int, chunk_id string, doc_id string, doc_title string, section string, source_path string, text string",
    )


def test_citations_resolve_to_passages(spark, hits):
    rows = spark.createDataFrame([("q", json.dumps(body("x [3] y [2] z [1]")), 3)], "query_id string, response string, passages int")
    resolved = answers.resolve(answers.validate(rows), hits)
    labels = [r["label"] for r in resolved.orderBy("place").collect()]
    assert labels == ["[3] Doc A, 2. Two (a.md)", "[2] Doc B (b.md)", "[1] Doc A, 1. One (a.md)"]
    assert answers.cited_documents(resolved).first()["cited_documents"] == ["a", "b"]


def test_prompts(spark, hits):
    asked = spark.createDataFrame([("q", "Why?"), ("none", "Who?")], "query_id string, question string")
    got = {r["query_id"]: r["prompt"] for r in context.answer_prompts(asked, hits).collect()}
    assert got["q"].startswith("Context passages:\n\n[1] Doc A, 1. One (source: a.md)\ntext one\n\n[2] Doc B (source: b.md)\ntext two")
    assert got["q"].endswith("\n\nQuestion: Why?")
    assert got["none"] == "Context passages:\n\n(no passages were retrieved)\n\nQuestion: Who?"
    ranked = context.rerank_prompts(asked, hits).first()["prompt"]
    assert ranked.startswith("Question: Why?\n\nPassages:\n\n[1] Doc A, 1. One\ntext one\n\n[2] Doc B\n")


@pytest.fixture
def ranked(spark):
    return spark.createDataFrame(
        [("q", f"c{i}", i + 1, 1.0 / (i + 1), i + 1) for i in range(6)] + [("single", "c9", 1, 1.0, 1)],
        "query_id string, chunk_id string, rank int, score double, vector_rank int",
    )


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([("q", "what?"), ("single", "who?")], "query_id string, question string")


def key_of(model, prompt, question, ids):
    digest = hashlib.sha256(prompt.encode()).hexdigest()[:12]
    return hashlib.sha256("|".join([model, digest, question, ",".join(ids)]).encode()).hexdigest()


def stored(spark, order, key):
    return spark.createDataFrame([(key, order)], "key string, `order` array<int>")


def test_reranking_applies_the_stored_ordering(spark, ranked, asked):
    key = key_of("m", "p", "what?", [f"c{i}" for i in range(6)])
    orderings = stored(spark, [4, 2, 0, 1, 3, 5], key)
    got = rerank.rerank(ranked, asked, orderings, "m", "p", 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["chunk_id"], r["vector_rank"]) for r in got] == [
        ("q", 1, "c4", 5), ("q", 2, "c2", 3), ("q", 3, "c0", 1), ("single", 1, "c9", 1),
    ]
    assert rerank.rerank(ranked, asked, orderings, "m", "p", 0).count() == 0


@pytest.mark.parametrize("change", ["model", "prompt", "order"])
def test_a_missing_or_broken_ordering_is_an_error(spark, ranked, asked, change):
    key = key_of("m", "p", "what?", [f"c{i}" for i in range(6)])
    order = [0, 0, 1, 2, 3, 4] if change == "order" else [4, 2, 0, 1, 3, 5]
    model, prompt = ("n", "p") if change == "model" else ("m", "r") if change == "prompt" else ("m", "p")
    orderings = stored(spark, order, key)
    wanted = rerank.requests(ranked, asked, model, prompt)
    assert [r["query_id"] for r in rerank.missing_orderings(wanted, orderings).collect()] == ["q"]
    with pytest.raises(Exception, match="no stored ordering"):
        rerank.rerank(ranked, asked, orderings, model, prompt).collect()


def test_text_of_odd_answers(spark):
    assert validated(spark, {"answer": 5})["text"] == "5"
    assert validated(spark, {"answer": True})["text"] == "True"
    assert validated(spark, {"answer": None})["text"] == "None"
    assert validated(spark, {"citations": []})["text"] == ""
