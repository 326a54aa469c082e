import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import payload, text
from citeloom import providers


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("x"))).collect()]


def test_tokens_keep_compounds_and_their_parts(spark):
    got = column(
        spark,
        ["FRM-CRB-52", "clause 5.2 applies", "Penalty: 0.5 percent, capped!", "für -a- b..c", ""],
        text.tokenize,
    )
    assert got[0] == ["frm-crb-52", "frm", "crb", "52"]
    assert got[1] == ["clause", "5.2", "5", "2", "applies"]
    assert got[2] == ["penalty", "0.5", "0", "5", "percent", "capped"]
    assert got[3] == ["f", "r", "a", "b", "c"]
    assert got[4] == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB3é.-/ \n[", max_size=30), min_size=40, max_size=60))
def test_tokens_agree_with_plain_regular_expressions(spark, values):
    got = column(spark, values, text.tokenize)
    for value, tokens in zip(values, got):
        whole = [t for t in tokens if t in re.findall(r"[a-z0-9]+(?:[-./][a-z0-9]+)*", value.lower())]
        parts = sorted(p for w in re.findall(text.TOKEN, value.lower()) for p in ([w] + re.split("[-./]", w) if re.search("[-./]", w) else [w]))
        assert sorted(tokens) == parts and set(whole) <= set(tokens)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\x1c\x85\xa0 　ab", max_size=12), min_size=40, max_size=60))
def test_whitespace_is_what_python_calls_whitespace(spark, values):
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.flatten_space) == [" ".join(v.split()) for v in values]


def test_normalise(spark):
    raw = "\ufeff\ufeff\r\nTitle  \r\n\r\nbody\t \rlast \n\n"
    assert column(spark, [raw], text.normalise) == ["Title\n\nbody\nlast"]


def test_titles(spark):
    frame = spark.createDataFrame(
        [
            ("\n  # Big  \nx", "markdown"),
            ("## Not a title\nx", "markdown"),
            ("# Kept\nx", "text"),
            (" \n", "markdown"),
        ],
        "t string, f string",
    )
    got = frame.select(text.title(F.col("t"), F.col("f"), F.lit("stem"))).collect()
    assert [r[0] for r in got] == ["Big", "## Not a title", "# Kept", "stem"]


def test_sentences_break_before_capitals_and_brackets_only(spark):
    got = column(spark, ["Rate is 0.5 percent. See clause 5.2 of it: (a) or. b B.V. Done", "  ", " one "], text.sentences)
    assert got[0] == ["Rate is 0.5 percent.", "See clause 5.2 of it:", "(a) or. b B.V.", "Done"]
    assert got[1] == [""]
    assert got[2] == ["one"]


def test_citations(spark):
    assert column(spark, ["a [1] b [12]. [x] [ 3 ]"], text.citation_numbers) == [["1", "12"]]
    stripped = column(
        spark,
        ["Pay now [9] . Then [1] , ok [7]"],
        lambda x: text.strip_citations(x, F.array(F.lit("7"), F.lit("9"))),
    )
    assert stripped == ["Pay now. Then [1], ok"]
    assert column(spark, ["see [2]"], text.highlight_citations) == ["see :blue-background[**[2]**]"]


def test_previews(spark):
    assert column(spark, ["a  b", "x" * 97, "y" * 96], text.preview) == ["a b", "x" * 93 + "...", "y" * 96]


@pytest.mark.parametrize(
    "message, delay",
    [("retryDelay': '14s'", 14.5), ("Please retry in 14.347677307s", 14.847677307), ("no", 0.0), ("retryDelay: 600s", 90.0)],
)
def test_retry_delay(spark, message, delay):
    assert column(spark, [message], lambda x: text.retry_delay(x, 90.0)) == [delay]
    assert providers.asked_delay(message) == delay


def test_retryable(spark):
    messages = ["429 slow down", "RESOURCE_EXHAUSTED 400 ", "404 gone", "INVALID_ARGUMENT", "503 busy"]
    expected = [True, True, False, False, True]
    assert column(spark, messages, text.is_retryable) == expected
    assert [providers.worth_retrying(m) for m in messages] == expected


def test_retries_wait_and_give_up():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise RuntimeError("503")

    with pytest.raises(RuntimeError):
        providers.with_retries(fails, 4, providers.worth_retrying, waits.append)
    assert len(calls) == 4 and waits == [1.0, 2.0, 4.0]
    calls.clear()

    def rejected():
        calls.append(1)
        raise RuntimeError("404 no such model")

    with pytest.raises(RuntimeError):
        providers.with_retries(rejected, 4, providers.worth_retrying, waits.append)
    assert len(calls) == 1


@pytest.mark.parametrize(
    "response, count, order",
    [
        ('{"ranking":[3,1]}', 4, [2, 0, 1, 3]),
        ('{"ranking":[2,2,9,1]}', 3, [1, 0, 2]),
        ('{"ranking":[]}', 3, [0, 1, 2]),
        ('{"ranking":[true,"2",2.0,0,-1,3]}', 3, [2, 0, 1]),
        ("{}", 2, [0, 1]),
    ],
)
def test_rankings_are_repaired(spark, response, count, order):
    got = column(
        spark, [response], lambda x: payload.repair_ranking(payload.integers(payload.parse(x), "ranking"), F.lit(count))
    )
    assert got == [order]


def test_truth_is_python_truth(spark):
    values = ["{}", "null", "false", "true", '"false"', '""', "0", "1", "0.0", "[]", "[0]", '{"a":1}']
    raw = ["{}"] + ['{"refused": %s}' % v for v in values[1:]]
    got = column(spark, raw, lambda x: payload.truthy(payload.parse(x), "refused"))
    assert got == [False, False, False, True, True, False, False, True, False, False, True, True]


def test_short_ids_and_code_phrasing(spark):
    assert column(spark, ["onboarding_x_procurement"], text.short_id) == ["onb_x"]
    assert column(spark, ["see HCS-SLA-2024", "FRM-CRB", "clause 5", "plain text"], text.is_code_phrased) == [True, True, True, False]
