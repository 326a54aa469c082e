"""Every document that holds a benchmark text is expected, also for texts of few words."""

from workload import inputs


def test_all_holders_are_expected(spark, tmp_path):
    long, short = "alpha beta gamma delta epsilon zeta", "two words"
    texts = {2: f"x {long} y", 10: long, 11: f"{long}.", 30: f"a\n{long}", 31: "some two wordsmiths", 40: "alpha beta gamma delta"}
    docs = [(i, t, "en", "web", len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, long), (2, short), (3, "absent")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    asked, expected = inputs.golden(spark, str(tmp_path))
    got = {r.query_id: (r.type, r.expected) for r in asked.collect()}
    assert got == {1: ("multi_hop", 4), 2: ("factual", 1), 3: ("unanswerable", 0)}
    assert sorted(tuple(r) for r in expected.collect()) == [(1, 2), (1, 10), (1, 11), (1, 30), (2, 31)]
