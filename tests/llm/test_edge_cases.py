"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import chosenpath, crosspolytope, divergence, licenses, mixing, multiset, pieces, quality, simhash, substring, token_lengths, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, None, None, "a", None),
    (3, "", "en", None, 0),
    (4, " \t\n ", "en", "b", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, "one two three four five six seven", "en", "b", 33),
    (6, "one two three four five six seven", "en", "b", 33),
    (6, "another text under the same number", "en", "b", 33),
    (None, "one two three four five six seven", "en", "b", 33),
    (None, None, None, None, None),
    (7, "idiot", "en", "c", 5),
    (-8, "ﬁne … ▁ text\u0000 with odd characters 😀 　 and spaces", "en", "", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    # Names that the operators use themselves.
    for name in ("size", "taken", "target", "fingerprint", "features", "score", "bucket", "key", "digest", "starts", "n", "label"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (5, 1, 0), (7, 0, 1), (7, None, None), (None, 1, 1), (99, 0, 0), (2, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("score", F.lit(1))


@pytest.fixture(scope="module")
def model(spark):
    return pieces.broadcast_model(spark, public_tokenizers.path("piece_bpe_32k.model"))


def results(docs, labels, model):
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.col("n_chars").cast("double"), F.lit(1.0)).alias("vector"), "score")
    yield mixing.mix(docs), True
    yield mixing.mixed(docs), False
    yield simhash.near_duplicates(docs), True
    yield simhash.kept_of_each(docs), False
    yield licenses.scan(docs), False
    yield token_lengths.suffix_sums(token_lengths.histogram(docs, model)), False
    yield multiset.fingerprints(docs, "doc_id"), True
    yield multiset.edited(docs), True
    yield crosspolytope.nearest(vectors, F.lit(True)), False
    yield pieces.round_trip(docs, model, "text", "doc_id"), True
    yield quality.classify(docs, labels), True
    yield quality.accepted(docs, labels), False
    yield toxicity.classify(docs, labels), True
    yield substring.without_repeats(docs), True
    yield chosenpath.near_copies(docs), True
    yield chosenpath.kept_of_each(docs, 5), False
    yield divergence.audit(docs), False


def test_rows_in_rows_out(docs, labels, model):
    for frame, each in results(docs, labels, model):
        rows = frame.collect()
        assert len(rows) == len(ROWS) if each else len(rows) >= 0


def test_empty_tables(docs, labels, model):
    for frame, _ in results(docs.limit(0), labels, model):
        assert frame.count() == 0
    for frame, each in results(docs, labels.limit(0), model):
        if each:
            assert frame.count() == len(ROWS)


def test_stages_on_odd_rows(spark, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(tmp_path))
            assert made.count() <= 3 * max(1, len(rows)), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", "), name


def test_names_with_underscores(spark, docs, labels, tmp_path):
    names = "_row _copy _size _taken _words _removed _kept words removed kept _starts _id _digest _kept_id _text _part _root _n".split()
    odd = docs.select(*SCHEMA.replace(" string", "").replace(" long", "").split(", "), *[F.lit(f"own {n}").alias(n) for n in names])
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == odd.columns, name
        rows = made.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names), name
    with pytest.raises(ValueError):
        substring.without_repeats(odd)


def test_mix_values(docs):
    rows = {(r.doc_id, r.source): r for r in mixing.mix(docs).collect() if r.doc_id in (1, 2, 3, 4)}
    assert (rows[1, "a"].size, rows[2, "a"].size, rows[3, None].size, rows[4, "b"].size) == (7, 0, 0, 0)
    assert rows[1, "a"].source_size == 7 and rows[1, "a"].target <= 21
    assert rows[3, None].target == 0.0


def test_null_and_empty_texts(docs, model):
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert prints[2].fingerprint == prints[3].fingerprint == prints[4].fingerprint == "0" * 16
    assert prints[2].component_id == prints[4].component_id == 2
    assert prints[6].component_id in (1, 6)
    trips = {r.doc_id: r for r in pieces.round_trip(docs, model, "text", "doc_id").collect()}
    assert trips[2].ids == trips[3].ids == [] and trips[2].decoded == ""
    same = {r.doc_id: r.fingerprint for r in multiset.fingerprints(docs, "doc_id").collect()}
    assert set(same[2]) == {"0"} and same[2] == same[3]


def test_repeated_ids_do_not_repeat_each_other(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(4, text), (4, text), (9, "before " + text + " after"), (None, text), (10, None)]
    found = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r._words, r._removed) for r in found) == [(0, 20, 0), (4, 20, 0), (4, 20, 0), (9, 22, 20), (10, 0, 0)]
    assert next(r._kept for r in found if r.doc_id == 9) == "before after"
