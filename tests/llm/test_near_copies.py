"""The near-copy stage of the pipeline against brute-force Jaccard similarity of five-word shingles."""

import pytest
from test_chosen_path import brute, edited_texts

import corpus_pipeline
from citeloom.llm import chosenpath, simhash


@pytest.mark.parametrize("seed", [8, 1])
def test_edited_copies_against_brute_force(spark, seed):
    texts = edited_texts(seed)
    want = {i: c for i, (_, c) in brute(texts, corpus_pipeline.SHINGLE, empty_alike=True).items()}
    assert 40 < len(set(want.values())) < len(texts) - 40
    frame = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_null_ids_and_null_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words), (7, words + " more"), (9, None), (8, ""), (None, "quite another text of seven words")]
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(x for x in got if x) == [7, 8] and got.count(None) >= 1


def test_simhash_finds_its_pairs_without_the_join(spark, monkeypatch):
    # Copies within 2 bits and of similarity 0.8, pairs within 2 bits that are not similar, and texts further apart.
    words = [f"w{i}" for i in range(3000)]
    base = " ".join(words)
    rows = [(1, base), (2, base + " end"), (3, " ".join(words[:1000])), (4, base + " end"), (5, "a b c d e"), (6, "a b c d e " * 40), (7, "one two three four five six seven")]
    prints = simhash.fingerprints_of([t for _, t in rows], corpus_pipeline.SHINGLE).tolist()
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.DISTANCE < (prints[0] ^ prints[2]).bit_count()
    branched = chosenpath._branched
    monkeypatch.setattr(chosenpath, "_branched", lambda *given: branched(*given).where("false"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()) == [1, 3, 5, 6, 7]


def test_simhash_pairs_connect_all_within_two_bits(spark):
    prints = {1: 0b1111, 2: 0b1111, 3: 0b1100, 4: 0b0100, 5: 0b1111 << 20, 6: 0b1111}
    frame = spark.createDataFrame(list(prints.items()), "key long, fingerprint long")
    pairs = {tuple(r) for r in simhash.candidates(frame).select("a", "b").collect()}
    assert pairs >= {(1, 2), (1, 6), (1, 3), (3, 4)} and not any(5 in p for p in pairs) and all(a < b for a, b in pairs)
