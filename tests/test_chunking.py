import pytest
from citeloom.operators.chunking import chunk_documents, chunk_size_report
from citeloom.sources.documents import load_documents


def write(folder, **files):
    for name, content in files.items():
        stem, suffix = name.rsplit("_", 1)
        (folder / f"{stem}.{suffix}").write_bytes(content.encode("utf-8"))
    return str(folder)


def chunks_of(spark, text, fmt="markdown"):
    rows = spark.createDataFrame(
        [("d", "Title", "d.md", fmt, text)], "doc_id string, title string, source_path string, fmt string, text string"
    )
    return chunk_documents(rows).orderBy("ordinal").collect()


SENTENCES = [f"Sentence number {i} states a distinct fact about item {i}." for i in range(120)]


def test_files_become_documents(spark, tmp_path):
    folder = write(
        tmp_path, b_md="\ufeff# Beta\r\n\r\nBody  \r\n", a_TXT="ALPHA\n\n1. ONE\n\ntext", c_csv="no", blank_md="\ufeff \n ", d_md="plain"
    )
    rows = {r["doc_id"]: r for r in load_documents(spark, folder).collect()}
    assert sorted(rows) == ["a", "b", "d"]
    assert (rows["b"]["title"], rows["b"]["fmt"], rows["b"]["text"]) == ("Beta", "markdown", "# Beta\n\nBody")
    assert (rows["a"]["title"], rows["a"]["fmt"], rows["a"]["source_path"]) == ("ALPHA", "text", "a.TXT")


def test_missing_and_empty_folders_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_documents(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        load_documents(spark, str(tmp_path))


def test_sections_and_labels(spark):
    got = chunks_of(spark, "# Title\n\nRef X-1\n\n## 1. First\n\nOne.\n# dropped\nTwo.\n\n## 2. Empty\n\n### 3. Deep\n\nThree.")
    assert [(r["chunk_id"], r["section"], r["text"]) for r in got] == [
        ("d::000", "", "Ref X-1"),
        ("d::001", "1. First", "One.\nTwo."),
        ("d::002", "3. Deep", "Three."),
    ]
    assert got[0]["index_text"] == "Title\n\nRef X-1"
    assert got[1]["index_text"] == "Title > 1. First\n\nOne.\nTwo."


def test_numbered_headings_of_plain_text(spark):
    body = "HEAD\n\n1. SCOPE\n\na\n2.1 Detail\n\nb\n30 September 2026.\n  3. INDENTED\n4. lower\n" + "5. " + "X" * 70
    got = chunks_of(spark, body, "text")
    assert [r["section"] for r in got] == ["", "1. SCOPE", "2.1. Detail"]
    assert "30 September" in got[2]["text"] and "INDENTED" in got[2]["text"]


def test_a_table_stays_whole_and_takes_its_introduction(spark):
    table = "\n".join(["| a | b |", "|---|---|"] + [f"| row {i} | {'v' * 60} |" for i in range(40)])
    got = chunks_of(spark, f"## T\n\n{'Long text. ' * 45}\n\nThe table lists all values.\n\n{table}\n\nA short remark.")
    held = [r["text"] for r in got if "| row 0 |" in r["text"]]
    assert len(held) == 1 and "row 39" in held[0] and held[0].startswith("The table lists all values.\n\n| a | b |")
    assert len(held[0]) > 1600


def test_long_sections_overlap_by_whole_sentences(spark):
    got = chunks_of(spark, "## 1. Long\n\n" + " ".join(SENTENCES))
    assert len(got) > 3
    for before, after in zip(got, got[1:]):
        opening = after["text"].split("\n\n")[0]
        assert len(opening) <= 180 and opening in before["text"]
        # The overlap ends before the last sentence of the chunk it comes from.
        assert not before["text"].endswith(opening)
    assert all(len(r["text"]) <= 1600 for r in got)
    whole = " ".join(r["text"] for r in got)
    assert all(s in whole for s in SENTENCES)


def test_no_overlap_after_a_table_or_across_sections(spark):
    table = "\n".join(f"| {i} | {'v' * 50} |" for i in range(20))
    got = chunks_of(spark, f"## A\n\n{table}\n\n{'Plain words follow here. ' * 30}\n\n## B\n\nOther text.")
    follow = next(r for r in got if r["text"].startswith("Plain words"))
    assert "|" not in follow["text"]
    assert got[-1]["text"] == "Other text."


def test_a_short_last_piece_is_merged(spark):
    first = " ".join(f"Sentence {i:02d} {'x' * 41} ends." for i in range(20))
    assert len(first) == 1199
    merged = chunks_of(spark, f"## S\n\n{first}\n\n{'B' * 15}")
    assert len(merged) == 1 and merged[0]["text"].endswith(f"ends.\n\n{'B' * 15}")
    assert merged[0]["text"].count("Sentence 18") == 2
    apart = chunks_of(spark, f"## S\n\n{first}\n\n{'B' * 90}")
    assert len(apart) == 2 and len(apart[1]["text"]) >= 200


def test_size_report(spark):
    rows = spark.createDataFrame(
        [("a", 0, "x" * 5), ("a", 1, "x" * 9), ("b", 0, "x" * 2), ("b", 1, "x" * 7)], "doc_id string, ordinal int, text string"
    )
    assert chunk_size_report(rows).first() == (2, 4, 2, 7, 9)


def test_chunking_does_not_shuffle_and_reads_only_its_columns(spark, tmp_path):
    write(tmp_path, a_md="# A\n\nText.")
    plan = chunk_documents(load_documents(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1
