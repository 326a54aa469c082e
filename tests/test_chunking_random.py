"""Random documents of headings, tables, short and oversized paragraphs: the Spark plan against SQL."""

import random

import duckdb
import pytest

from citeloom.operators.chunking import chunk_documents
from citeloom.sources.documents import structured
from workload import oracle

WORDS = "penalty order value percent delivery frame carbon supplier (see) clause days Net Terms".split()


def sentence(r):
    words = [r.choice(WORDS) for _ in range(r.randint(1, 30))]
    return " ".join(words).capitalize() + r.choice([".", "?", "!", ":", ";", "", " 0.5", " B.V."])


def paragraph(r):
    kind = r.random()
    if kind < 0.2:
        return "\n".join("| " + " | ".join(r.choice(WORDS) for _ in range(3)) + " |" for _ in range(r.randint(1, 40)))
    if kind < 0.3:
        return "\n".join("  " + sentence(r) for _ in range(r.randint(1, 12)))
    if kind < 0.4:
        return "\n".join(r.choice(["| x |", "plain", "  indented", ""]) for _ in range(r.randint(1, 6)))
    joint = r.choice([" ", "\n", "  "])
    return joint.join(sentence(r) for _ in range(r.choice([1, 1, 2, 5, 12, 40])))


def heading(r):
    return r.choice(
        ["# Title again", "## 1. First", "### Deep", "#### ", "##None", "1. SCOPE", "2.1 Detail", "3.2. More", "30 September", "  4. INDENTED", "5. lower", "6. " + "X" * r.randint(55, 65)]
    )


def document(seed):
    r = random.Random(seed)
    parts = []
    for _ in range(r.randint(0, 9)):
        parts.append(heading(r) if r.random() < 0.35 else paragraph(r))
    return r.choice(["", "\ufeff", " \n"]) + r.choice(["\n\n", "\n", "\n \n\n"]).join(parts) + r.choice(["", "\r\n", "  "])


def as_rows(rows):
    return sorted((r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows)


@pytest.mark.parametrize("suffix", ["md", "txt"])
def test_random_documents(spark, tmp_path, suffix):
    rows = [(f"doc{i:04d}.{suffix}", document(i)) for i in range(400)]
    spark.createDataFrame(rows, "source_path string, raw string").write.parquet(str(tmp_path / "files"))
    raw = spark.read.parquet(str(tmp_path / "files"))
    columns = ["chunk_id", "doc_id", "doc_title", "source_path", "section", "text", "index_text", "ordinal"]
    got = chunk_documents(structured(raw)).select(*columns).collect()
    source = f"SELECT * FROM '{tmp_path}/files/*.parquet'"
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({oracle.chunks(oracle.files(source))})").fetchall()
    assert len(got) > 800
    left, right = as_rows(got), as_rows(want)
    assert [a for a, b in zip(left, right) if a != b][:1] == [b for a, b in zip(left, right) if a != b][:1]
    assert left == right
