"""Text reports of one evaluation run. Golden sets are hand-written and small; only their result
rows and grouped rows are read here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import short_id
from citeloom.operators import metrics
from citeloom.settings import COHORTS, PHRASINGS, QUESTION_TYPES

_HEADS = {"recall": "recall@k", "full_coverage": "full", "mrr": "MRR", "anchor_recall": "anchor", "anchor_full": "anchF"}


# --- fixed values: columns of the evidence table and their heads ---
EVIDENCE_HEADS = {
    "position": "#",
    "document": "document",
    "section": "section",
    "cosine": "cosine",
    "vector_rank": "vector rank",
    "keyword_rank": "BM25 rank",
    "fused_score": "fused score",
    "found_by": "found by",
}


def _table(rows: list[list[str]]) -> list[str]:
    widths = [max(len(row[i]) for row in rows) for i in range(len(rows[0]))]
    lines = ["  ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip() for row in rows]
    return [lines[0], "-" * len(lines[0]), *lines[1:]]


def _values(row) -> list[str]:
    return [f"{row[m]:.3f}" for m in metrics.RETRIEVAL_METRICS]


def retrieval_report(results: DataFrame, k: int, primary: str = "hybrid") -> str:
    """results: every mode, with a ``mode`` column. Questions first, then the means."""
    shown = results.where(F.col("mode") == primary).withColumn(
        "documents", F.array_join(F.transform("retrieved_documents", short_id), ", ")
    )
    rows = [["id", "type", *_HEADS.values(), "retrieved documents"]]
    for r in shown.orderBy("query_id").collect():
        missed = "" if r["anchor_full"] else "  (lacks an anchor)"
        rows.append([str(r["query_id"]), r["type"], *_values(r), r["documents"] + missed])
    out = [f"Questions, {primary} lists of {k}", *_table(rows)]

    cells = {(r["mode"], r["axis"], r["value"]): r for r in metrics.retrieval_breakdown(results).collect()}
    modes = [primary, *sorted({m for m, _, _ in cells} - {primary})]
    for axis, values in (("type", QUESTION_TYPES), ("cohort", COHORTS)):
        rows = [[axis, "n", *_HEADS.values()]]
        for value in values:
            row = cells.get((primary, axis, value))
            if row is not None:
                rows.append([value, str(row["questions"]), *_values(row)])
        out += ["", f"Means of each {axis}, {primary} lists", *_table(rows)]
    rows = [["mode", "n", *_HEADS.values()]]
    rows += [[m, str(cells[m, "all", "all"]["questions"]), *_values(cells[m, "all", "all"])] for m in modes if (m, "all", "all") in cells]
    out += ["", "Means of each mode", *_table(rows)]
    rows = [["phrasing", *modes]]
    for phrasing in PHRASINGS:
        found = [cells.get((m, "phrasing", phrasing)) for m in modes]
        rows.append([phrasing] + ["-" if c is None else f"{c['recall']:.3f} / {c['anchor_recall']:.3f}" for c in found])
    return "\n".join([*out, "", "Documents and anchors recalled, for each phrasing", *_table(rows)])


def rerank_report(before: DataFrame, after: DataFrame, k: int) -> str:
    found = {r["metric"]: r for r in metrics.rerank_comparison(before, after).collect()}
    rows = [["mean", "as fused", "as reordered", "gain"]]
    for name in metrics.RETRIEVAL_METRICS:
        r = found[name]
        rows.append([_HEADS[name], f"{r['before']:.3f}", f"{r['after']:.3f}", f"{r['change']:+.3f}"])
    out = [f"Reordered lists of {k}", *_table(rows), ""]
    moved = metrics.moved_questions(before, after).orderBy("query_id").collect()
    if not moved:
        return "\n".join([*out, "Every question keeps the anchors that it had."])
    lines = [f"- {r['query_id']} {r['direction'].lower()}: from {r['before']:.0%} of its anchors to {r['after']:.0%}" for r in moved]
    return "\n".join([*out, f"{len(moved)} with other anchors than before:", *lines])


def answer_report(results: DataFrame) -> str:
    rows = [["id", "type", "refused", "conflict", "cited", "grounded", "facts"]]
    bad = []
    for r in results.orderBy("query_id").collect():
        facts = f"{r['facts_found']}/{r['facts_expected']}" if r["facts_expected"] else "-"
        wrong = "" if r["refusal_correct"] else "  (should have answered)" if r["refused"] else "  (should have refused)"
        rows.append(
            [str(r["query_id"]), r["type"], str(r["refused"]), str(r["conflict"]), str(r["citation_count"]), str(r["grounded"]), facts + wrong]
        )
        if not r["grounded"]:
            bad.append(f"- {r['query_id']} cites passages that it was not given: {', '.join(map(str, r['invalid_citations']))}")
    total = metrics.answer_summary(results).first().asDict()
    lines = [f"  {name:24} {value:.3f}" if isinstance(value, float) else f"  {name:24} {value}" for name, value in total.items()]
    return "\n".join(["Answers", *_table(rows), "", "Over all of them", *lines, *bad])


def evidence_markdown(rows: DataFrame) -> str:
    """The rows of one question's ``evidence_rows`` as a markdown table."""
    shown = rows.select(F.col("position").alias("at"), *[F.replace(F.col(f).cast("string"), F.lit("|"), F.lit("\\|")).alias(f) for f in EVIDENCE_HEADS])
    line = F.concat_ws(" | ", *[F.coalesce(f, F.lit("None")) for f in EVIDENCE_HEADS])
    body = [r["line"] for r in shown.orderBy("at").select(line.alias("line")).collect()]
    if not body:
        return "Nothing was found."
    head = " | ".join(EVIDENCE_HEADS.values())
    return "\n".join(f"| {text} |" for text in (head, " | ".join(["---"] * len(EVIDENCE_HEADS)), *body))
