"""Documents to chunks, one map-only pass.

A document is one row and its chunks come from that row alone, so nothing here shuffles: sections,
blocks, packing and ordinals are array expressions inside the row, and the only plan node besides
the scan is the final ``posexplode``. Greedy packing carries state from piece to piece, which is
what ``aggregate`` folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, let, sentences, strip, strip_newlines
from citeloom.settings import INTRO_CHARS, MAX_CHARS, MIN_CHARS, OVERLAP_CHARS, TARGET_CHARS

# --- fixed values: heading and paragraph patterns (matched against one raw line) ---
MARKDOWN_TITLE = r"(?sU)\A#[\s\x1c-\x1f]+.+\z"
MARKDOWN_HEADING = r"(?sU)\A#{2,6}[\s\x1c-\x1f]+(.+)\z"
TEXT_HEADING = r"(?sU)\A(\d+\.|\d+(?:\.\d+)+\.?)[\s\x1c-\x1f]+([A-Z][^\n]{0,60})\z"
PARAGRAPH_BREAK = r"(?U)\n[\s\x1c-\x1f]*\n"

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def is_table_line(line: Column) -> Column:
    """A pipe row, or an indented line of a preformatted table."""
    return F.startswith(strip(line), F.lit("|")) | (
        F.startswith(line, F.lit("  ")) & ~is_blank(line)
    )


def looks_tabular(text: Column) -> Column:
    """At least two table lines, and at least half of the lines."""
    counted = let(
        F.split(text, "\n"),
        lambda lines: F.size(F.filter(lines, is_table_line))
        >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2).cast("int")),
    )
    return F.contains(text, F.lit("\n")) & counted


def sections(text: Column, fmt: Column) -> Column:
    """array<struct<heading, body>>: the text before the first heading has an empty heading.

    Title lines of markdown are left out wherever they stand; sections without content vanish.
    """
    markdown = fmt == "markdown"

    def opens(line: Column) -> Column:
        return F.when(markdown, F.rlike(line, F.lit(MARKDOWN_HEADING))).otherwise(
            F.rlike(line, F.lit(TEXT_HEADING))
        )

    def heading(line: Column) -> Column:
        number = F.rtrim(F.regexp_extract(line, TEXT_HEADING, 1), F.lit("."))
        numbered = F.concat(number, F.lit(". "), strip(F.regexp_extract(line, TEXT_HEADING, 2)))
        return F.when(markdown, strip(F.regexp_extract(line, MARKDOWN_HEADING, 1))).otherwise(numbered)

    def between(lines: Column, starts: Column) -> Column:
        def one(start: Column, index: Column) -> Column:
            end = F.coalesce(F.get(starts, index + 1), F.size(lines))
            inside = F.filter(
                F.slice(lines, start + 2, end - start - 1),
                lambda line: ~(markdown & F.rlike(line, F.lit(MARKDOWN_TITLE))),
            )
            return F.struct(
                F.when(start < 0, "").otherwise(heading(F.get(lines, start))).alias("heading"),
                strip_newlines(F.array_join(inside, "\n")).alias("body"),
            )

        return F.transform(starts, one)

    def split_up(lines: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: opens(F.get(lines, i)))
        starts = F.concat(F.array(F.lit(-1)), found)
        return let(starts, lambda s: between(lines, s))

    return F.filter(let(F.split(text, "\n"), split_up), lambda s: ~is_blank(s["body"]))


def blocks(body: Column) -> Column:
    """array<struct<text, atomic>>: paragraphs; a table takes the short paragraph above it along."""
    paragraphs = F.filter(
        F.transform(F.split(body, PARAGRAPH_BREAK), strip_newlines), lambda p: ~is_blank(p)
    )
    marked = F.transform(
        paragraphs,
        lambda p: let(
            looks_tabular(p),
            lambda table: F.struct(
                p.alias("text"),
                table.alias("table"),
                (~table & (F.length(p) <= INTRO_CHARS)).alias("intro"),
            ),
        ),
    )

    def joined(m: Column) -> Column:
        def one(block: Column, i: Column) -> Column:
            above = F.when(i > 0, F.get(m, i - 1))
            takes = block["table"] & F.coalesce(above["intro"], F.lit(False))
            below = F.get(m, i + 1)
            taken = block["intro"] & F.coalesce(below["table"], F.lit(False))
            return F.struct(
                F.when(takes, F.concat(above["text"], F.lit("\n\n"), block["text"]))
                .otherwise(block["text"])
                .alias("text"),
                block["table"].alias("atomic"),
                taken.alias("taken"),
            )

        kept = F.filter(F.transform(m, one), lambda b: ~b["taken"])
        return F.transform(kept, lambda b: F.struct(b["text"].alias("text"), b["atomic"].alias("atomic")))

    return let(marked, joined)


def fit(text: Column) -> Column:
    """An oversized paragraph as runs of whole sentences; any other as it is."""
    start = F.struct(_none().alias("done"), F.lit("").alias("run"))

    def step(acc: Column, sentence: Column) -> Column:
        run = acc["run"]
        full = (run != "") & (F.length(run) + F.length(sentence) > TARGET_CHARS)
        return F.when(
            full,
            F.struct(F.concat(acc["done"], F.array(run)).alias("done"), sentence.alias("run")),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.when(run == "", sentence).otherwise(F.concat(run, F.lit(" "), sentence)).alias("run"),
            )
        )

    def close(acc: Column) -> Column:
        return F.when(acc["run"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["run"])))

    runs = F.aggregate(sentences(text), start, step, close)
    return F.when(F.length(text) <= MAX_CHARS, F.array(text)).otherwise(runs)


def pieces(body: Column) -> Column:
    """array<struct<text, atomic>>: blocks, with oversized paragraphs cut up."""

    def one(block: Column) -> Column:
        def plain(t: Column) -> Column:
            return F.struct(t.alias("text"), F.lit(False).alias("atomic"))

        return F.when(block["atomic"], F.array(block)).otherwise(F.transform(fit(block["text"]), plain))

    return F.flatten(F.transform(blocks(body), one))


def tail(text: Column) -> Column:
    """The sentences before the last one, from the end back, within the overlap budget.

    The nearest is taken whatever its length.
    """

    def within(s: Column) -> Column:
        def near(_: Column, i: Column) -> Column:
            rest = F.slice(s, i + 1, F.size(s) - i)
            length = F.aggregate(rest, F.lit(0), lambda acc, x: acc + F.length(x))
            return (i == F.size(s) - 1) | (length <= OVERLAP_CHARS)

        return F.array_join(F.filter(s, near), " ")

    return let(
        sentences(text),
        lambda s: let(F.when(F.size(s) > 1, F.slice(s, 1, F.size(s) - 1)).otherwise(s), within),
    )


def pack(parts: Column) -> Column:
    """Greedy packing of pieces into chunk texts, with a sentence overlap between chunks."""
    start = F.struct(_none().alias("done"), _none().alias("open"), F.lit(0).alias("size"))

    def closed(open_parts: Column) -> Column:
        return strip(F.array_join(open_parts, "\n\n"))

    def step(acc: Column, piece: Column) -> Column:
        text = piece["text"]
        limit = F.when(piece["atomic"], MAX_CHARS).otherwise(TARGET_CHARS)
        full = (F.size(acc["open"]) > 0) & (acc["size"] + F.length(text) > limit)

        def restart(chunk: Column) -> Column:
            bare = piece["atomic"] | looks_tabular(F.element_at(acc["open"], -1))
            return let(
                F.when(bare, "").otherwise(tail(chunk)),
                lambda seed: F.struct(
                    F.concat(acc["done"], F.array(chunk)).alias("done"),
                    F.when(seed == "", F.array(text)).otherwise(F.array(seed, text)).alias("open"),
                    (
                        F.when(seed == "", 0).otherwise(F.length(seed) + 2) + F.length(text) + 2
                    ).alias("size"),
                ),
            )

        return F.when(full, let(closed(acc["open"]), restart)).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.concat(acc["open"], F.array(text)).alias("open"),
                (acc["size"] + F.length(text) + 2).alias("size"),
            )
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) == 0, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(closed(acc["open"])))
        )

    return F.aggregate(parts, start, step, finish)


def merge_runt(chunks: Column) -> Column:
    """A very short last chunk joins the one before it where the two fit."""

    def merged(c: Column) -> Column:
        last, before = F.element_at(c, -1), F.element_at(c, -2)
        joins = (F.length(last) < MIN_CHARS) & (F.length(before) + F.length(last) <= MAX_CHARS)
        both = F.array(F.concat(before, F.lit("\n\n"), last))
        return F.when(
            F.size(c) >= 2,
            F.when(joins, F.concat(F.slice(c, 1, F.size(c) - 2), both)).otherwise(c),
        ).otherwise(c)

    return let(chunks, merged)


def section_chunks(body: Column) -> Column:
    return merge_runt(pack(pieces(body)))


def index_text(title: Column, section: Column, text: Column) -> Column:
    prefix = F.when(section != "", F.concat(title, F.lit(" > "), section)).otherwise(title)
    return F.concat(prefix, F.lit("\n\n"), text)


def citation_label(title: Column, section: Column) -> Column:
    return F.when(section != "", F.concat(title, F.lit(", "), section)).otherwise(title)


def chunk_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, title, source_path, fmt, text) to one row per chunk.

    ``ordinal`` runs over the whole document; ``chunk_id`` is ``doc_id::ordinal``.
    """
    per_section = F.transform(
        sections(F.col("text"), F.col("fmt")),
        lambda s: F.transform(
            section_chunks(s["body"]),
            lambda t: F.struct(s["heading"].alias("section"), t.alias("text")),
        ),
    )
    exploded = documents.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("title").alias("doc_title"),
        "source_path",
        F.posexplode(F.flatten(per_section)).alias("ordinal", "piece"),
    )
    section, text = F.col("piece.section"), F.col("piece.text")
    return exploded.select(
        F.format_string("%s::%03d", F.col("doc_id"), F.col("ordinal")).alias("chunk_id"),
        "doc_id",
        "doc_title",
        "source_path",
        section.alias("section"),
        text.alias("text"),
        index_text(F.col("doc_title"), section, text).alias("index_text"),
        "ordinal",
    )


def chunk_size_report(chunks: DataFrame) -> DataFrame:
    """Documents, chunks, and smallest, upper-median and largest chunk text, from one pass.

    All of it is read off the histogram of lengths, which pre-aggregates in the map tasks and has one
    row per distinct length. A document is counted at its first chunk.
    """
    lengths = chunks.groupBy(F.length("text").alias("chars")).agg(
        F.count("*").alias("n"), F.count_if(F.col("ordinal") == 0).alias("first")
    )
    whole = lengths.agg(
        F.sum("first").alias("documents"),
        F.sum("n").alias("chunks"),
        F.min("chars").alias("min_chars"),
        F.max("chars").alias("max_chars"),
        F.array_sort(F.collect_list(F.struct("chars", "n"))).alias("histogram"),
    )
    middle = F.floor(F.col("chunks") / 2)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("chars"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        reached = acc["chars"].isNull() & (seen > middle)
        return F.struct(seen.alias("seen"), F.when(reached, x["chars"]).otherwise(acc["chars"]).alias("chars"))

    median = F.aggregate("histogram", start, step, lambda acc: acc["chars"])
    return whole.select("documents", "chunks", "min_chars", median.alias("median_chars"), "max_chars")
