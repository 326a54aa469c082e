"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.settings import WHITESPACE

# --- fixed values: patterns ---
TOKEN = r"[a-z0-9]+(?:[-./][a-z0-9]+)*"
COMPOUND = r"[a-z0-9][-./][a-z0-9]"
SENTENCE_BREAK = r"(?U)(?<=[.!?;:])[\s\x1c-\x1f]+(?=[A-Z(\[])"
CITATION = r"\[(\d+)\]"
CODE_PHRASING = r"(HCS-[A-Z]{2,4}-\d{4}|[A-Z]{3}-[A-Z]{3}(-\d+)?|clause \d)"
RETRY_DELAY = r"(?i)retry(?:Delay'?:?\s*'?| in )\s*([0-9]+(?:\.[0-9]+)?)s"
RETRY_ALWAYS = ("RESOURCE_EXHAUSTED", "429")
RETRY_NEVER = ("400 ", "401 ", "403 ", "404 ", "INVALID_ARGUMENT")
# --- fixed values: document ids are shortened for reports by these replacements, in order ---
SHORT_NAMES = (
    ("onboarding_", "onb_"),
    ("_procurement", ""),
    ("supplier_framework_agreement", "framework"),
    ("returns_and_warranty_policy", "returns"),
    ("quality_inspection_procedure", "quality"),
)

_FIRST_LINE = r"(?U)\A[\s\x1c-\x1f]*([^\n]*)"
_MARKDOWN_TITLE = r"(?sU)\A#[\s\x1c-\x1f]+(.+)\z"
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Lambda bodies get no common-subexpression elimination, so a value that a body mentions twice
    would otherwise be computed twice per element.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def strip_newlines(text: Column) -> Column:
    return F.trim(text, F.lit("\n"))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def flatten_space(text: Column) -> Column:
    """Every whitespace run becomes one space; none at the ends."""
    return strip(F.regexp_replace(text, _SPACE_RUN, " "))


def preview(text: Column, width: int = 96) -> Column:
    return let(
        flatten_space(text),
        lambda flat: F.when(F.length(flat) <= width, flat).otherwise(
            F.concat(F.substring(flat, 1, width - 3), F.lit("..."))
        ),
    )


def normalise(text: Column) -> Column:
    """Drop byte-order marks, unify line ends, trim line ends and outer newlines."""
    unified = F.regexp_replace(F.ltrim(text, F.lit("\ufeff")), r"\r\n?", "\n")
    lines = F.transform(F.split(unified, "\n"), lambda line: F.rtrim(line, F.lit(WHITESPACE)))
    return strip_newlines(F.array_join(lines, "\n"))


def title(text: Column, fmt: Column, fallback: Column) -> Column:
    """First non-blank line; in markdown without its level-1 marker."""
    first = strip(F.regexp_extract(text, _FIRST_LINE, 1))

    def named(line: Column) -> Column:
        heading = F.regexp_extract(line, _MARKDOWN_TITLE, 1)
        return (
            F.when(line == "", fallback)
            .when((fmt == "markdown") & (heading != ""), strip(heading))
            .otherwise(line)
        )

    return let(first, named)


def tokenize(text: Column) -> Column:
    """Lower-case words; a compound such as ``frm-crb-52`` is followed by its parts."""
    lowered = F.lower(text)
    words = F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))

    def with_parts(word: Column) -> Column:
        compound = F.contains(word, F.lit("-")) | F.contains(word, F.lit(".")) | F.contains(word, F.lit("/"))
        return F.when(compound, F.concat(F.array(word), F.split(word, "[-./]"))).otherwise(F.array(word))

    # Most texts have no compound at all; one scan for one spares the per-word work.
    return F.when(~F.rlike(lowered, F.lit(COMPOUND)), words).otherwise(
        F.flatten(F.transform(words, with_parts))
    )


def sentences(text: Column) -> Column:
    """Split after terminal punctuation that is followed by a capital or a bracket."""
    parts = F.filter(F.transform(F.split(text, SENTENCE_BREAK), strip), lambda part: part != "")
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip(text))))


def citation_numbers(text: Column) -> Column:
    """The numbers in ``[n]`` markers, in order, of any size: decimal text without leading zeros."""
    digits = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.transform(digits, lambda d: F.regexp_replace(d, "^0+(?=.)", ""))


def number_within(number: Column, most: Column) -> Column:
    """Whether decimal text is a number from 1 to ``most``."""
    return F.coalesce(number.try_cast("bigint").between(F.lit(1), most), F.lit(False))


def sorted_numbers(numbers: Column) -> Column:
    """Decimal texts in the order of their numbers; those beyond 38 digits last, by length and digits."""
    placed = F.transform(numbers, lambda n: F.struct(n.try_cast("decimal(38,0)").isNull().alias("wide"), n.try_cast("decimal(38,0)").alias("value"), F.length(n).alias("size"), n.alias("number")))
    return F.transform(F.array_sort(placed), lambda p: p["number"])


def strip_citations(text: Column, numbers: Column) -> Column:
    """Remove the given markers, then tidy the spaces they leave behind."""
    removed = F.aggregate(
        numbers,
        text,
        lambda acc, n: F.replace(acc, F.concat(F.lit("["), n, F.lit("]")), F.lit("")),
    )
    tidy = F.regexp_replace(removed, r"[ \t]{2,}", " ")
    tidy = F.replace(F.replace(tidy, F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(","))
    return strip(tidy)


def highlight_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, ":blue-background[**[$1]**]")


def is_code_phrased(text: Column) -> Column:
    return F.rlike(text, F.lit(CODE_PHRASING))


def short_id(doc_id: Column) -> Column:
    out = doc_id
    for old, new in SHORT_NAMES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def is_retryable(message: Column) -> Column:
    def any_of(needles: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(message, F.lit(needle))
        return hit

    return any_of(RETRY_ALWAYS) | ~any_of(RETRY_NEVER)


def retry_delay(message: Column, cap: float) -> Column:
    """Seconds a service asked for, plus half a second, capped; 0 when it did not ask."""
    seconds = F.regexp_extract(message, RETRY_DELAY, 1)
    return F.when(seconds == "", F.lit(0.0)).otherwise(
        F.least(seconds.cast("double") + 0.5, F.lit(float(cap)))
    )


def contains_flat(haystack: Column, needle: Column) -> Column:
    return F.contains(haystack, flatten_space(needle))


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
