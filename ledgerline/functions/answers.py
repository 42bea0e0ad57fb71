"""Parsing of free-text analysis answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.coerce import strip

INSIGHT = "struct<title: string, summary: string, recommendation: string, severity: string>"

# The insight and the recommendation used when a text holds none.
DEFAULT_TITLE = "AI Insight"
DEFAULT_RECOMMENDATION = "See full response for details."
DEFAULT_SEVERITY = "info"
DEFAULT_STEP = "Review order lifecycle for any incomplete stages."

_FENCE = r"```(?:json)?"
_BRACKETED = r"(?s)\[.*\]"
_NUMBERED = r"^[0-9]+\."
_NUMBERING = r"^(?:[0-9]+\. *)+"


def _parsed(text: Column, shape: str) -> Column:
    # Parsed inside an enclosing array: text left over after the closing bracket
    # then makes the whole value invalid instead of being ignored, and what
    # would add a further element is seen by the array's length.
    enclosed = F.concat(F.lit("["), text, F.lit("]"))
    found = F.from_json(enclosed, f"array<{shape}>")
    return F.when(F.json_array_length(enclosed) == 1, F.get(found, F.lit(0)))


def _opening(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def insights(raw: Column, summary_chars: int | None = None) -> Column:
    """Insights in an answer: a JSON array (fenced or embedded in prose), a
    single JSON object, or one default insight that quotes the text.

    The text is quoted whole, or its first ``summary_chars`` characters for
    display.  NULL elements of an array are left out; an empty array stays empty.
    """
    text = strip(F.regexp_replace(raw, _FENCE, ""))
    block = F.nullif(F.regexp_extract(text, _BRACKETED, 0), F.lit(""))
    quoted = F.struct(
        F.lit(DEFAULT_TITLE).alias("title"),
        _opening(raw, summary_chars).alias("summary"),
        F.lit(DEFAULT_RECOMMENDATION).alias("recommendation"),
        F.lit(DEFAULT_SEVERITY).alias("severity"),
    )
    single = _parsed(text, INSIGHT)
    found = F.coalesce(
        _parsed(block, f"array<{INSIGHT}>"),
        _parsed(text, f"array<{INSIGHT}>"),
        F.when(single.isNotNull(), F.array(single)),
        F.array(quoted),
    )
    return F.filter(found, lambda insight: insight.isNotNull())


def _lines(raw: Column) -> Column:
    trimmed = F.transform(F.split(raw, "\n"), strip)
    return F.filter(trimmed, lambda line: line != "")


def recommendations(raw: Column) -> Column:
    """Numbered lines without their numbering; one default if there are none.

    Lines that follow a numbered one without a number of their own continue it.
    """
    lines = _lines(raw)
    first = F.array_position(F.transform(lines, lambda line: line.rlike(_NUMBERED)), True)
    rest = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.slice(lines, 1, 0))
    marked = F.transform(
        rest,
        lambda line: F.when(line.rlike(_NUMBERED), F.concat(F.lit("\n"), F.regexp_replace(line, _NUMBERING, "")))
        .otherwise(F.concat(F.lit(" "), line)),
    )
    # every step begins with a line break, which no line contains
    steps = F.split(F.substr(F.array_join(marked, ""), F.lit(2)), "\n")
    return F.when(first > 0, steps).otherwise(F.array(F.lit(DEFAULT_STEP)))


def analysis(raw: Column, chars: int | None = None) -> Column:
    """Text before the first numbered line, on one line; else the text itself, or its first ``chars`` characters."""
    lines = _lines(raw)
    first = F.array_position(F.transform(lines, lambda line: line.rlike(_NUMBERED)), True)
    before = F.when(first > 0, F.slice(lines, 1, (first - 1).cast("int"))).otherwise(lines)
    joined = F.array_join(before, " ")
    return F.coalesce(F.nullif(joined, F.lit("")), _opening(raw, chars))
