"""String expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole-text code fence, with or without the json tag (fixed pattern).
FENCE = r"(?s)^```(?:json)?\s*\n(.*?)\n```\s*$"


def suffix_keys(name: Column) -> Column:
    """The name itself and every part of it that follows an underscore."""
    parts = F.size(F.split(name, "_"))
    return F.transform(
        F.sequence(F.lit(1), parts),
        lambda i: F.call_function("substring_index", name, F.lit("_"), -i),
    )


def strip_fence(text: Column) -> Column:
    """The fenced body when the whole trimmed text is one code fence, else the text as is."""
    trimmed = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    # Most texts have no fence at all, and are not trimmed.
    fenced = text.contains("```") & trimmed.startswith("```") & trimmed.rlike(FENCE)
    return F.when(fenced, F.regexp_extract(trimmed, FENCE, 1)).otherwise(text)


def strip_prefix(name: Column) -> Column:
    """Drop a one-letter table prefix such as ``c_`` (an option for matching, off by default)."""
    return F.regexp_replace(name, "^[a-z]_", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(**values: Column) -> Column:
    """Columns computed once per row, even when a later filter refers to them.

    A predicate is pushed through a projection by repeating its expressions;
    it is not pushed through a generator.  For expensive parsing only.
    """
    return F.inline(F.array(F.struct(*[value.alias(name) for name, value in values.items()])))


def grams(text: Column, n: int) -> Column:
    """All pieces of ``n`` characters, each once; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))))
