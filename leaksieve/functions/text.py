"""Cutting text into lines and white-space separated fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) gives \S the Unicode White_Space property. It is also far cheaper than the
# spelled-out class, which the regex engine tests range by range for every char.
_FIELD = r"(?U)\S+"


def fields(line: Column) -> Column:
    """The fields of a line, in order; empty for a blank line."""
    return F.regexp_extract_all(line, F.lit(_FIELD), F.lit(0))


def fields_from(text: Column, min_chars: int) -> Column:
    """The fields of ``text`` that have at least ``min_chars`` code points, in order."""
    if min_chars <= 1:
        return fields(text)
    # The look-behind and the possessive count make one attempt per field.
    return F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\S)\S{{{min_chars},}}+"), F.lit(0))


def raw_lines(text: Column) -> Column:
    """``text`` cut at every line feed; joining with line feeds gives ``text`` back."""
    return F.split(text, "\n")


def split_lines(text: Column) -> Column:
    """Lines as a line reader yields them: no empty line after a final line feed."""
    pieces = raw_lines(text)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def drop_carriage_return(line: Column) -> Column:
    """Remove one trailing carriage return."""
    return F.when(line.endswith("\r"), F.regexp_replace(line, r"\r\z", "")).otherwise(line)
