"""Generators: files to lines, lines to fields, files to quoted literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.text import drop_carriage_return, fields, raw_lines, split_lines
from leaksieve.operators.languages import with_language

# A quoted literal on one line, with backslash escapes; the quotes are not part of the unit.
_LITERAL = r'''"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|`[^`]*+`'''


def readable_lines(text: Column, line_limit: int | None = None) -> Column:
    """The lines of a text; with ``line_limit``, those before the first line of that many bytes."""
    pieces = split_lines(text)
    if line_limit is None:
        return pieces
    first_long = F.array_position(F.transform(pieces, lambda line: F.octet_length(line) >= line_limit), F.lit(True))
    return F.when(first_long == 0, pieces).otherwise(F.slice(pieces, 1, (first_long - 1).cast("int")))


def _numbered(files: DataFrame) -> Column:
    """The line number of position ``pos``; a file cut into blocks numbers on from ``line_base``."""
    number = F.col("pos") + 1
    return (number + F.col("line_base") if "line_base" in files.columns else number).cast("int")


def _raw_line_rows(files: DataFrame, keep: tuple[str, ...], line_limit: int | None) -> DataFrame:
    base = ("line_base",) if "line_base" in files.columns else ()
    rows = files.select(*keep, *base, F.posexplode(readable_lines(F.col("text"), line_limit)).alias("pos", "line"))
    return rows.select(*keep, _numbered(files).alias("line_no"), "line")


def lines(files: DataFrame, keep: tuple[str, ...] = ("path",), line_limit: int | None = None) -> DataFrame:
    """One row per line, counted from 1, without its terminator."""
    rows = _raw_line_rows(files, keep, line_limit)
    return rows.withColumn("line", drop_carriage_return(F.col("line")))


def tokens(files: DataFrame, keep: tuple[str, ...] = ("path",), line_limit: int | None = None) -> DataFrame:
    """One row per field; ``col`` is its ordinal within the line, counted from 1."""
    rows = _raw_line_rows(files, keep, line_limit)
    cut = rows.select(*keep, "line_no", F.posexplode(fields(F.col("line"))).alias("pos", "token"))
    return cut.select(*keep, "line_no", (F.col("pos") + 1).cast("int").alias("col"), "token")


def token_counts(files: DataFrame) -> DataFrame:
    """What there is to scan in each file with tokens: their number and bytes, the sum of their ordinals, and the last line with one.

    A file is one row, so nothing is grouped and nothing moves.
    """
    cut = F.transform(raw_lines(F.col("text")), fields)
    per_line = F.transform(
        "__cut",
        lambda line, at: F.struct(
            F.size(line).cast("bigint").alias("n"),
            F.aggregate(line, F.lit(0).cast("bigint"), lambda total, token: total + F.octet_length(token)).alias("bytes"),
            F.when(F.size(line) > 0, at + 1).otherwise(0).alias("line_no"),
        ),
    )

    def total(value) -> Column:
        return F.aggregate("__lines", F.lit(0).cast("bigint"), lambda sum_, line: sum_ + value(line))

    counted = files.select("path", cut.alias("__cut")).withColumn("__lines", per_line)
    return counted.select(
        "path",
        total(lambda line: line.n).alias("n_tokens"),
        total(lambda line: (line.n * (line.n + 1) / 2).cast("bigint")).alias("sum_col"),
        F.array_max(F.transform("__lines", lambda line: line.line_no)).cast("int").alias("last_line"),
        total(lambda line: line.bytes).alias("n_bytes"),
    ).filter("n_tokens > 0")


def literals(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per quoted literal of a file in a known language; ``byte_col`` is the byte of its opening quote in the line, from 1.

    Whole literals, blanks included, stand in for the leaves of a syntax tree.
    This is an approximation: no grammar is consulted, and a literal that spans
    lines is not seen.
    """
    known = with_language(files).filter(F.col("language").isNotNull())
    rows = _raw_line_rows(known, (*keep, "language"), None)
    found = F.regexp_extract_all(F.col("line"), F.lit(_LITERAL), F.lit(0))
    # The stretches between the literals, in order: with the literals before, they make up the bytes before.
    between = F.split("line", _LITERAL, -1)
    rows = rows.withColumn("units", found).withColumn("between", between)
    cut = rows.select(*keep, "language", "line_no", "units", "between", F.posexplode("units").alias("pos", "quoted"))
    ahead = F.concat(F.array_join(F.slice("between", 1, F.col("pos") + 1), ""), F.array_join(F.slice("units", 1, F.col("pos")), ""))
    return cut.select(
        *keep,
        "language",
        "line_no",
        (F.col("pos") + 1).cast("int").alias("unit_no"),
        (F.octet_length(ahead) + 1).cast("int").alias("byte_col"),
        F.col("quoted").substr(F.lit(2), F.char_length("quoted") - 2).alias("token"),
    )
