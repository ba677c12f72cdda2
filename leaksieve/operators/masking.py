"""Replacing flagged lines by a marker, and putting them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.text import fields, raw_lines
from leaksieve.operators.filters import TokenFilter
from leaksieve.operators.scan import has_hit, one_row_per_file

MARKER = "[line withheld by leaksieve]"


def mask_lines(files: DataFrame, token_filter: TokenFilter, marker: str = MARKER) -> DataFrame:
    """Replace whole lines that hold a hit.

    Adds ``vault``, the replaced lines as ``array<struct<line_no, original>>``;
    store it with ``vault_rows`` to be able to restore. One pass over each
    file's lines, in the row that holds the file.
    """
    one_row_per_file(files)

    def mark(line: Column, index: Column) -> Column:
        return F.struct(
            (index + 1).cast("int").alias("line_no"),
            line.alias("original"),
            F.exists(fields(line), token_filter.match).alias("hit"),
        )

    marked = files.withColumn(
        "marks", F.when(has_hit(F.col("text"), token_filter), F.transform(raw_lines(F.col("text")), mark))
    )
    masked = F.array_join(
        F.transform("marks", lambda m: F.when(m.hit, F.lit(marker)).otherwise(m.original)), "\n"
    )
    vault = F.transform(
        F.filter("marks", lambda m: m.hit),
        lambda m: F.struct(m.line_no.alias("line_no"), m.original.alias("original")),
    )
    return (
        marked.withColumn("vault", F.coalesce(vault, F.array().cast("array<struct<line_no:int,original:string>>")))
        .withColumn("text", F.coalesce(masked, F.col("text")))
        .drop("marks")
    )


def vault_rows(masked: DataFrame) -> DataFrame:
    """The vault as a table of its own: one row per file that was changed."""
    return masked.filter(F.size("vault") > 0).select("path", "vault")


def _replaced(files: DataFrame, changes: str) -> DataFrame:
    """``files`` with the lines that ``changes`` names by ``line_no`` set to ``original``; adds ``unmatched``.

    ``changes`` is a column name. Lines and changes are sorted together, a change
    before the line of its number, and the first of each number stays: the cost
    is that of the sort. The sorted array is a column of its own, so a look at the element
    before costs nothing. ``unmatched`` has the numbers beyond the last line.
    """
    lines = F.transform(
        raw_lines(F.col("text")),
        lambda line, at: F.struct((at + 1).alias("line_no"), F.lit(1).alias("kind"), line.alias("line")),
    )
    changed = F.transform(
        changes,
        lambda c: F.struct(c.line_no.cast("int").alias("line_no"), F.lit(0).alias("kind"), c.original.alias("line")),
    )
    ordered = files.withColumn("__lines", F.sort_array(F.concat(changed, lines)))

    def alike(x: Column, at: Column) -> Column:
        return F.coalesce(F.get("__lines", at).line_no == x.line_no, F.lit(False))

    # Only the sorted array may be looked at here: anything else would be computed for each of its elements.
    within = F.filter(
        "__lines",
        lambda x, at: F.when(x.kind == 1, (at == 0) | ~alike(x, at - 1)).otherwise(
            alike(x, at + 1) & (F.get("__lines", at + 1).kind == 1)
        ),
    )
    beyond = F.transform(
        F.filter("__lines", lambda x, at: (x.kind == 0) & ~alike(x, at + 1)), lambda x: x.line_no
    )
    text = F.array_join(F.transform(within, lambda x: x.line), "\n")
    return ordered.withColumn("text", text).withColumn("unmatched", beyond).drop("__lines")


def restore_lines(masked: DataFrame, vault: DataFrame, marker: str = MARKER) -> DataFrame:
    """Undo ``mask_lines`` with a stored vault.

    Only files that carry the marker meet the vault; the text of all others
    stays where it is.
    """
    columns = [name for name in masked.columns if name != "vault"]
    carries = F.col("text").contains(marker)
    untouched = masked.filter(F.coalesce(~carries, F.lit(True))).select(*columns)
    kept = vault.select("path", "vault")
    joined = masked.filter(carries).select(*columns).join(kept, "path", "left")
    joined = joined.withColumn("vault", F.coalesce("vault", F.array().cast("array<struct<line_no:int,original:string>>")))
    return untouched.unionByName(_replaced(joined, "vault").select(*columns))


def mask_reported(files: DataFrame, by_file: DataFrame, marker: str = MARKER) -> DataFrame:
    """The files that stored by-file findings name, with the lines they name masked.

    Only these files return; the others need no change and stay where they are.
    Adds ``unmatched``, the reported line numbers that the present text doesn't have:
    a file that is no longer as it was reported. Findings meet the texts by
    path; Spark sends them to the texts if they are small, and else keeps
    unreported texts out of the shuffle with a runtime filter where it can.
    """
    one_row_per_file(files)
    numbers = F.array_distinct(F.col("hits.line_no"))
    changes = by_file.select(
        "path",
        F.transform(numbers, lambda n: F.struct(n.alias("line_no"), F.lit(marker).alias("original"))).alias("__changes"),
    )
    named = files.filter(F.col("text").isNotNull()).join(changes, "path")
    return _replaced(named, "__changes").select(*files.columns, "unmatched")
