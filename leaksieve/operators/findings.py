"""What is derived from findings: totals, gates, merges, reports.

Findings come in two forms: long (one row per hit, from ``scan``) and by file
(``path`` and an ordered array ``hits``, from ``scan_by_file``). The second is
made inside the row that holds the file, so no operator has to collect groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.filters import TokenFilter
from leaksieve.operators.scan import has_hit, one_row_per_file


def hit_total(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("freq"))


def gate(files: DataFrame, token_filter: TokenFilter) -> DataFrame:
    """One row that says whether any file has a hit."""
    return files.agg(F.coalesce(F.bool_or(has_hit(F.col("text"), token_filter)), F.lit(False)).alias("has_findings"))


def found_any(files: DataFrame, token_filter: TokenFilter) -> bool:
    """The gate for control flow: stops at the first flagged file."""
    return not files.filter(has_hit(F.col("text"), token_filter)).isEmpty()


def flag_files(files: DataFrame, token_filter: TokenFilter) -> DataFrame:
    one_row_per_file(files)
    return files.withColumn("flagged", has_hit(F.col("text"), token_filter))


def clean_files(files: DataFrame, token_filter: TokenFilter) -> DataFrame:
    return flag_files(files, token_filter).filter(~F.col("flagged")).drop("flagged")


def quarantined_files(files: DataFrame, token_filter: TokenFilter) -> DataFrame:
    return flag_files(files, token_filter).filter("flagged").drop("flagged")


def admit_batch(files: DataFrame, token_filter: TokenFilter) -> DataFrame:
    """All files, or none of them if any has a hit."""
    flagged = files.filter(has_hit(F.col("text"), token_filter))
    return files.filter(~flagged.exists())


def explode_hits(by_file: DataFrame) -> DataFrame:
    """By-file findings in long form.

    No file comes without hits, so the outer form adds nothing. The inner one
    would infer a test on the hits, and have them evaluated twice.
    """
    return by_file.select("path", F.inline_outer("hits"))


def merge_scans(*scans: DataFrame) -> DataFrame:
    """By-file findings of several scans in order: a later entry for a path replaces an earlier one.

    A scan that found nothing in a path leaves the earlier entry. Each scan
    brings at most one row per path, so no key grows with the number of hits.
    Paths are as walked: scans of several roots carry the root in the path
    (see ``scan_folders``), so equal relative paths stay apart.
    """
    if not scans:
        raise ValueError("no scans to merge")
    merged = scans[0].select("path", "hits")
    for scan in scans[1:]:
        newer = scan.select("path", F.col("hits").alias("newer"))
        merged = merged.join(newer, "path", "full_outer").select("path", F.coalesce("newer", "hits").alias("hits"))
    return merged


def report_lines(findings: DataFrame) -> DataFrame:
    """Long findings as readable lines: the hit, then its evidence. Sort by all columns but the last."""
    head = F.format_string("Line %d (Col %d): %s", "line_no", "col", "token")
    details = F.transform(
        F.array_sort(F.map_entries("payload")),
        lambda entry: F.concat(F.lit("  "), entry.key, F.lit(": "), entry.value),
    )
    return findings.select(
        "path", "line_no", "col", F.posexplode(F.concat(F.array(head), details)).alias("part", "message")
    )


def readable_report(findings: DataFrame) -> DataFrame:
    """``report_lines`` with a heading for each file, or the one line that nothing was found.

    Sort by all columns but the last; a heading has line 0.
    """
    headings = findings.select("path").distinct().select(
        "path", F.lit(0).alias("line_no"), F.lit(0).alias("col"), F.lit(0).alias("part"), F.concat(F.lit("Secrets in "), "path").alias("message")
    )
    nothing = findings.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("path"), F.lit(0).alias("line_no"), F.lit(0).alias("col"), F.lit(0).alias("part"),
        F.lit("Nothing was found.").alias("message"),
    )
    return headings.unionByName(report_lines(findings)).unionByName(nothing)


def report_meta(findings: DataFrame, author: str, timestamp: str) -> DataFrame:
    return hit_total(findings).select(F.lit(timestamp).alias("timestamp"), F.lit(author).alias("author"), "freq")


def report_entries(by_file: DataFrame) -> DataFrame:
    """By-file findings in the shape of the report: one entry of four parallel arrays per file."""
    return by_file.select(
        "path",
        F.struct(
            F.col("hits.token").alias("Lines"),
            F.col("hits.line_no").alias("Indexes"),
            F.col("hits.col").alias("Columns"),
            F.col("hits.payload").alias("Extracted"),
        ).alias("entry"),
    )


def entries_to_hits(entries: DataFrame) -> DataFrame:
    """The inverse of ``report_entries``."""
    zipped = F.arrays_zip("entry.Indexes", "entry.Columns", "entry.Lines", "entry.Extracted")
    return entries.select(
        "path",
        F.transform(
            zipped,
            lambda hit: F.struct(
                hit.Indexes.alias("line_no"),
                hit.Columns.alias("col"),
                hit.Lines.alias("token"),
                hit.Extracted.alias("payload"),
            ),
        ).alias("hits"),
    )
