"""Report sinks and readers.

``write_report`` stores one JSON row per file plus one row of meta data, in
parallel. ``write_document`` lays the same out as the parts of a single JSON
document, and ``read_document`` reads such a document as one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.model import CODE_LINES, REPORT_DOCUMENT, REPORT_META
from leaksieve.operators.findings import entries_to_hits, report_entries

_ENTRY_ROW = T.StructType([T.StructField("path", T.StringType()), T.StructField("entry", CODE_LINES)])


def write_report(by_file: DataFrame, folder: str, author: str, timestamp: str) -> None:
    """Overwrite ``folder`` with the entries and, counted from what was stored, the meta row."""
    report_entries(by_file).write.mode("overwrite").json(f"{folder}/data")
    stored = by_file.sparkSession.read.schema(_ENTRY_ROW).json(f"{folder}/data")
    total = F.coalesce(F.sum(F.size("entry.Indexes")), F.lit(0)).cast("bigint").alias("freq")
    meta = stored.agg(total).select(F.lit(timestamp).alias("timestamp"), F.lit(author).alias("author"), "freq")
    meta.write.mode("overwrite").json(f"{folder}/meta")


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    return entries_to_hits(spark.read.schema(_ENTRY_ROW).json(f"{folder}/data"))


def read_report_meta(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(REPORT_META).json(f"{folder}/meta")


def write_document(spark: SparkSession, report: str, folder: str) -> None:
    """Lay a stored report out as text parts that, joined in name order, are one JSON document.

    A range sort keeps the entries in path order, as a JSON encoder with sorted
    keys has them, and no task sees more than its own range.
    """
    entries = spark.read.schema(_ENTRY_ROW).json(f"{report}/data")
    meta = read_report_meta(spark, report)
    member = F.to_json(F.map_from_arrays(F.array("path"), F.array("entry")))
    last = entries.agg(F.max("path").alias("p")).scalar()
    comma = F.when(F.col("path") < last, ",").otherwise("")
    body = entries.select(
        F.lit(1).alias("section"),
        "path",
        F.concat(member.substr(F.lit(2), F.length(member) - 2), comma).alias("value"),
    )
    head = meta.select(
        F.lit(0).alias("section"),
        F.lit("").alias("path"),
        F.concat(F.lit('{"meta": '), F.to_json(F.struct("timestamp", "author", "freq")), F.lit(', "data": {')).alias(
            "value"
        ),
    )
    foot = meta.select(F.lit(2).alias("section"), F.lit("").alias("path"), F.lit("}}").alias("value"))
    lines = head.unionByName(body).unionByName(foot)
    lines.orderBy("section", "path").select("value").write.mode("overwrite").text(folder)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """By-file findings from a report document; a document is one JSON value, so one task reads it."""
    document = spark.read.schema(REPORT_DOCUMENT).option("multiLine", True).json(path)
    return entries_to_hits(document.select(F.explode("data").alias("path", "entry")))
