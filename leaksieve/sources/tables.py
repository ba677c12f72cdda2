"""Tables of text as ``files`` relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.views import text_or_view


# What identifies a row of each table.
KEYS = {
    "documents": ("doc_id",),
    "pages": ("page_id",),
    "conversations": ("conv_id", "turn"),
    "labels": ("doc_id",),
}


#: Session setting that has ``read_table`` redistribute tables; for tables of one row group, such as test data.
SPREAD = "spark.leaksieve.spread"


def read_table(spark: SparkSession, folder: str, name: str, where: Column | None = None, spread: bool | None = None) -> DataFrame:
    """The rows of one table that satisfy ``where``, as they are read.

    With ``spread`` (by default the session setting ``SPREAD``, which is off) the rows
    are redistributed by their key first: this sends all text through a shuffle,
    and pays only where a small table's one row group would be one busy task.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    if where is not None:
        table = table.filter(where)
    if spread is None:
        spread = spark.conf.get(SPREAD, "false") == "true"
    if not spread:
        return table
    width = spark.sparkContext.defaultParallelism
    # By key and not in turn: the latter would sort whole texts first. The test
    # holds for every row; being non-deterministic it keeps later filters above
    # the exchange, since below it they would run in the few tasks again.
    return table.repartition(width, *KEYS[name]).filter(F.spark_partition_id() >= 0)


def as_files(table: DataFrame, path: Column, text: Column, mode: Column | None = None) -> DataFrame:
    """The ``files`` relation of any table with a text column; unused columns are not read."""
    return table.select(
        path.alias("path"),
        F.octet_length(text).cast("bigint").alias("size"),
        (F.lit(0o644) if mode is None else mode).cast("int").alias("mode"),
        F.lit(None).cast("timestamp").alias("mtime"),
        text.alias("text"),
    )


def as_byte_files(table: DataFrame, path: Column, content: Column, mode: Column | None = None) -> DataFrame:
    """The ``files`` relation of a table with binary content, and ``valid_utf8``; other content is a byte view (see ``scan_exact``)."""
    files = as_files(table.withColumn("__content", content), path, F.col("__content"), mode)
    return files.withColumns({"valid_utf8": F.is_valid_utf8(F.col("text").cast("string")), "text": text_or_view(F.col("text"))})


def document_path() -> Column:
    """A path per document, made up so that each file predicate meets some."""
    special = {0: "go.sum", 1: "LICENSE", 2: "LICENSE-MIT", 3: "x.secret", 4: "keep.secret", 5: ".git/obj", 6: ".env"}
    suffix = {0: "py", 1: "go", 2: "js", 3: "md"}
    extension = F.lit("bin")
    for rest, name in suffix.items():
        extension = F.when(F.col("doc_id") % 5 == rest, name).otherwise(extension)
    name = F.concat(F.lit("doc."), extension)
    for rest, fixed in special.items():
        name = F.when(F.col("doc_id") % 25 == rest, fixed).otherwise(name)
    return F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")), name)


def document_files(documents: DataFrame) -> DataFrame:
    mode = F.when(F.col("doc_id") % 13 == 0, 0o755).otherwise(0o644)
    return as_files(documents, document_path(), F.col("text"), mode)


def page_files(pages: DataFrame) -> DataFrame:
    return as_files(pages, F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))


def conversation_files(turns: DataFrame) -> DataFrame:
    path = F.concat(F.lit("chat/"), F.concat_ws("/", "conv_id", "turn"), F.lit(".txt"))
    return as_files(turns, path, F.col("text"))
