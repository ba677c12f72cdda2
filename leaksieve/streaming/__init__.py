"""Scanning files as they arrive. Both forms are stateless, so neither needs a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leaksieve.operators.filters import TokenFilter
from leaksieve.operators.findings import flag_files
from leaksieve.operators.scan import scan, scan_exact


# Files, and bytes, that one micro-batch takes at most.
BATCH_FILES = 1000
BATCH_BYTES = "64g"


def stream_table(
    spark: SparkSession, table: str, schema: T.StructType, max_files: int = BATCH_FILES, max_bytes: str | None = None
) -> DataFrame:
    """A parquet table, one file or a folder of them, as a stream in batches of bounded size.

    A batch is bounded by files or, if ``max_bytes`` is given, by bytes.
    """
    reader = spark.readStream.schema(schema)
    limit = ("maxFilesPerTrigger", max_files) if max_bytes is None else ("maxBytesPerTrigger", max_bytes)
    # As a pattern that only the table's own path fits: a stream takes no path of a single file.
    return reader.option(*limit).parquet(f"{table[:-1]}[{table[-1]}]")


def _start(rows: DataFrame, folder: str, checkpoint: str, partition: str | None, continuous: str | None):
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(partition)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start(folder)


def start_scan(
    files: DataFrame, token_filter: TokenFilter, folder: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append the findings of each new file to ``folder``.

    Without ``every`` all that is available is scanned, then the query ends. The
    file sink's log makes the output exactly-once. Streams of a folder tree (``stream_tree``) may hold byte views, and are scanned as such.
    """
    found = scan_exact(files, token_filter) if "exact" in files.columns else scan(files, token_filter)
    return _start(found, folder, checkpoint, None, every)


def start_gate(
    files: DataFrame, token_filter: TokenFilter, folder: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write each new file to ``verdict=clean`` or ``verdict=quarantined`` below ``folder``.

    One pass and one exactly-once sink serve both sides.
    """
    verdict = F.when(F.col("flagged"), "quarantined").otherwise("clean")
    routed = flag_files(files, token_filter).withColumn("verdict", verdict).drop("flagged")
    return _start(routed, folder, checkpoint, "verdict", every)


_DECISION = T.StructType([
    T.StructField("n_files", T.LongType()),
    T.StructField("n_flagged", T.LongType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])


def start_batch_gate(
    files: DataFrame, token_filter: TokenFilter, folder: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Admit the files of a micro-batch together, or none of them if any has a hit (see ``batch_files``).

    Each batch writes its files once, with what was found in them, to a folder of its number, and then its decision.
    Both replace what an earlier try of the same batch left, and files without a decision are not
    shown, so a batch that is run again changes nothing and a reader never sees half of one.
    """
    flagged = flag_files(files, token_filter)

    def decide(batch: DataFrame, number: int) -> None:
        staged = f"{folder}/files/batch_id={number}"
        batch.write.mode("overwrite").parquet(staged)
        found = batch.sparkSession.read.schema(batch.schema).parquet(staged)
        counted = found.agg(F.count("*").alias("n_files"), F.count_if("flagged").alias("n_flagged"))
        verdict = F.when(F.col("n_flagged") > 0, "refused").otherwise("admitted").alias("verdict")
        counted.select("*", verdict).coalesce(1).write.mode("overwrite").parquet(f"{folder}/decisions/batch_id={number}")

    writer = flagged.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def batch_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """``batch_id``, ``n_files``, ``n_flagged`` and ``verdict`` (admitted or refused) of the batches decided so far."""
    return spark.read.schema(_DECISION).parquet(f"{folder}/decisions")


def batch_files(spark: SparkSession, folder: str, schema: T.StructType, verdict: str | None = None) -> DataFrame:
    """Files of decided batches, or of those with one verdict, with ``batch_id``, ``verdict`` and ``flagged``; ``schema`` is that of the streamed files.

    Decisions are a row a batch; they leave out the folders of other batches before anything in them is read.
    """
    whole = T.StructType([*schema.fields, T.StructField("flagged", T.BooleanType()), T.StructField("batch_id", T.LongType())])
    decided = batch_decisions(spark, folder).select("batch_id", "verdict")
    decided = decided if verdict is None else decided.filter(F.col("verdict") == verdict)
    return spark.read.schema(whole).parquet(f"{folder}/files").join(decided, "batch_id")
