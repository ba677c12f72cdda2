"""Reading a folder tree that every executor can see.

Spark's own file source drops names that start with a dot or an underscore and
knows no mode bits, so a tree is listed here: one job per level of depth, each
folder by whichever task holds it, and the levels stored as tables.
"""

from __future__ import annotations

import math
import os
import stat
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.model import FILES, MANIFEST
from leaksieve.session import scratch_dir

_LISTED = T.StructType([*MANIFEST.fields, T.StructField("is_folder", T.BooleanType())])
_BATCH_ROWS = 10_000
_BATCH_BYTES = 32 * 1024 * 1024
_TASK_BYTES = 128 * 1024 * 1024
#: Bytes that a line may have before a block is refused: a line is read, and held, as a whole.
MAX_LINE_BYTES = 256 * 1024 * 1024
_READ = T.StructType([*FILES.fields, T.StructField("valid_utf8", T.BooleanType()), T.StructField("read_error", T.StringType())])
_READ_BLOCKS = T.StructType([*_READ.fields, T.StructField("line_base", T.LongType())])

def _children(root: str, folder: str) -> Iterator[tuple]:
    """Folders and readable files directly below ``folder``. A folder that cannot be listed raises."""
    with os.scandir(os.path.join(root, folder)) as entries:
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                yield path, None, None, None, True
                continue
            try:
                own, target = entry.stat(follow_symlinks=False), entry.stat()
            except OSError:
                continue
            if stat.S_ISREG(target.st_mode):
                mtime = pd.Timestamp(own.st_mtime_ns, tz="UTC").floor("us")
                yield path, own.st_size, stat.S_IMODE(target.st_mode), mtime, False


def _listing_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_LISTED.names)
    return frame.astype({"size": "Int64", "mode": "Int32", "mtime": "datetime64[us, UTC]"})


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of all files below ``root``; paths are relative to it. No text is read."""
    store = scratch_dir(spark, "listing")
    width = spark.sparkContext.defaultParallelism

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch["path"]:
                for child in _children(root, folder):
                    rows.append(child)
                    if len(rows) >= _BATCH_ROWS:
                        yield _listing_frame(rows)
                        rows = []
        if rows:
            yield _listing_frame(rows)

    folders = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        stored = f"{store}/{len(levels):04d}"
        folders.mapInPandas(expand, _LISTED).write.parquet(stored)
        level = spark.read.schema(_LISTED).parquet(stored)
        levels.append(level)
        folders = level.filter("is_folder").select("path").repartition(width, "path")
        if level.filter("is_folder").isEmpty():
            break
    listed = reduce(DataFrame.unionByName, levels)
    return listed.filter(~F.col("is_folder")).drop("is_folder")


def _decode(content: bytes, exact: bool = False) -> tuple[str, bool, None]:
    try:
        return content.decode("utf-8"), True, None
    except UnicodeDecodeError:
        return content.decode("latin-1") if exact else content.decode("utf-8", errors="replace"), False, None


def _failed(error: OSError) -> tuple[None, None, str]:
    return None, None, f"{type(error).__name__}: {error}"


def unreadable(files: DataFrame) -> DataFrame:
    """Path and error of the files, or blocks, that could not be read."""
    return files.filter(F.col("read_error").isNotNull()).select("path", "read_error")


def all_readable(files: DataFrame) -> DataFrame:
    """The same files; the job that reads them fails at one that could not be read."""
    refused = F.raise_error(F.concat(F.lit("cannot read "), F.col("path"), F.lit(": "), F.col("read_error")))
    return files.withColumn("text", F.when(F.col("read_error").isNotNull(), refused.cast("string")).otherwise(F.col("text")))


def _batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows whose fifth field is a text, in frames of bounded size."""
    held: list[tuple] = []
    length = 0
    for row in rows:
        held.append(row)
        length += len(row[4] or "")
        if length >= _BATCH_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, length = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _tasks(manifest: DataFrame) -> int:
    """A manifest row stands for as many bytes as its file has, so the task count follows the bytes."""
    total = manifest.agg(F.sum("size")).first()[0] or 0
    return max(manifest.sparkSession.sparkContext.defaultParallelism, math.ceil(total / _TASK_BYTES))


def read_files(manifest: DataFrame, root: str) -> DataFrame:
    """Add the text of each file of a (filtered) manifest, a file in a row.

    Bytes that are not UTF-8 become replacement characters, and ``valid_utf8``
    says so. A file that cannot be read has no text, and ``read_error`` says why
    (see ``unreadable`` and ``all_readable``).
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    with open(os.path.join(root, row.path), "rb") as handle:
                        yield (*row, *_decode(handle.read()))
                except OSError as error:
                    yield (*row, *_failed(error))

    spread = manifest.select(*MANIFEST.names).repartition(_tasks(manifest), "path")
    return spread.mapInPandas(lambda batches: _batches(texts(batches), _READ.names), _READ)


def read_blocks(
    manifest: DataFrame, root: str, block_bytes: int = _TASK_BYTES, max_line_bytes: int = MAX_LINE_BYTES, exact: bool = False
) -> DataFrame:
    """As ``read_files``, but a large file comes as several rows of whole lines, each read by its own task.

    A row holds the lines that begin in its block. A line that goes on for more
    than ``max_line_bytes`` beyond it ends the job.

    With ``exact``, a block that is not UTF-8 is a byte view (see ``functions.views``), and a column ``exact`` says that there may be some.

    ``line_base`` is the number of lines before a row. To know it, the line
    feeds of files beyond one block are counted first, block by block as well.
    Operators that need a file in one row refuse such a table.
    """
    offsets = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(block_bytes).cast("bigint"))
    blocks = manifest.select(*MANIFEST.names, F.explode(offsets).alias("offset"))
    tasks = _tasks(manifest)

    def feeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def count(path: str, size: int, offset: int) -> int:
            if size <= block_bytes:
                return 0
            # Line numbers hang on this count: an error ends the job.
            with open(os.path.join(root, path), "rb") as handle:
                handle.seek(offset)
                return handle.read(block_bytes).count(b"\n")

        for batch in batches:
            yield batch.assign(feeds=[count(*key) for key in zip(batch["path"], batch["size"], batch["offset"])])

    counted = T.StructType([*MANIFEST.fields, T.StructField("offset", T.LongType()), T.StructField("feeds", T.LongType())])
    stored = scratch_dir(manifest.sparkSession, "blocks")
    blocks.repartition(tasks, "path", "offset").mapInPandas(feeds, counted).write.parquet(stored)
    # One row per block, so a window holds a file's size over the block size.
    earlier = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("feeds").over(earlier), F.lit(0)).alias("before")
    placed = manifest.sparkSession.read.schema(counted).parquet(stored).select(*MANIFEST.names, "offset", before)

    def lines(path: str, offset: int, last: bool) -> tuple[bytes, int]:
        """The lines that start within a block, and how many it skips before them."""
        with open(os.path.join(root, path), "rb") as handle:
            content = b""
            if offset:
                # A line that began earlier is looked through up to this block's end and no further.
                handle.seek(offset - 1)
                ahead = handle.read(block_bytes + 1)
                cut = ahead.find(b"\n", 0, block_bytes)
                if cut < 0:
                    return b"", 0
                content, skipped = ahead[cut + 1 :], int(cut > 0)
            else:
                content, skipped = handle.read(block_bytes), 0
            if last:
                content += handle.read()
            elif content and not content.endswith(b"\n"):
                rest = handle.readline(max_line_bytes + 1)
                if len(rest) > max_line_bytes:
                    raise ValueError(f"{path}: a line of more than {max_line_bytes} bytes")
                content += rest
            return content, skipped

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for *row, offset, earlier_feeds in batch.itertuples(index=False):
                try:
                    content, skipped = lines(row[0], offset, offset + block_bytes >= row[1])
                except OSError as error:
                    yield (*row, *_failed(error), earlier_feeds)
                    continue
                if content or offset == 0:
                    yield (*row, *_decode(content, exact), earlier_feeds + skipped)

    spread = placed.repartition(tasks, "path", "offset")
    read = spread.mapInPandas(lambda batches: _batches(texts(batches), _READ_BLOCKS.names), _READ_BLOCKS)
    return read.withColumn("exact", F.lit(True)) if exact else read
