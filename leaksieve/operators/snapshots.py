"""What changed between two snapshots of a file set.

Texts are compared by digest, so only paths and digests are shuffled. A path is
unique within a snapshot. A snapshot may bring its digests in a column
``digest`` (see ``digests``); then its text is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.filters import TokenFilter
from leaksieve.operators.scan import has_hit, located_hits, one_row_per_file


def _digest(snapshot: DataFrame) -> Column:
    one_row_per_file(snapshot)
    return F.col("digest") if "digest" in snapshot.columns else F.sha2(F.col("text").cast("binary"), 256)


def digests(snapshot: DataFrame) -> DataFrame:
    """What to store of a snapshot in order to compare the next one with it."""
    return snapshot.select("path", _digest(snapshot).alias("digest"))


def snapshot_status(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``path`` and ``status`` (untracked, modified, deleted) of all that is not as it was."""
    old = previous.select("path", _digest(previous).alias("old"), F.lit(True).alias("was"))
    new = current.select("path", _digest(current).alias("new"), F.lit(True).alias("is"))
    status = (
        F.when(F.col("was").isNull(), "untracked")
        .when(F.col("is").isNull(), "deleted")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    )
    joined = old.join(new, "path", "full_outer").select("path", status.alias("status"))
    return joined.filter(F.col("status").isNotNull())


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that are new or differ; deleted ones are left out."""
    return snapshot_status(previous, current).filter(F.col("status").isin("untracked", "modified"))


def changed_manifest(previous: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of a manifest that are new, or whose size or time is not as it was; no text is read."""
    old = previous.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"))
    same = (F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime"))
    joined = manifest.join(old, "path", "left").filter(~F.coalesce(same, F.lit(False)))
    return joined.select(*manifest.columns)


def scan_changed(
    previous: DataFrame, current: DataFrame, token_filter: TokenFilter, max_file_size: int | None = None
) -> DataFrame:
    """By-file findings of the changed files.

    The current snapshot is scanned where it lies, in one pass that yields the
    hits and the digest, and only files with hits meet the old digests. So no
    text is shuffled and none is read twice. (An outer join stays above the
    scan; an anti join would be pushed below it.)
    """
    one_row_per_file(current)
    if max_file_size is not None:
        current = current.filter(F.col("size") <= max_file_size)
    found = current.filter(has_hit(F.col("text"), token_filter)).select(
        "path", _digest(current).alias("new"), located_hits(F.col("text"), token_filter).alias("hits")
    )
    old = previous.select("path", _digest(previous).alias("old"), F.lit(True).alias("was"))
    changed = F.col("was").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return found.join(old, "path", "left").filter(changed).select("path", "hits")
