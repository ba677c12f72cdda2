"""Rendezvous hashing of stable record keys over weighted shards.

For each shard a hash of key and shard gives u in (0, 1), and the shard of the
greatest -weight / ln(u) gets the record. A further shard changes none of the
earlier numbers, so records move into it and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unit

#: Parts of a shard whose rows are numbered together; their counts are all that is broadcast.
BUCKETS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)``; ties go to the smaller shard, a null key counts as an empty one."""
    best = [F.struct((-F.lit(float(w)) / F.log(unit(key, F.lit(i)))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-(F.greatest(*best) if len(best) > 1 else best[0])["shard"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], id_column: str = "doc_id", shard_column: str = "shard") -> DataFrame:
    """All columns and the row's shard; no row moves between tasks. A column of that name is replaced."""
    return docs.withColumn(shard_column, rendezvous(F.col(id_column), weights))


def shard_plan(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown: float = 1.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row: id, size, text_crc32, law, shard, slot and grown_shard.

    ``slot`` numbers a shard's rows from 0 without gaps, ``grown_shard`` is the
    shard once one of weight ``grown`` is added. Size is the bytes of the text
    and 1; null and empty texts have 1 and a checksum of 0. Equal rows get a slot
    each. Texts stay where they are read: only ids, sizes and checksums move, and
    equal rows are counted before they do.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("shard", rendezvous(F.col(id_column), weights))
    counted = counted.withColumn("grown_shard", rendezvous(F.col(id_column), [*weights, grown]))
    counted = stored(counted.withColumn("__bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)).cast("int")))
    totals = counted.groupBy("shard", "__bucket").agg(F.sum("__n").alias("__rows"))
    earlier = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "__bucket", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(*rows.columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(starts), ["shard", "__bucket"])  # at most shards * buckets rows
    slot = F.explode(F.sequence(F.col("__start") + F.col("__before"), F.col("__start") + F.col("__before") + F.col("__n") - 1))
    return placed.select(id_column, "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
