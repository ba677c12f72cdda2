"""Ordered groups of any size: running values and joins that no single key can crowd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Rows of a range of the order that one task takes at once.
PIECE_ROWS = 250_000
#: Rows of one key from which its match is broadcast rather than joined by shuffle.
HOT_ROWS = 50_000


def pieces(frame: DataFrame, group: list[str], order: list[str | Column], piece_rows: int | None = None) -> DataFrame:
    """The frame, stored, with ``piece``: rows of one piece are of one range of (group, order), and pieces rise with the order.

    A group of many rows lies in several pieces. Nulls come first. The order must tell the
    rows of a group apart, or a piece may hold more than its share. ``frame`` is read twice, so it should be stored.
    """
    count = max(1, -(-frame.count() // (piece_rows or PIECE_ROWS)))
    cut = frame.repartitionByRange(count, *group, *order) if count > 1 else frame.coalesce(1)
    return stored(cut.withColumn("piece", F.spark_partition_id()))


def running(cut: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """Rows of ``pieces`` with inclusive running sums and xors of their group in its order.

    Each (group, piece) runs by itself; what the pieces before it add is joined from a table that
    has rows for groups of several pieces only. Group columns must not be null.
    """
    inner = Window.partitionBy(*group, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(c).alias(n) for n, c in sums.items()] + [F.bit_xor(c).alias(n) for n, c in xors.items()]
    before = [F.sum(n).over(earlier).alias(f"{n}__before") for n in sums] + [F.bit_xor(n).over(earlier).alias(f"{n}__before") for n in xors]
    carried = cut.groupBy(*group, "piece").agg(*whole).select(*group, "piece", *before)
    carried = stored(carried.dropna(subset=[f"{n}__before" for n in (*sums, *xors)]))
    local = cut.select("*", *[F.sum(c).over(inner).alias(n) for n, c in sums.items()], *[F.bit_xor(c).over(inner).alias(n) for n, c in xors.items()])
    out = local.join(small(carried), [*group, "piece"], "left")
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.coalesce(f"{name}__before", F.lit(0)))
    for name in xors:
        out = out.withColumn(name, F.col(name).bitwiseXOR(F.coalesce(f"{name}__before", F.lit(0))))
    return out.drop(*[f"{n}__before" for n in (*sums, *xors)])


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """``left`` joined with the one row that ``right`` has of a key, though a key may hold any share of ``left``.

    Keys with more than ``hot_rows`` rows on the left are few, no more than its rows over that
    number, and their right rows are broadcast if they are within the bound of ``small``.
    ``left`` is read twice.
    """
    bound = HOT_ROWS if hot_rows is None else hot_rows
    crowded = stored(left.groupBy(*keys).count().filter(F.col("count") > bound).select(*keys))
    if not crowded.limit(1).count():
        return left.join(right, keys, how)
    hot = left.join(small(crowded), keys, "left_semi").join(small(stored(right.join(small(crowded), keys, "left_semi"))), keys, how)
    cold = left.join(small(crowded), keys, "left_anti").join(right, keys, how)
    return hot.unionByName(cold)
