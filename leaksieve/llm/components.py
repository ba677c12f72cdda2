"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges for each task that reads a round's result.
EDGES_PER_TASK = 500_000


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two parents, or a parent has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return bool(seen.filter("out > 1 or (out = 1 and into = 1)").limit(1).count())


def _kept(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    edges = stored(edges if rows is None else edges.coalesce(max(1, -(-rows // EDGES_PER_TASK))))
    return edges, edges.count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of the links; root is the smallest node reachable.

    Alternates two star contractions until every node hangs on a root: a node
    hands its smallest neighbour to its larger ones, then to its smaller ones.
    Each takes a partial aggregation and a join on the node, which Spark can
    split where a node has many neighbours. Rounds grow with the logarithm of the
    longest path. Null ends and loops are ignored; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    edges, rows = _kept(edges)
    edges = edges.coalesce(max(1, -(-rows // EDGES_PER_TASK)))
    while rows and _unfinished(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges, rows = _kept(star, rows)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
