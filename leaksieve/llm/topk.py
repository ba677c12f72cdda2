"""Exact top-k inner products: a ball tree in every shard, searched best node first.

Candidates are dealt over shards and queries over blocks, both of bounded size.
A task holds one shard and one block: it builds the shard's ball tree and takes
the nodes in the order of the largest inner product that they can hold for a
query, dropping a query from a node whose bound is below the query's k-th score
so far. Every block first searches one shard; the k-th scores found there go
with the block to all other shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a shard and queries of a block at most, on average.
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF = 64
_NONE = np.iinfo(np.int64).min


class BallTree:
    """Centres and radii over rows of integers; a leaf is a list of rows."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.points = rows.astype(np.float64)
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.parts: list[tuple[np.ndarray, tuple]] = []
        if len(rows):
            self._node(np.arange(len(rows)))

    def _node(self, members: np.ndarray) -> int:
        own = len(self.parts)
        points = self.points[members]
        centre = points.mean(0)
        away = ((points - centre) ** 2).sum(1)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(away.max())))
        self.parts.append((members, ()))
        if len(members) > LEAF and away.max() > 0:
            # Split between the row farthest from the centre and the row farthest from that.
            one = points[away.argmax()]
            two = points[((points - one) ** 2).sum(1).argmax()]
            order = np.argsort(points @ (two - one), kind="stable")
            half = len(members) // 2
            self.parts[own] = (members, (self._node(members[order[:half]]), self._node(members[order[half:]])))
        return own

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node can hold for each query, rounding errors included."""
        size = np.sqrt((queries**2).sum(1))[:, None]
        middle = queries @ np.array(self.centres).T
        bound = middle + size * np.array(self.radii)[None, :]
        return bound + 1e-9 * (np.abs(bound) + size * np.abs(self.points).max(initial=0)) + 1e-6


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows for each query, best first, ties to the smaller id.

    ``own`` is the id a query must not find, ``least`` a score known to be
    reached k times elsewhere. Missing places have the smallest integer as score.
    """
    found = np.full((len(queries), k), _NONE, np.int64)
    names = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
    if not len(queries) or not len(ids):
        return names, found
    floats = queries.astype(np.float64)
    exact = tree.points if np.abs(tree.points).max(initial=0) * np.abs(floats).max(initial=0) * max(1, queries.shape[1]) < 2**52 else None
    bounds = tree.bounds(floats)
    floor = least.copy()
    heap = [(-bounds[:, 0].max(), 0, np.arange(len(queries)))]
    while heap:
        _, node, active = heapq.heappop(heap)
        active = active[bounds[active, node] >= floor[active]]
        if not len(active):
            continue
        members, inner = tree.parts[node]
        for child in inner:
            heapq.heappush(heap, (-bounds[active, child].max(), child, active))
        if inner:
            continue
        scores = (floats[active] @ exact[members].T).astype(np.int64) if exact is not None else queries[active] @ tree.rows[members].T
        scores[own[active][:, None] == ids[members][None, :]] = _NONE
        some = (scores >= np.maximum(floor[active], _NONE + 1)[:, None]).any(1)
        active, scores = active[some], scores[some]
        if not len(active):
            continue
        scores = np.concatenate([found[active], scores], axis=1)
        labels = np.concatenate([names[active], np.broadcast_to(ids[members], (len(active), len(members)))], axis=1)
        labels = np.where(scores == _NONE, np.iinfo(np.int64).max, labels)
        order = np.lexsort((labels, -np.maximum(scores, _NONE + 1)), axis=1)[:, :k]
        found[active] = np.take_along_axis(scores, order, 1)
        names[active] = np.take_along_axis(labels, order, 1)
        floor[active] = np.maximum(floor[active], found[active][:, -1])
    return names, found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _search_groups(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, own = candidates.column("id").to_numpy(), queries.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        tree = BallTree(_matrix(candidates.column("vector"))[order])
        least = queries.column("least").to_numpy()
        names, scores = search(tree, ids[order], _matrix(queries.column("vector")), own, k, least)
        row, place = np.nonzero(scores != _NONE)
        columns = [own[row], queries.column("key").to_numpy()[row], names[row, place], scores[row, place]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component as a double; null where the vector or any component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k greatest inner products of each query, ties to the smaller id, rank from 1.

    A row is no candidate of a query with its own id. Rows without an id, and
    vectors that are null or hold null or non-finite components, take no part; a
    query meets vectors of its own length only. Equal query rows count once,
    equal candidate rows each. No queries or candidates give no rows.
    """
    whole = quantised(F.col(vector_column), scale)
    # Marked before anything else, so that it is computed once.
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), whole.alias("vector"), is_query.alias("asks"))
    rows = stored(rows.filter("id is not null and vector is not null").withColumn("key", F.xxhash64("vector")))
    asked = rows.filter("asks").select("id", "key", "vector").dropDuplicates(["id", "key"])
    sizes = rows.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    shards, blocks = max(1, -(-sizes[0] // shard_rows)), max(1, -(-(sizes[1] or 0) // block_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "key", F.lit(4)), F.lit(shards)).cast("int")).withColumn("width", F.size("vector"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "key", F.lit(5)), F.lit(blocks)).cast("int")).withColumn("width", F.size("vector"))
    asked = stored(asked.withColumn("seed", F.pmod("block", F.lit(shards))))
    on = ["width", "shard", "block"]

    def found(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        # Both sides come of one table: columns anew, so that each is known to be its own.
        left = candidates.select(*[F.col(c).alias(c) for c in (*on, "id", "vector")]).groupBy(*on)
        right = queries.select(*[F.col(c).alias(c) for c in (*on, "id", "key", "vector", "least")]).groupBy(*on)
        schema = "query_id long, query_key long, vec_id long, score long"
        return left.cogroup(right).applyInArrow(_search_groups(k), schema)

    pairs = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    seed = F.pmod("block", F.lit(shards))
    first = stored(found(pairs.filter(F.col("shard") == seed), asked.withColumn("shard", F.col("seed")).withColumn("least", F.lit(_NONE))))
    reached = first.groupBy("query_id", "query_key").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    # A k-th score is shared only where k were found.
    known = asked.join(reached, (asked["id"] == F.col("query_id")) & (asked["key"] == F.col("query_key")), "left")
    known = known.withColumn("least", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(_NONE))).select(*asked.columns, "least")
    elsewhere = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> seed")
    every = first.unionAll(found(pairs.filter(F.col("shard") != seed), elsewhere)) if shards > 1 else first
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
