import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import topk


def brute(rows, k):
    rows = [(i, [floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)): (i, v) for i, v in rows if i % 5 == 0}.values():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(8192, 2048), (40, 9), (3, 4)])
def test_matches_brute_force(spark, shard_rows, block_rows):
    rng = random.Random(shard_rows)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (305, [float("nan")] * 6), (310, [float("inf")] * 6), (None, rows[0][1])]
    rows += [(315, [1.0, 2.0]), (316, [0.5, 0.25]), (320, []), (325, []), (330, [1.0, 2.0, 3.0]), (10, rows[10][1]), (11, rows[11][1])]
    table = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, id string, vector string")
    got = topk.top_inner_products(table, F.col("vec_id") % 5 == 0, shard_rows=shard_rows, block_rows=block_rows)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_empty_and_no_queries(spark):
    table = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_inner_products(table.limit(0), F.lit(True)).collect() == []
    assert topk.top_inner_products(table, F.lit(False)).collect() == []
    assert topk.top_inner_products(table, F.lit(True)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-20, 20, (500, 8)) + 300 * np.eye(8, dtype=np.int64)[i] for i in range(8)])
    tree = topk.BallTree(rows)
    queries = (300 * np.eye(8)[rng.integers(8, size=20)] + rng.integers(-20, 20, (20, 8))).astype(float)
    bounds = tree.bounds(queries)
    for node, (members, _) in enumerate(tree.parts):
        assert (queries @ rows[members].T <= bounds[:, node][:, None]).all()
    best = np.sort(queries @ rows.T, axis=1)[:, -5]
    leaves = [n for n, (_, inner) in enumerate(tree.parts) if not inner]
    assert (bounds[:, leaves] >= best[:, None]).mean() < 0.5
