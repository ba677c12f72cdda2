import hashlib
import math
from collections import Counter

import pytest
from cases import SMALL, documents
from pyspark.sql import functions as F

from leaksieve.llm import mixing
from leaksieve.llm.common import read


def draw(key, rate):
    pieces = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
    n = 0
    for i in range(1, pieces + 1):
        u = (int(hashlib.md5(f"{'' if key is None else key}:{i}:2".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, term = 0, math.exp(-rate / pieces)
        total = term
        while total < u:
            k += 1
            term *= rate / pieces / k
            total += term
        n += k
    return n


@pytest.mark.parametrize(("weights", "max_sources"), [(None, 100), ({"src0": 1.0, "src3": 40.0}, 100), (None, 0)])
def test_draws_match_the_distribution(spark, weights, max_sources):
    docs = read(spark, SMALL, "documents")
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"].encode())
    weight = {s: math.sqrt(b) if weights is None else weights.get(s, 0) for s, b in size.items()}
    total, every = sum(weight.values()), sum(size.values())
    want = Counter({r["doc_id"]: draw(r["doc_id"], weight[r["source"]] / total * every / size[r["source"]]) for r in rows})
    got = mixing.mix_sources(docs, weights, max_sources=max_sources)
    assert got.columns == [*docs.columns, "copy"]
    seen = got.collect()
    assert Counter(r["doc_id"] for r in seen) == +want
    assert {(r["doc_id"], r["copy"]) for r in seen} == {(d, c) for d, n in want.items() for c in range(n)}
    if weights:
        assert max(want.values()) > 16  # a mean beyond one table


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "text"), (3, "text"), (3, "text"), (4, "x" * 200_000)]
    docs = documents(spark, rows)
    assert mixing.mix_sources(docs, copy_column=None).columns == docs.columns
    got = mixing.mix_sources(docs, copy_column="size").collect()
    assert set(got[0].asDict()) == set(docs.columns)
    counts = Counter(r["doc_id"] for r in got)
    assert counts[3] % 2 == 0
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert mixing.mix_sources(docs, {}).collect() == []


def test_rows_without_an_id_are_drawn_apart(spark):
    docs = documents(spark, [(None, f"text number {n:04d}") for n in range(2000)]).withColumn("source", F.lit("a"))
    got = mixing.mix_sources(docs).collect()
    assert 1800 < len(got) < 2200
    assert 1150 < len({r["text"] for r in got}) < 1380


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_sources(read(spark, SMALL, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
