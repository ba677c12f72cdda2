import zlib

from cases import SMALL, documents

from leaksieve.llm.common import read
from leaksieve.llm.sharding import assign_shards, shard_plan

TEXTS = [(1, "é"), (2, None), (3, ""), (4, "x" * 100_000), (5, "same"), (6, "same"), (6, "same"), (6, "other"), (None, "n"), (None, "n")]


def test_plan_of_awkward_rows(spark):
    rows = shard_plan(documents(spark, TEXTS), buckets=3).collect()
    assert rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS if i)
    assert sorted((r[0], r[1], r[2]) for r in rows if r[0]) == want
    assert len(rows) == len(TEXTS)
    assert len({(r["shard"], r["grown_shard"]) for r in rows if r["doc_id"] == 6}) == 1
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert shard_plan(documents(spark, [])).collect() == []


def test_a_further_shard_only_takes(spark):
    rows = shard_plan(read(spark, SMALL, "documents")).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert 0 < sum(r["grown_shard"] == 8 for r in rows) < len(rows) / 4
    assert {r["shard"] for r in rows} == set(range(8))


def test_weights_share_out(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    shares = {r["shard"]: r["count"] for r in assign_shards(docs, (1.0, 3.0)).groupBy("shard").count().collect()}
    assert 900 < shares[0] < 1100
    assert shares[0] + shares[1] == 4000


def test_assigning_keeps_columns(spark):
    docs = documents(spark, TEXTS)
    assert assign_shards(docs, (1.0,) * 8).columns == [*docs.columns, "shard"]
    assert "Exchange" not in assign_shards(docs, (1.0,) * 8)._jdf.queryExecution().toString()
