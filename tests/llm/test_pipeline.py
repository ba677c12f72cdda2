import random

import corpus_pipeline
import pytest
from cases import SMALL, documents, prose
from test_jaccard import brute as components_of
from test_mixing import draw

from leaksieve.llm.common import read
from leaksieve.llm.quality import score_quality

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_and_their_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "mixing", "sharding"]
    docs = read(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
    assert STAGES["sharding"](spark, docs, SMALL).columns == [*docs.columns, "shard"]


def test_each_decision_takes_effect(spark):
    docs = read(spark, SMALL, "documents")
    scored = score_quality(docs, read(spark, SMALL, "labels"))
    good = {r["doc_id"] for r in scored.collect() if r["predicted"]}
    assert {r["doc_id"] for r in STAGES["quality classifier"](spark, docs, SMALL).collect()} == good

    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    roots = {i: root for i, _, root in components_of(texts, 5, 80)}
    alone = {r["doc_id"] for r in STAGES["near duplicates"](spark, docs, SMALL).collect()}
    assert alone == set(roots.values())

    items = [r["text"].lower() for r in read(spark, SMALL, "benchmark").collect()]
    kept = STAGES["decontamination"](spark, docs, SMALL).collect()
    assert 0 < len(kept) < len(texts)
    assert not any(item in r["text"].lower() for r in kept for item in items)


def test_run_is_the_stages_in_turn(spark):
    docs = read(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("stage", list(STAGES))
def test_awkward_rows_pass_every_stage(spark, stage):
    rng = random.Random(1)
    rows = [(None, None), (None, "text"), (1, None), (2, ""), (3, "same words here now"), (3, "same words here now"), (4, prose(rng, 20_000))]
    docs = documents(spark, rows)
    got = STAGES[stage](spark, docs, SMALL)
    assert {r["doc_id"] for r in got.collect()} <= {r[0] for r in rows}
    assert STAGES[stage](spark, docs.limit(0), SMALL).collect() == []


def test_draws_are_those_of_the_id():
    assert [draw(i, 1.0) for i in range(5)] == [draw(i, 1.0) for i in range(5)]
    assert 900 < sum(draw(i, 1.0) for i in range(1000)) < 1100
    assert 29_000 < sum(draw(i, 30.0) for i in range(1000)) < 31_000
