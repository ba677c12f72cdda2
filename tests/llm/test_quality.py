import zlib

from cases import SMALL, documents

from leaksieve.llm import quality
from leaksieve.llm.common import read

MIDDLE = "/root/testdata/sf0.01"


def held_out(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    rows = quality.score_quality(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    tested = sorted((r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"])
    good = sum(y for _, y in tested)
    ranks = sum(n + 1 for n, (_, y) in enumerate(tested) if y)
    assert (ranks - good * (good + 1) / 2) / (good * (len(tested) - good)) > 0.98
    kept = [y for x, y in tested if x >= 0.3]
    assert sum(kept) >= 0.99 * good
    assert len(kept) - sum(kept) < 0.25 * (len(tested) - good)


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = read(spark, MIDDLE, "documents"), read(spark, MIDDLE, "labels")
    model = quality.fit_quality(docs, labels)
    again = quality.fit_quality(docs.repartition(7, "text"), labels.repartition(3))
    assert model == again
    flipped = labels.withColumn("quality", (1 - labels["quality"]))
    blind = quality.fit_quality(docs, labels.unionAll(flipped.filter(~quality.learnable())))
    assert model == blind  # labels of held-out rows are not looked at


def test_awkward_rows(spark):
    labels = read(spark, SMALL, "labels")
    rows = [(1, None), (2, ""), (None, "x"), (None, None), (3, "same"), (3, "same"), (4, "word " * 60_000), (5, "| " * 500)]
    docs = documents(spark, rows)
    model = quality.fit_quality(read(spark, SMALL, "documents"), labels)
    got = docs.select("doc_id", quality.quality_score(model, docs["text"], spark).alias("s")).collect()
    assert len(got) == len(rows)
    assert got[0]["s"] == got[1]["s"] == got[3]["s"]
    assert all(0 <= r["s"] <= 1 for r in got)


def test_without_labels(spark):
    docs = documents(spark, [(1, "x"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, labels).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert all(r["score"] >= 0.5 for r in quality.score_quality(docs, one).collect())
    assert quality.score_quality(docs.limit(0), labels).collect() == []


def test_whole_texts_count():
    model = quality.QualityModel(b"good words " * 50, b"||| junk ||| " * 50, (0.0, 5.0, 0.0, 0.0))
    long = b"good words " * 4000
    plain, spoiled = model.features(*quality.joined([long, long + b"||| junk ||| " * 4000]))
    assert spoiled[1] < plain[1]
