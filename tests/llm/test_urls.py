import math
import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import common, urls
from leaksieve.llm.queries import URL_RULES

CASES = [
    (None, "", "", None),
    ("", "", "", None),
    ("no scheme/org/", "", "", None),
    ("http://Example.ORG/es/a?b#c", "example.org", "/es/a", "example.org/es/"),
    ("http://www.example.org/es", "www.example.org", "/es", "org/"),
    ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1"),
    ("http://xexample.org/en/12", "xexample.org", "/en/12", "org/"),
    ("http://org/x", "org", "/x", "org/"),
    ("http://org", "org", "", None),
    ("http://org?x=/", "org", "", None),
    ("ftp://é.com/de/ü#/fr/", "é.com", "/de/ü", "com/de/"),
    ("x://com/fr/\n1", "com", "/fr/\n1", "com/fr/"),
    ("a://b.net/://c.org/", "b.net", "/://c.org/", None),
    ("://", "", "", None),
    ("http://e.org:80/x", "e.org:80", "/x", None),
    ("http://ÀB.Org/" + "x" * 50_000, "Àb.org", "/" + "x" * 50_000, "org/"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, u, "h", "p", "r", "s") for i, u in rows], "page_id long, url string, host string, path string, rule string, score string")


def test_rules_and_parts(spark):
    rows = [(n, u) for n, (u, *_) in enumerate(CASES)] + [(None, CASES[3][0]), (3, CASES[3][0])]
    got = urls.judge_urls(table(spark, rows), URL_RULES).collect()
    kinds = {text: kind for kind, text in URL_RULES}
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule = CASES[3 if r["page_id"] is None else r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == kinds.get(rule, r["verdict"])
        assert r["verdict"] in ("allow", "block")


def test_method_tells_kinds_apart(spark):
    good = [f"https://news{i}.example.com/story/{i * 37}" for i in range(120)]
    bad = [f"http://casino-win{i}.example.com/bonus/?{i * 37}" for i in range(120)]
    rules = [("allow", f"news{i}.example.com/") for i in range(0, 120, 2)] + [("block", f"casino-win{i}.example.com/") for i in range(0, 120, 2)]
    rows = urls.judge_urls(table(spark, list(enumerate(good + bad))), rules).collect()
    judged = [r for r in rows if r["rule"] is None]
    right = sum((r["verdict"] == "allow") == (r["page_id"] < 120) for r in judged)
    assert len(judged) == 120
    assert right >= 114


def test_no_rules_and_no_rows(spark):
    assert {r["verdict"] for r in urls.judge_urls(table(spark, [(1, "http://a/"), (2, None)]), []).collect()} == {"allow"}
    assert urls.judge_urls(table(spark, []), URL_RULES).collect() == []


def test_counts_are_those_of_a_plain_count(spark):
    rows = [("ab", 1), ("ab", 1), ("b", 0), (None, 0), ("", 1)]
    frame = spark.createDataFrame(rows, "url string, kind int").select(F.coalesce("url", F.lit("")).cast("binary").alias("url"), "kind")
    cells = frame.repartition(3).mapInArrow(urls._count_rows, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    tables = np.zeros(4 * urls.ORDER * urls.CELLS)
    tables[[r["cell"] for r in cells]] = [r["n"] for r in cells]
    tables = tables.reshape(2, 2, urls.ORDER, urls.CELLS)
    # Every byte and the end of each URL count once in every order.
    assert (tables[1].sum(2) == 3 + 3 + 1).all()
    assert (tables[0].sum(2) == 2 + 1).all()


def test_chances_add_up():
    rng = np.random.default_rng(1)
    words = pa.array(["".join(rng.choice(list("abc/."), 12)) for _ in range(50)], pa.string())
    full, before, _ = urls._with_contexts(words)
    counts, contexts = np.zeros((2, urls.ORDER, urls.CELLS)), np.zeros((2, urls.ORDER, urls.CELLS))
    for order in range(urls.ORDER):
        np.add.at(counts[1, order], full[order], 1)
        np.add.at(contexts[1, order], before[order], 1)
    model = urls.UrlModel(counts, contexts)
    seen = model.scores(words)
    other = model.scores(pa.array(["QQQQQQQQQQQQ", ""], pa.string()))
    assert seen.min() > other[0]
    assert np.isfinite(other).all()


def plain_scores(rows):
    """Scores and cut's chains by the book: dictionaries of all n-grams and contexts over all labelled URLs."""
    grams, contexts = Counter(), Counter()

    def places(url):
        text = [-1] * urls.ORDER + list((url or "").encode()) + [256]
        return [[tuple(text[i - order : i + 1]) for order in range(urls.ORDER)] for i in range(urls.ORDER, len(text))]

    for url, kind in rows:
        for gram in (g for place in places(url) for g in place if kind is not None):
            grams[kind, gram] += 1
            contexts[kind, len(gram), gram[:-1]] += 1
    out = []
    for url, _ in rows:
        total = 0.0
        for place in places(url):
            chances = []
            for kind in (0, 1):
                chance = 1 / 257
                for gram in place:
                    chance = (grams[kind, gram] + urls.BLEND * chance) / (contexts[kind, len(gram), gram[:-1]] + urls.BLEND)
                assert 0 < chance < 1
                chances.append(chance)
            total += math.log(chances[1]) - math.log(chances[0])
        out.append(total / len(places(url)))
    return out


@pytest.mark.parametrize("broadcast", [common.BROADCAST_ROWS, 0])
def test_scores_are_those_of_exact_counts(spark, monkeypatch, broadcast):
    # More distinct n-grams of five than the sketch has counters.
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits
    texts = [f"http://{rng.choice(['a', 'b', 'c'])}.net/{''.join(rng.choices(letters, k=30))}" for _ in range(5000)]
    texts += [None, "", "é", texts[0], "http://a.net/" + "x" * 3000]
    got = urls.judge_urls(table(spark, list(enumerate(texts))), [("allow", "a.net/"), ("block", "b.net/")]).collect()
    kinds = [None if not t or "://" not in t else {"a": 1, "b": 0}.get(t[7]) for t in texts]
    assert len({t[i : i + 5] for t in texts if t for i in range(len(t) - 4)}) > urls.CELLS
    want = plain_scores(list(zip(texts, kinds, strict=True)))
    assert len(got) == len(texts)
    assert max(abs(r["score"] - want[r["page_id"]]) for r in got) < 1e-9
