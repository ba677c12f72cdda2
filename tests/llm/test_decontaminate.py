import random
from collections import Counter

import pytest
from cases import documents, prose, words

from leaksieve.llm import decontaminate as dc


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, items):
    """Every window of every document against every item."""
    out = {}
    for doc, text in rows:
        w = words(text)
        for item, wanted in items:
            v = words(wanted)
            k = min(5, len(v))
            best = None
            for i in range(len(w) - len(v) + 1) if v else ():
                a, b = bag(w[i : i + len(v)], k), bag(v, k)
                score = (a & b).total() / (a | b).total()
                if score >= 0.8 and (best is None or score > best[0]):
                    best = (score, i)
            if best:
                out.setdefault((doc, item), []).append(best)
    return sorted(((d, i, s, at) for (d, i), v in out.items() for s, at in v), key=repr)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def setting():
    rng = random.Random(8)
    items = [(n, prose(rng, size)) for n, size in enumerate([60, 60, 60, 41, 25, 9, 5, 3, 2, 1])]
    items += [(20, items[0][1]), (21, ""), (22, None), (23, " \n"), (24, "a b a b a b a b a b a b"), (25, items[3][1].upper())]
    rows = [(100, None), (101, ""), (102, items[4][1]), (103, prose(rng, 8000)), (104, items[7][1] + " tail")]
    for n in range(40):
        item = rng.choice(items[:6])[1]
        kept = edited(rng, item, rng.choice([0, 0, 1, 2, 6]))
        rows.append((n, f"{prose(rng, rng.randint(0, 30))} {kept} {prose(rng, rng.randint(0, 30))}"))
    rows += [(60, "x " + items[1][1] + " y " + items[1][1]), (61, "b a b a b a b a b a b a b a")]
    rows += [(70, " ".join(items[0][1].split()[:20]) + " " + prose(rng, 40))]  # quotes a part
    return rows, items


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_links_match_brute_force(spark, pass_bytes):
    rows, items = setting()
    rows += [rows[5]]  # a repeated row repeats its links
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = dc.contaminated(documents(spark, rows), benchmark, pass_bytes=pass_bytes)
    assert got.dtypes == [("doc_id", "bigint"), ("item_id", "bigint"), ("similarity", "double"), ("first_word", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, items)


def test_clean_rows_stay_whole(spark):
    rows, items = setting()
    rows += [(None, "clean text"), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    kept = dc.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    bad = {d for d, *_ in brute(rows, items) if d is not None}
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(d) for d, t in rows if d not in bad and t != items[0][1])


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = documents(spark, [(1, "a b c")])
    assert dc.contaminated(docs.limit(0), benchmark).collect() == []
    assert dc.contaminated(docs, benchmark.limit(0)).collect() == []
    assert dc.decontaminate(docs, benchmark.limit(0)).count() == 1


def test_index_finds_all_within_the_radius():
    rng = random.Random(3)
    rows, items = setting()
    index = dc.BenchmarkIndex([i for i in items if i[1]])
    for size in index.sizes.values():
        for n, own in enumerate(size.prints):
            flipped = own.copy()
            for bit in rng.sample(range(64), dc.RADIUS):
                flipped[bit // 8] ^= 1 << bit % 8
            assert any(size.near[b][flipped[b], n] for b in range(dc.BLOCKS))


def brute_whole(rows, items):
    """As ``brute``, and a text shorter than the item is one window."""
    out = brute(rows, items)
    for doc, text in rows:
        w = words(text)
        for item, wanted in items:
            v = words(wanted)
            if 0 < len(w) < len(v):
                a, b = bag(w, min(5, len(v))), bag(v, min(5, len(v)))
                score = (a & b).total() / (a | b).total()
                if score >= 0.8:
                    out.append((doc, item, score, 0))
    return sorted(out, key=repr)


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(11)
    items = [(n, prose(rng, size)) for n, size in enumerate([59, 38, 38, 25, 12, 10, 6, 5, 2])]
    items += [(20 + n, prose(rng, 9)) for n in range(60)] + [(90, "a b a b a b a b a b a b a b"), (91, items[1][1])]
    texts = []
    for _, text in items:
        w = text.split()
        for n in (1, 2, 5, 12):
            texts += [" ".join(w[n:]), " ".join(w[:-n]), " ".join(w[n // 2 : len(w) - (n - n // 2)])]
        texts.append(" ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :]))
    rows = [(n, t) for n, t in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_whole(rows, items)
    assert len(want) - len(brute(rows, items)) > 100
    assert sorted(map(tuple, dc.contaminated(documents(spark, rows), benchmark).collect()), key=repr) == want
    bad = {d for d, *_ in want}
    assert sorted(r["doc_id"] for r in dc.decontaminate(documents(spark, rows), benchmark).collect()) == [d for d, _ in rows if d not in bad]
