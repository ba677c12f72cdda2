import random
from collections import defaultdict

import numpy as np
import pytest
from cases import documents, prose, words

from leaksieve.llm import jaccard
from leaksieve.llm.components import components


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots_of(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = []
    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((i, j))
    roots = roots_of({i for i, _ in sets if i is not None}, links)
    return sorted(((i, len(x), roots.get(i) if x else i) for i, x in sets), key=repr)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block_rows", [2000, 7])
def test_components_match_brute_force(spark, block_rows):
    rng = random.Random(block_rows)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "two  words\n", "a b c d", "A b c d e", prose(rng, 3000)]
    for _ in range(4):
        base = prose(rng, rng.choice([12, 40, 150]))
        texts += near_copies(rng, base, 15, 4)
        texts += [base, base.upper(), f"{base} {prose(rng, 5)}", f"{prose(rng, 3)} {base}"]
    texts += [texts[-1]] * 3 + [texts[9] + " end"]
    rows = [(n * 7 % 1009, t) for n, t in enumerate(texts)] + [(None, texts[20]), (None, None)]
    got = jaccard.shingle_components(documents(spark, rows), k=4, percent=85, block_rows=block_rows).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85)


def test_links_at_the_limit_count(spark):
    letters = [f"w{i}" for i in range(400)]
    base = letters[:103]  # 100 shingles of four words
    rows = [(1, " ".join(base)), (2, " ".join(base[:88])), (3, " ".join([*letters[200:280], *base[:3]]))]
    rows += [(4, " ".join(letters[300:323])), (5, " ".join(letters[300:320]))]  # 20 and 17 shingles: 85 of 100
    got = {r[0]: r[2] for r in jaccard.shingle_components(documents(spark, rows), k=4, percent=85).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_empty_table(spark):
    assert jaccard.shingle_components(documents(spark, [])).collect() == []
    assert jaccard.keep_one(documents(spark, [])).collect() == []


def test_one_of_each_group_stays_with_its_columns(spark):
    rng = random.Random(3)
    base = prose(rng, 80)
    rows = [(5, base), (4, base + " more"), (9, prose(rng, 60)), (9, prose(rng, 60)), (7, "x"), (7, "x"), (None, base), (8, None), (6, "")]
    kept = jaccard.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == [-1, 4, 6, 7, 8, 9, 9]


def test_a_tree_passes_over_what_is_joined(monkeypatch):
    rng = np.random.default_rng(1)
    base = np.sort(rng.choice(1 << 40, 200, replace=False)).astype(np.uint64)
    sets = [np.sort(np.concatenate([np.delete(base, rng.integers(200, size=3)), rng.integers(1 << 41, 1 << 42, 3).astype(np.uint64)])) for _ in range(600)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    looked = []
    overlaps = jaccard.SignatureTree.overlaps
    monkeypatch.setattr(jaccard.SignatureTree, "overlaps", lambda self, a, b: looked.append(len(a) * len(b)) or overlaps(self, a, b))
    links = jaccard.block_links(np.concatenate(sets), first, 85, np.arange(600))
    assert len(links) == 599
    assert sum(looked) < 600 * 600 / 4


def test_folded_bitmaps_are_verified(monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_BITS", 64)
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(1 << 40, size=60).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[:-5], rng.integers(1 << 41, 1 << 42, 5).astype(np.uint64)])), np.unique(base[: rng.integers(40, 60)])]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = jaccard.block_links(np.concatenate(sets), first, 80, np.arange(len(sets)))
    true = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert roots_of(range(len(sets)), got) == roots_of(range(len(sets)), true)


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_of_links(spark, shape):
    rng = random.Random(4)
    if shape == "path":
        names = rng.sample(range(1000), 40)
        links = list(zip(names[:-1], names[1:], strict=True))
    elif shape == "star":
        links = [(500, x) for x in range(60)]
    else:
        links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    nodes = {x for link in links for x in link if link[0] != link[1]}
    frame = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(frame).collect()))
    assert got == {k: v for k, v in roots_of(nodes, links).items() if k in nodes}


def test_classes_count_links_by_group(spark):
    groups = defaultdict(list)
    for doc, _, root in jaccard.shingle_components(documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "z")])).collect():
        groups[root].append(doc)
    assert dict(groups) == {1: [1, 2], 3: [3]}


@pytest.mark.parametrize("block_rows", [2000, 7])
def test_all_links_match_brute_force(spark, block_rows):
    rng = random.Random(block_rows)
    texts = [None, "", "one", "ONE", "a b c d", prose(rng, 2000)]
    for size in (12, 40, 150):
        base = prose(rng, size)
        texts += [*near_copies(rng, base, 25, 3), base, base.upper(), f"{base} {prose(rng, 5)}"]
    rows = [(n // 2 if n < 4 else n, t) for n, t in enumerate(texts)] + [(None, texts[8]), (9, texts[9]), (9, texts[60])]
    sets = {(i, s) for i, t in rows if i is not None and (s := shingles(t, 5))}
    want = {frozenset((x, y)) for _, x in sets for _, y in sets if x != y and 100 * len(x & y) >= 80 * len(x | y)}
    links, members = jaccard.shingle_links(documents(spark, rows), block_rows=block_rows)
    pairs, members = [tuple(r) for r in links.collect()], members.collect()
    assert len(members) == len(rows)
    assert {r["class"] for r in members if r["doc_id"] is None or not r["n_shingles"]} == {None}
    # Each class is one set: by their ids and sizes they stand for the same.
    known = defaultdict(set)
    for r in members:
        known[r["class"]].add((r["doc_id"], r["n_shingles"]))
    named = defaultdict(set)
    for i, s in sets:
        named[s].add((i, len(s)))
    got = sorted(sorted(map(repr, (sorted(known[a]), sorted(known[b])))) for a, b in pairs)
    # A spanning forest has fewer links than classes.
    assert len(want) > len(named)
    assert all(a < b for a, b in pairs)
    assert got == sorted(sorted(repr(sorted(named[s])) for s in pair) for pair in want)


def test_large_keys_are_tied_without_a_task_that_holds_them(spark, monkeypatch):
    rng = random.Random(8)
    texts = [t for size in (20, 60) for t in near_copies(rng, prose(rng, size), 30, 2)] + [prose(rng, 30)] * 3
    rows = documents(spark, list(enumerate(texts)))
    want = sorted(map(tuple, jaccard.shingle_components(rows).collect()))
    monkeypatch.setattr(jaccard, "MOST", 5)
    assert sorted(map(tuple, jaccard.shingle_components(rows).collect())) == want


def test_large_sets_that_share_a_passage_do_not_meet(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))
    texts = [" ".join([passage, *(f"w{rng.randrange(10**9)}" for _ in range(6000))]) for _ in range(30)]
    texts += [f"{texts[0]} end", f"{passage} {texts[1]}"]
    met, block_pass = [], jaccard._block_pass
    monkeypatch.setattr(jaccard, "_block_pass", lambda rows, *rest: met.append(rows.count()) or block_pass(rows, *rest))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.shingle_components(documents(spark, list(enumerate(texts))), block_rows=4).collect()}
    assert got == {i: {30: 0, 31: 1}.get(i, i) for i in range(32)}
    assert met == [4]


def test_linked_sets_share_a_key_and_chance_hardly_gives_any():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        for size in (1, 2, 3, 5, 9, 20, 57, 200, 900, 4000):
            sets = []
            for _ in range(30):
                base = rng.integers(1 << 60, size=size).astype(np.uint64)
                larger = np.concatenate([base, rng.integers(1 << 60, 1 << 61, size * 100 // percent - size).astype(np.uint64)])
                out = next(d for d in range(size, -1, -1) if 100 * (size - d) >= percent * (size + d))
                swapped = np.concatenate([base[out:], rng.integers(1 << 60, 1 << 61, out).astype(np.uint64)])
                sets += [np.unique(base), np.unique(larger), np.unique(swapped)]
            first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            keys, rows = jaccard.part_keys(np.concatenate(sets), first, percent)
            of = [set(keys[rows == i].tolist()) for i in range(len(sets))]
            assert all(of[i] & of[i + 1] and of[i] & of[i + 2] for i in range(0, len(sets), 3)), (percent, size)
    shared = rng.integers(1 << 60, size=400).astype(np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(1 << 60, size=6000).astype(np.uint64)])) for _ in range(30)]
    keys, rows = jaccard.part_keys(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 80)
    assert len(keys) - len(np.unique(keys)) < 150


def test_folded_signatures_are_those_of_fewer_buckets(monkeypatch):
    rng = np.random.default_rng(6)
    values, first = rng.integers(1 << 60, size=9100).astype(np.uint64), np.array([0, 9000, 9000, 9100])
    halves, places = jaccard.bucket_counts(values, first)
    got = jaccard.folded(halves, places, np.arange(3), 64)
    monkeypatch.setattr(jaccard, "MOST_BUCKETS", 64)
    halves, places = jaccard.bucket_counts(values, first)
    assert np.array_equal(got, jaccard.folded(halves, places, np.arange(3), 64))
    assert np.diff(places).tolist() == [32, 32, 32] and got[2].sum() == 100


def test_a_key_of_large_sets_is_folded_to_its_bound(spark, monkeypatch):
    rng = random.Random(10)
    base = prose(rng, 3000)
    rows = documents(spark, list(enumerate([*near_copies(rng, base, 30, 40), *near_copies(rng, prose(rng, 60), 30, 2)])))
    want = sorted(map(tuple, jaccard.shingle_components(rows).collect()))
    monkeypatch.setattr(jaccard, "KEY_COUNTS", 1 << 10)
    monkeypatch.setattr(jaccard, "STEP_COUNTS", 100)
    assert sorted(map(tuple, jaccard.shingle_components(rows).collect())) == want
