import hashlib
import random

import numpy as np
import pytest

from leaksieve.llm import scans, trie
from leaksieve.llm.trie import ends_digests, list_positions, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth long, at long, pos string"


def brute(rows):
    """Nodes (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of Python rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), mark(role, text), role or "", text or ""))
    paths = {c: [t[4:] for t in sorted(turns)] for c, turns in convs.items()}
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    out = []
    for node, ours in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = sorted(c for c in ours if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else None
        out.append((min(ours), len(node), parent, len(ours), len(kids), leaves, saved, digest))
    return sorted(out, key=repr)


def mark(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def nodes(spark, rows):
    found = prefix_trie(spark.createDataFrame([(*r, 1, 2, "z") for r in rows], TURNS))
    whole = found.nodes.join(ends_digests(found), ["depth", "x1", "x2"], "left")
    return sorted(map(tuple, whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha256").collect()), key=repr)


def some_rows(rng, conversations):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv * 7 - 20, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None, "assistant"]), rng.choice(["", "a", "a", "bé", "b", None, "long 🙂 text"])))
    return rows


@pytest.mark.parametrize("piece_rows, arcs, siblings", [(250_000, 250_000, 10_000), (6, 12, 15)])
def test_equals_brute_force(spark, monkeypatch, piece_rows, arcs, siblings):
    monkeypatch.setattr(scans, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(trie, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(trie, "ARCS", arcs)
    monkeypatch.setattr(trie, "SIBLINGS", siblings)
    monkeypatch.setattr(scans, "HOT_ROWS", 3 if piece_rows == 6 else 50_000)
    rows = some_rows(random.Random(piece_rows), 40)
    # Repeated rows, a long conversation, one that is the beginning of others, and a row without id.
    rows += [(1000, 0, "user", "same")] * 5 + [(1001, 0, "user", "same")] * 3 + [(None, 0, "user", "x")]
    rows += [(2000, t, "user", f"t{t}") for t in range(60)] + [(2001, t, "user", f"t{t}") for t in range(40)]
    assert nodes(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("most", [10, 1000])
def test_positions_of_a_shuffled_list(spark, most):
    """Names without any order, which ranges can't shorten: the doubling takes over."""
    rng = np.random.default_rng(most)
    names = [(int(c), int(a)) for c, a in zip(rng.permutation(150), rng.integers(0, 5, 150))]
    weights = rng.integers(1, 9, 150)
    rows = [(*n, *(names[i + 1] if i < 149 else (None, None)), int(w)) for i, (n, w) in enumerate(zip(names, weights))]
    arcs = spark.createDataFrame(rows, "conv long, at long, nconv long, nat long, weight long").checkpoint()
    got = {(r["conv"], r["at"]): r["pos"] for r in list_positions(arcs, most).collect()}
    starts = np.concatenate([[0], np.cumsum(weights)[:-1]]).tolist()
    assert got == dict(zip(names, starts))
