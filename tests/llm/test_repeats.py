import random
from collections import Counter

import pytest
from cases import documents

from leaksieve.llm import repeats


def brute(rows, length):
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(text), sum(gone), runs, bytes(b for b, g in zip(text, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def text(rng, n, letters="abcdef "):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("most", [50_000, 2])
def test_whole_corpus_matches_brute_force(spark, most):
    rng = random.Random(most)
    shared, border = text(rng, 150), text(rng, 64)
    texts = [None, "", "short", "a" * 500, "é" * 130, "abc" * 100, shared, shared[:64], border, text(rng, 5000), "\0" * 70]
    texts += [text(rng, rng.randint(0, 90)) + shared + text(rng, rng.randint(0, 90)) for _ in range(12)]
    texts += [text(rng, 40) + border + text(rng, 40) for _ in range(5)]
    texts += [texts[9][100:400] + "ü" + texts[9][900:1000], texts[9][3000:3063]]
    texts += [text(rng, 200) * 2, text(rng, 300)] + [texts[-1]] * 2
    rows = list(enumerate(texts)) + [(3, "x"), (None, text(rng, 100)), (50, text(rng, 80))]
    rows += [rows[-1]]  # equal in id and text: a place each
    got = repeats.remove_repeats(documents(spark, rows), length=64, most=most).collect()
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got), key=repr) == brute([(i, (t or "").encode()) for i, t in rows], 64)


def test_empty_table_and_odd_lengths(spark):
    assert repeats.remove_repeats(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents(spark, []), length=40)


@pytest.mark.parametrize("length", [3, 20])
def test_transform_finds_every_repeated_window(length):
    rng = random.Random(length)
    for letters in ("ab", "abcdefgh"):
        for _ in range(40):
            base = text(rng, rng.randint(1, 300), letters).encode()
            pieces = [base[a : a + rng.randint(0, 200)] for a in (rng.randrange(len(base)) for _ in range(rng.randint(1, 6)))]
            count = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
            want = [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] for p in pieces]
            assert [[i for a, b in r for i in range(a, b + 1)] for r in repeats.repeated_windows(pieces, length)] == want
