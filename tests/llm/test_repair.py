import hashlib
import random
import re
from itertools import groupby

import pytest
from cases import prose

from leaksieve.llm import repair, scans
from leaksieve.llm.repair import Rules, plain_rows, re_pair, repair_plans, repaired_digests, repaired_rows

TURNS = "conv_id long, turn long, role string, text string, audit string, kind string, cost long"
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(letters):
    """Cost and edits by plain dynamic programming over whole strings."""

    def with_inserts(best):
        out = dict(best)
        for _ in range(3):
            for i, (cost, edits) in list(out.items()):
                for r in "ua":
                    if i in NEXT[r]:
                        out[NEXT[r][i]] = min(out.get(NEXT[r][i], (1e9, "")), (cost + 5, edits + "I"))
        return out

    best = {0: (0, "")}
    for letter in letters:
        new = {}
        for i, (cost, edits) in with_inserts(best).items():
            ways = [(i, 2, "D")]
            if letter != "x":
                extra = 5 if letter.isupper() else 0
                kept = NEXT.get(letter.lower(), {})
                ways += [(kept[i], extra, "K")] if i in kept else []
                ways += [(NEXT[r][i], extra + 1, "R") for r in "ua" if i in NEXT[r]]
            for j, more, edit in ways:
                new[j] = min(new.get(j, (1e9, "")), (cost + more, edits + edit))
        best = new
    ends = with_inserts(best)
    return min(ends[e] for e in (0, 3) if e in ends)


def brute(rows):
    """Per conversation, from Python rows (conv_id, turn, role, text) in any order."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, group in groupby(sorted(rows, key=key), key=key):
        group = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in group]
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, letters, faults = set(), "", []
        for _, _, role, text in group:
            solid = re.sub("[\\x20\\x09-\\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        cost, audit = cheapest(letters)
        turns = [t for _, t, _, _ in group if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        state, at, left = 0, 0, []
        for edit in audit:
            role = "assistant" if state == 2 else "user"
            if edit != "I":
                row, at = group[at], at + 1
                if edit == "D":
                    continue
                role = row[2] if edit == "K" else role
            left.append((role, "" if edit == "I" else row[3], edit))
            state = NEXT[role[0]][state]
        out[group[0][0]] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, left)
    return out


def check(spark, rows):
    frame = plain_rows(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], TURNS))
    plans = repair_plans(frame)
    want = brute(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in plans.collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    found = {}
    for r in repaired_rows(frame, plans).orderBy("conv_id", "place").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    assert found == {c: w[-1] for c, w in want.items() if w[-1]}
    digests = {r["conv_id"]: r["sha256"] for r in repaired_digests(frame, plans).collect()}
    assert digests == {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in w[-1]).encode()).hexdigest() for c, w in want.items()}


def random_rows(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        turn = rng.choice([0, 1, -3])
        for _ in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = rng.choice(["", " \t\n", None, "Same text.", "No end", "A word! \n", prose(rng, 3) + ".", prose(rng, 2), "é?"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
            turn += rng.choice([0, 1, 1, 1, 2])
    return rows


def test_edits_equal_brute_force(monkeypatch):
    rng = random.Random(2)
    sequences = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    sequences += ["ua" * 300, "".join(rng.choice("uauaUAx") for _ in range(700)), "o" * 500, "x" * 500, "uU" * 200]
    want = [cheapest(s) for s in sequences]
    assert Rules().edits(sequences) == want
    for name, value in (("STRETCH", 7), ("GRAMMAR_LETTERS", 50), ("MOST_RULES", 60), ("LEAF_EDITS", 3)):
        monkeypatch.setattr(repair, name, value)
    assert Rules().edits(sequences) == want


def test_rules_spell_the_sequences():
    rng = random.Random(5)
    sequences = [[rng.randrange(3) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[1] * 33]
    rules, numbers = {}, {}

    def rule(a, b):
        number = numbers.setdefault((a, b), 100 + len(numbers))
        rules[number] = (a, b)
        return number

    def spelled(symbol):
        return [symbol] if symbol < 100 else [x for part in rules[symbol] for x in spelled(part)]

    made = re_pair(sequences, rule)
    assert [[x for s in m for x in spelled(s)] for m in made] == sequences
    pairs = [p for m in made for p in zip(m, m[1:])]
    assert sum(map(len, made)) < sum(map(len, sequences)) / 2
    assert all(pairs.count(p) == 1 or p[0] == p[1] for p in set(pairs))


def test_long_sequences_take_linear_time():
    rng = random.Random(7)
    sequence = "".join(rng.choice("uauaSUAOx") for _ in range(30_000))
    assert Rules().edits([sequence]) == [cheapest(sequence)]


@pytest.mark.parametrize("piece_rows", [5, 250_000])
def test_conversations_equal_brute_force(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(scans, "PIECE_ROWS", piece_rows)
    rng = random.Random(piece_rows)
    rows = random_rows(rng, 25, 9) + [(None, t, "user", "Null id.") for t in (1, 2)] + [(77, 1, "user", "Again.")] * 12
    rows += [(99, t, ("user", "assistant")[t % 2], f"Long {t}.") for t in range(120)]
    check(spark, rows)


def test_dropped_and_empty(spark):
    frame = plain_rows(spark.createDataFrame([], TURNS))
    plans = repair_plans(frame)
    assert plans.collect() == [] and repaired_rows(frame, plans).collect() == [] and repaired_digests(frame, plans).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", True), (2, 0, "user", "Hi.", False), (2, 1, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    plans = repair_plans(rows, "gone")
    assert sorted(map(tuple, plans.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 2, "D")]
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, repaired_digests(rows, plans, "gone").collect())) == [(1, empty), (2, empty)]
