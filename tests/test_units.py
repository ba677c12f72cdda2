"""Lexical units: a lexer that walks letter by letter gives the same, and special strings of each family."""

import random
import time

import pytest
from conftest import SMALL

from leaksieve import complexity_filter, entropy_filter
from leaksieve.functions import lexers
from leaksieve.operators.filters import all_of
from leaksieve.operators.units import scan_units
from leaksieve.plans.catalog import documents


def end_of_quoted(text, at, quote, lines=True, escapes=True, doubled=False):
    """The place after the closing quote of what opens at ``at``, or None."""
    i = at + len(quote)
    while i < len(text):
        if escapes and text[i] == "\\":
            i += 2
        elif text.startswith(quote, i):
            if doubled and text.startswith(quote, i + 1):
                i += 2
                continue
            return i + len(quote)
        elif text[i] == "\n" and not lines:
            return None
        else:
            i += 1
    return None


def end_of_line(text, at):
    return len(text) if "\n" not in text[at:] else text.index("\n", at)


def end_of_nested(text, at, begin, end):
    depth, i = 0, at
    while i < len(text):
        if text.startswith(begin, i):
            depth, i = depth + 1, i + len(begin)
        elif text.startswith(end, i):
            depth, i = depth - 1, i + len(end)
            if not depth:
                return i
        else:
            i += 1
    return len(text)


def end_of_block(text, at):
    found = text.find("*/", at + 2)
    return len(text) if found < 0 else found + 2


def end_of_heredoc(text, at):
    i = at + 2
    i += text[i : i + 1] in ("-", "~") and text[i : i + 1] != ""
    quote = text[i : i + 1] if text[i : i + 1] in ("'", '"') else ""
    i += len(quote)
    begin = i
    while i < len(text) and text[i].isascii() and (text[i].isalnum() or text[i] == "_"):
        i += 1
    tag = text[begin:i]
    if not tag or tag[0].isdigit() or not text.startswith(quote, i) or "\n" not in text[i:]:
        return None
    i = text.index("\n", i) + 1
    while i <= len(text):
        stop = end_of_line(text, i)
        if text[i:stop].lstrip(" \t") == tag:
            return stop
        if stop == len(text):
            return stop
        i = stop + 1
    return None


def starts(text, i, family):
    """``(kind, end)`` of a comment or string that opens at i."""
    rest = text[i:]
    at_blank = i == 0 or text[i - 1].isspace()
    if family == "go":
        if rest.startswith("//"):
            return "comment", end_of_line(text, i)
        if rest.startswith("/*") and end_of_block(text, i):
            return "comment", end_of_block(text, i)
        for quote in "\"'`":
            if rest.startswith(quote) and (end := end_of_quoted(text, i, quote, quote == "`", quote != "`")):
                return "string", end
    if family == "python":
        if rest.startswith("#"):
            return "comment", end_of_line(text, i)
        for quote in ('"""', "'''", '"', "'"):
            for letters in range(3):
                if rest[letters:].startswith(quote) and (not letters or rest[:letters].isascii() and rest[:letters].isalpha()):
                    if end := end_of_quoted(text, i + letters, quote, len(quote) == 3):
                        return "string", end
    if family == "nested":
        if rest.startswith("//"):
            return "comment", end_of_line(text, i)
        if rest.startswith("/*") and (end := end_of_nested(text, i, "/*", "*/")):
            return "comment", end
        for quote in ('"""', '"'):
            if rest.startswith(quote) and (end := end_of_quoted(text, i, quote)):
                return "string", end
    if family == "sql":
        if rest.startswith("--"):
            return "comment", end_of_line(text, i)
        if rest.startswith("/*") and end_of_block(text, i):
            return "comment", end_of_block(text, i)
        for quote in "'\"":
            if rest.startswith(quote) and (end := end_of_quoted(text, i, quote, True, False, True)):
                return "string", end
    if family == "shell":
        if rest.startswith("#") and at_blank:
            return "comment", end_of_line(text, i)
        if rest.startswith("<<") and (end := end_of_heredoc(text, i)):
            return "heredoc", end
        for quote in "\"'":
            if rest.startswith(quote) and (end := end_of_quoted(text, i, quote, True, quote == '"')):
                return "string", end
    return None


def units(text, family):
    out, i = [], 0
    while i < len(text):
        found = starts(text, i, family)
        begin = i
        if found:
            kind, end = found
            inner = 0
            if kind == "string":
                while text[i + inner] not in "\"'`":
                    inner += 1
                quote = text[i + inner]
                three = text[i + inner : i + inner + 3] == quote * 3 and end - i - inner >= 6 and text[:end].endswith(quote * 3)
                size = 3 if three and family in ("python", "nested") else 1
                begin, stop = i + inner + size, end - size
            else:
                stop = end
            if end - i > 1:
                out.append(("string" if kind == "heredoc" else kind, begin, text[begin:stop]))
            i = end
        elif text[i] == "_" or not text[i].isascii() or text[i].isalnum():
            while i < len(text) and (text[i] == "_" or not text[i].isascii() or text[i].isalnum()):
                i += 1
            out.append(("word", begin, text[begin:i]))
        else:
            i += 1
    rows = []
    for kind, begin, token in out:
        before = text[:begin]
        rows.append((before.count("\n") + 1, len(before[before.rfind("\n") + 1 :].encode()) + 1, kind, token))
    return sorted(rows)


PARTS = {
    "go": ["a1", " ", "\n", '"', "'", "`", "/*", "*/", "//", "\\", "é", "/", "*", "x"],
    "python": ["a1", " ", "\n", '"', "'", '"""', "'''", "#", "\\", "é", "r", "=", "bf"],
    "nested": ["a1", " ", "\n", '"', '"""', "/*", "*/", "//", "\\", "é", "/", "*", "x"],
    "sql": ["a1", " ", "\n", '"', "'", "''", "/*", "*/", "--", "-", "é", "x"],
    "shell": ["a1", " ", "\n", '"', "'", "#", "\\", "é", "<<A\n", "<<-'A' b\n", "\nA\n", "\n A", "A", "<<"],
}
SUFFIX = {"go": "go", "python": "py", "nested": "kt", "sql": "sql", "shell": "sh"}


@pytest.mark.parametrize("family", PARTS)
def test_equals_a_walk_over_the_letters(spark, files_of, family):
    rng = random.Random(family)
    texts = {f"{n}.{SUFFIX[family]}": "".join(rng.choice(PARTS[family]) for _ in range(rng.randint(0, 25))) for n in range(400)}
    got = {path: [] for path in texts}
    for r in scan_units(files_of(texts), all_of()).collect():
        got[r["path"]].append((r["line_no"], r["byte_col"], r["kind"], r["token"]))
    assert {p: sorted(rows) for p, rows in got.items()} == {p: units(t, family) for p, t in texts.items()}


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("a.js", "`t ${b + `in ${c}`} end` // x", ["t ${b + `in ${c}`} end", "// x"]),
        ("a.rs", '/* a /* b */ c */ r#"raw "x""# \'a\' <\'a>', ["/* a /* b */ c */", 'r#"raw "x""#', "a"]),
        ("a.hs", '{- a {- b -} -- c -} "s"', ["{- a {- b -} -- c -}", "s"]),
        ("a.lua", "--[==[ c\n]] ]==] [[l\n]] -- d", ["--[==[ c\n]] ]==]", "[[l\n]]", "-- d"]),
        ("a.cpp", 'R"x(a)" b)x" "c"', ['R"x(a)" b)x"', "c"]),
        ("a.rb", "=begin\nc\n=end\n<<~T\n b\n T\n'd'", ["=begin\nc\n=end", "<<~T\n b\n T", "d"]),
        ("a.html", "<!-- c -- d --><a b=\"u\nv\" c='y'>t &amp; it's</a>", ["<!-- c -- d -->", "u\nv", "y", "t &amp; it's"]),
        ("a.toml", "a = '''x\ny''' # c", ["x\ny", "# c"]),
        ("a.unknown", '"s"', []),
        ("a.go", None, []),
        ("a.py", "", []),
    ],
)
def test_families(spark, files_of, name, text, want):
    found = scan_units(files_of({name: text}), all_of()).filter("kind <> 'word'").orderBy("line_no", "byte_col").collect()
    assert [r["token"] for r in found] == want


@pytest.mark.parametrize("text", ['"' + "a\\" * 100_000, "/* " * 50_000, "`${" * 30_000, '"""' * 30_001, "<<A\n" * 30_000])
def test_long_texts_neither_overflow_nor_go_back(spark, files_of, text):
    started = time.time()
    for name in ("a.go", "a.js", "a.kt", "a.py", "a.sh"):
        assert scan_units(files_of({name: text}), entropy_filter(4.5)).count() == 0
    assert time.time() - started < 60


def test_pieces_tile_the_text(spark):
    files = documents(spark, SMALL).select("text")
    from pyspark.sql import functions as F

    for family in lexers.FAMILIES:
        assert files.filter(F.array_join(lexers.pieces(F.col("text"), F.lit(family)), "") != F.col("text")).count() == 0


def test_places_of_many_hits_in_one_file_take_one_pass(spark, files_of):
    """30,000 hits in 1 MB: joining what lies ahead of each took time with the square of a file."""
    count = 30_000
    text = "".join(f'é = "Secret-{n:06d}-key"\n' for n in range(count))
    began = time.monotonic()
    rows = scan_units(files_of({"a.go": text}), complexity_filter()).select("line_no", "byte_col", "kind", "token").collect()
    assert time.monotonic() - began < 60
    assert [tuple(r) for r in rows] == [(n + 1, 7, "string", f"Secret-{n:06d}-key") for n in range(count)]
