"""Content that is not UTF-8: what a reader of bytes and runes finds."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leaksieve import ScanConfig, all_of, any_of, complexity_filter, entropy_filter, regex_filter, scan
from leaksieve.functions import views
from leaksieve.operators.filters import TokenFilter
from leaksieve.operators.scan import scan_exact
from leaksieve.plans.run import scan_folder
from leaksieve.sources.tables import as_byte_files

SPACES = "\t\n\x0b\f\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
SECRET = "aB3$kL9@mX2#pQ5!rT8&nV1^wY4*uI7"


def runes(data):
    """Runes with their bytes; a byte that begins no sequence is a replacement character."""
    out, i = [], 0
    while i < len(data):
        for size in (1, 2, 3, 4):
            try:
                if len(letter := data[i : i + size].decode()) == 1:
                    out.append((letter, data[i : i + size]))
                    break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append(("�", data[i : i + 1]))
        i += size
    return out


def entropy(data):
    units = [r for r, _ in runes(data)] if len(data) < 256 else data
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(units).values()) + 0.0


def fields(data):
    out, held = [], b""
    for letter, raw in [*runes(data), (" ", b" ")]:
        if letter in SPACES and letter != "�":
            out += [held] if held else []
            held = b""
        else:
            held += raw
    return out


def content(spark, contents):
    table = spark.createDataFrame([(f"f{n}", bytearray(c) if c is not None else None) for n, c in enumerate(contents)], "path string, content binary")
    return as_byte_files(table, F.col("path"), F.col("content"))


def random_bytes(rng):
    pieces = [b"a", b"B", b"1", b"\n", b" ", b"\x85", b"\xa0", b"\xc2\x85", b"\xc2\xa0", b"\xe2\x80\x83", b"\xe2\x80", b"\xff", b"\xc3\xa9", b"\xe9", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80", b"\xef\xbf\xbd", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\xe2", b"x-=/"]
    return b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))


def test_equals_a_reader_of_bytes(spark):
    rng = random.Random(6)
    contents = [random_bytes(rng) for _ in range(300)] + [b"\xe9" * 255, b"\xe9\xe8" * 128, b"", None]
    got = {}
    for r in scan_exact(content(spark, contents), entropy_filter(0.5)).collect():
        got.setdefault(r["path"], []).append((r["line_no"], r["col"], r["token"], r["payload"]["entropy"]))
    want = {}
    for n, data in enumerate(contents):
        for line_no, line in enumerate((data or b"").split(b"\n"), 1):
            for col, token in enumerate(fields(line), 1):
                if round(entropy(token), 9) > 0.5:
                    text = "".join(r for r, _ in runes(token))
                    want.setdefault(f"f{n}", []).append((line_no, col, text, f"{round(entropy(token), 9):.4f}"))
    assert got.keys() == want.keys()
    for path in want:
        assert [g[:3] for g in got[path]] == [w[:3] for w in want[path]]
        assert all(abs(float(g[3]) - float(w[3])) < 2e-4 for g, w in zip(got[path], want[path]))


def test_valid_content_is_scanned_as_ever(spark, files_of):
    texts = {"f0": f"é {SECRET}\nb　c", "f1": "plain"}
    either = any_of(complexity_filter(), entropy_filter(2.0), regex_filter("r", "c$"))
    exact = scan_exact(content(spark, [t.encode() for t in texts.values()]), either)
    assert sorted(map(str, exact.collect())) == sorted(map(str, scan(files_of(texts), either).collect()))


def test_filters_see_bytes(spark):
    files = content(spark, [b"Aa1\xe9" * 4 + b" Aa1\xe9\xe9\xe9\xe9\xe9\xe9\xe9\xe9\xe9\xe9\xe9"])
    assert [r["col"] for r in scan_exact(files, complexity_filter()).collect()] == [1]
    assert [r["payload"] for r in scan_exact(files, regex_filter("x", "1.A")).collect()] == [{"x": "1�A"}]
    both = all_of(complexity_filter(), entropy_filter(1.5))
    assert [sorted(r["payload"]) for r in scan_exact(files, both).collect()] == [["complexity", "entropy"]]
    assert scan_exact(files, None).collect() == []
    own = TokenFilter(lambda token: token == "x", lambda token: {})
    with pytest.raises(ValueError):
        scan_exact(files, own)


def test_a_tree_with_latin_1(spark, tmp_path):
    line = "clé=aB3$kL9@mX2#pQ5!rTéèà8&nV1^wY4*uI7"
    (tmp_path / "latin.conf").write_bytes(f"# é\n{line}\n".encode("latin-1"))
    (tmp_path / "utf.conf").write_bytes(f"# é\n{line}\n".encode())
    found = {r["path"]: r["hits"] for r in scan_folder(spark, str(tmp_path), ScanConfig(use_gitignore=False)).collect()}
    assert {p: [(h["line_no"], h["col"]) for h in hits] for p, hits in found.items()} == {"latin.conf": [(2, 1)], "utf.conf": [(2, 1)]}
    told = float(found["latin.conf"][0]["payload"]["entropy"])
    assert abs(told - entropy(line.encode("latin-1"))) < 1e-4


def test_views_keep_every_byte(spark):
    every = bytes(range(256))
    row = spark.createDataFrame([(bytearray(every),)], "c binary").select(views.byte_view(F.col("c")).alias("v")).select("v", F.encode("v", "ISO-8859-1").alias("b"))
    assert bytes(row.first()["b"]) == every
