import os
import random

import pytest
from pyspark.sql import functions as F

from leaksieve import ScanConfig, entropy_filter, scan
from leaksieve.model import DEFAULT_EXEMPT
from leaksieve.operators.files import eligible, exempt_by_name, exempt_by_path, is_executable, is_exempt
from leaksieve.operators.languages import EXTENSIONS, with_language
from leaksieve.sources.folder import list_folder, read_blocks, read_files

SECRET = 'key = "aB3$kL9@mX2#pQ5!rT8&nV1^wY4*uI7"\n'


def test_exempt(spark):
    cases = {
        "go.sum": (True, True),
        ".gitignore": (True, True),
        "main.go": (False, False),
        ".git/config": (False, True),
        "a/.git/config": (False, True),
        "a/LICENSE": (True, True),
        "a/LICENSE-MIT": (False, True),
        "a/go.sum.bak": (False, True),
        "a/xgo.sum": (False, False),
        "goXsum": (False, False),
    }
    frame = spark.createDataFrame([(path,) for path in cases], "path string")
    rows = frame.select("path", exempt_by_name(F.col("path")), exempt_by_path(F.col("path")), is_exempt(F.col("path")))
    assert {row[0]: (row[1], row[2]) for row in rows.collect()} == cases
    assert all(row[3] == (row[1] or row[2]) for row in rows.collect())
    assert spark.range(1).select(exempt_by_path(F.lit("x"), ())).first()[0] is False


def test_executable(spark):
    frame = spark.createDataFrame([(0o644,), (0o755,), (0o601,), (None,)], "mode int")
    assert [row[0] for row in frame.select(is_executable(F.col("mode"))).collect()] == [False, True, True, False]


def test_eligible(files_of):
    small = files_of({"a.go": "x" * 500, "b.go": "x" * 501, "LICENSE": "x", "c.secret": "x", "keep.secret": "x"})
    tool = files_of({"run.sh": "x"}, mode=0o755)
    rules = ["*.secret", "!keep.secret"]
    both = small.unionByName(tool)
    assert {r.path for r in eligible(both, ScanConfig(), rules).collect()} == {"a.go", "keep.secret"}
    free = ScanConfig(use_gitignore=False, max_file_size=501)
    assert {r.path for r in eligible(both, free, rules).collect()} == {"a.go", "b.go", "c.secret", "keep.secret"}


def test_languages(spark):
    cases = {"a/b.py": "python", "x.tar.gz": None, "Makefile": None, "a.b/c": None, ".json": "json", "q.hpp": "cpp"}
    frame = spark.createDataFrame([(path,) for path in cases], "path string")
    assert {row.path: row.language for row in with_language(frame).collect()} == cases
    more = spark.createDataFrame([(".gz", "gzip")], "ext string, language string")
    assert {row.path: row.language for row in with_language(frame, more).collect()}["x.tar.gz"] == "gzip"
    assert len(EXTENSIONS) == 110


@pytest.fixture
def tree(tmp_path):
    def put(name, content, mode=0o644):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        path.chmod(mode)

    put(".env", SECRET)
    put("_hidden/deep/er/config.go", "package x\n" + SECRET)
    put("run.sh", SECRET, 0o755)
    put("go.sum", SECRET)
    put(".git/obj", SECRET)
    put("skip.secret", SECRET)
    put("latin.txt", b"caf\xe9 plain\n")
    put("empty.txt", b"")
    put("big.bin", b"x" * 4096)
    (tmp_path / "none").mkdir()
    os.symlink("nowhere", tmp_path / "broken")
    os.symlink(".env", tmp_path / "link")
    os.symlink("_hidden", tmp_path / "folder-link")
    return str(tmp_path)


def test_folder_scan(spark, tree):
    manifest = list_folder(spark, tree)
    listed = {row.path: row for row in manifest.collect()}
    assert set(listed) == {
        ".env", "_hidden/deep/er/config.go", "run.sh", "go.sum", ".git/obj", "skip.secret", "latin.txt",
        "empty.txt", "big.bin", "link",
    }
    assert listed["run.sh"].mode & 0o111 and not listed[".env"].mode & 0o111
    assert listed["big.bin"].size == 4096 and listed["empty.txt"].size == 0
    config = ScanConfig(max_file_size=1024)
    files = read_files(eligible(manifest, config, ["*.secret"]), tree)
    found = scan(files, entropy_filter(4.0)).collect()
    assert {(row.path, row.line_no) for row in found} == {(".env", 1), ("link", 1), ("_hidden/deep/er/config.go", 2)}
    texts = {row.path: row for row in files.collect()}
    assert texts["latin.txt"].valid_utf8 is False and texts["latin.txt"].text == "caf� plain\n"
    assert texts["empty.txt"].text == "" and texts[".env"].valid_utf8


def test_reading_in_blocks(spark, tree):
    manifest = list_folder(spark, tree).filter("path = '_hidden/deep/er/config.go' or path = 'empty.txt'")
    rows = sorted((r.path, r.line_base, r.text) for r in read_blocks(manifest, tree, 10).collect())
    assert rows == [
        ("_hidden/deep/er/config.go", 0, "package x\n"),
        ("_hidden/deep/er/config.go", 1, SECRET),
        ("empty.txt", 0, ""),
    ]
    found = scan(read_blocks(manifest, tree, 10), entropy_filter(4.0)).collect()
    assert [(row.path, row.line_no, row.col) for row in found] == [("_hidden/deep/er/config.go", 2, 3)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 10_000])
def test_blocks_join_to_the_file(spark, tmp_path, block):
    rng = random.Random(block)
    texts = {f"f{n}": "".join(rng.choices("ab\né", k=rng.randrange(60))) for n in range(12)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for row in read_blocks(list_folder(spark, str(tmp_path)), str(tmp_path), block).collect():
        got.setdefault(row.path, []).append((row.line_base, row.text))
    for name, text in texts.items():
        pieces = [piece for _, piece in sorted(got[name])]
        assert "".join(pieces) == text
        at = 0
        for base, piece in sorted(got[name]):
            assert base == text[:at].count("\n")
            at += len(piece)


def test_empty_and_missing_folders(spark, tmp_path):
    assert list_folder(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception):
        list_folder(spark, str(tmp_path / "missing"))


def test_default_config():
    config = ScanConfig()
    assert (config.entropy_limit, config.max_file_size, config.logging, config.use_gitignore) == (4.5, 500, True, True)
    assert ScanConfig(max_file_size=0).max_file_size == ScanConfig(max_file_size=-100).max_file_size == 500
    assert ScanConfig(max_file_size=2048).max_file_size == 2048
    assert "test.txt" in config.add_exempt("test.txt").exempt and len(DEFAULT_EXEMPT) == 14


def test_config_file(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text(
        "logging = true\nuse_gitignore = true\nuse_gitdiff = true\n"
        '[filter]\nent_limit = 4.2\nmax_file_size = 1024\ntarget_regex = { aws = "AKIA.*", github = "ghp_.*" }\n'
    )
    config = ScanConfig.load(path, entropy_limit=3.0, logging=False)
    assert (config.entropy_limit, config.max_file_size, config.logging) == (4.2, 1024, True)
    assert config.changed_only and config.use_gitignore
    assert config.target_regex == {"aws": "AKIA.*", "github": "ghp_.*"}
    path.write_text("[filter]\nent_limit = 0\nmax_file_size = -1\n")
    config = ScanConfig.load(path, entropy_limit=3.0, max_file_size=700)
    assert (config.entropy_limit, config.max_file_size, config.use_gitignore) == (3.0, 700, False)


def test_config_errors(tmp_path):
    with pytest.raises(FileNotFoundError):
        ScanConfig.load(tmp_path / "missing.toml")
    (tmp_path / "bad.toml").write_text("[filter\n")
    with pytest.raises(ValueError):
        ScanConfig.load(tmp_path / "bad.toml")
