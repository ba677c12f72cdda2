"""Trees of files as a data source, a stream and a sink."""

import json
import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from leaksieve import ScanConfig, entropy_filter, scan
from leaksieve.model import FINDINGS
from leaksieve.operators.findings import explode_hits
from leaksieve.operators.masking import mask_lines, restore_lines, vault_rows
from leaksieve.operators.scan import scan_exact
from leaksieve.plans.catalog import documents, secret_lines
from leaksieve.plans.run import scan_folder, scan_tree
from leaksieve.sources import tree
from leaksieve.sources.folder import list_folder, read_blocks
from leaksieve.sources.tree import read_tree, stream_tree, write_tree
from leaksieve.streaming import start_scan

SECRET = "aB3$kL9@mX2#pQ5!rT8&nV1^wY4*uI7"
FILES = {
    "plain.txt": "one\ntwo\n",
    ".hidden/.env": f"key {SECRET}\n",
    "_under/empty": "",
    "deep/a/b/c/d.py": "x = 1\r\ny = 2",
    "deep/a/lines": "".join(f"line {i} {SECRET if i % 7 == 0 else ''}\n" for i in range(50)),
    "deep/LICENSE-MIT": SECRET,
    "deep/.git/objects/aa": SECRET,
    "run.sh": f"{SECRET}\n",
}


def put(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


@pytest.fixture
def filled(tmp_path):
    root = put(tmp_path / "root", FILES | {"latin": b"caf\xe9 " + SECRET.encode() + b"\n"})
    os.chmod(f"{root}/run.sh", 0o755)
    os.symlink("plain.txt", f"{root}/link")
    os.symlink("deep", f"{root}/linked-folder")
    return root


def rows(frame):
    return sorted(tuple(r) for r in frame.select("path", "size", "mode", "mtime", "text", "valid_utf8", "line_base").collect())


def test_equals_the_listing_reader(spark, filled):
    want = read_blocks(list_folder(spark, filled), filled, exact=True)
    got = read_tree(spark, f"file://{filled}")
    assert rows(got) == rows(want)
    assert {r["path"] for r in got.collect()} == {*FILES, "latin", "link"}


@pytest.mark.parametrize("limits", [{"planFiles": 1}, {"planFiles": 4}, {"planFolders": 1}, {"planFolders": 3}])
def test_what_the_driver_does_not_list_is_walked_once(spark, filled, limits):
    assert rows(read_tree(spark, filled, **limits)) == rows(read_tree(spark, filled))
    assert len(tree.Walk({"path": filled}).parts(limits.get("planFiles", 10**6), limits.get("planFolders", 10**6))) >= tree.SHARES


def test_blocks_hold_whole_lines(spark, filled):
    blocks = read_tree(spark, filled, blockBytes=40)
    assert blocks.filter("path = 'deep/a/lines'").count() > 5
    found = sorted(scan_exact(blocks, entropy_filter(4.0)).select("path", "line_no", "col", "token").collect())
    assert found == sorted(scan_exact(read_tree(spark, filled), entropy_filter(4.0)).select("path", "line_no", "col", "token").collect())
    with pytest.raises(Exception, match="a line of more than 8 bytes"):
        read_tree(spark, filled, blockBytes=4, maxLineBytes=8).collect()


def test_options_choose_as_filters_do(spark, filled):
    every = read_tree(spark, filled)
    for options, wanted in (
        ({"below": "deep/a"}, "path like 'deep/a%'"),
        ({"below": "deep/a/"}, "path like 'deep/a/%'"),
        ({"below": "deep/a/lines"}, "path = 'deep/a/lines'"),
        ({"below": "p", "maxSize": 8}, "path like 'p%' and size <= 8"),
        ({"maxSize": 0}, "size = 0"),
        ({"executables": "false"}, "mode <> 493"),
        ({"exempt": json.dumps([".git/", "LICENSE", "a/b"])}, "not path rlike '(^|/)([.]git/|LICENSE|a/b)'"),
    ):
        assert rows(read_tree(spark, filled, **options)) == rows(every.filter(wanted)) != rows(every), options


def test_a_frame_may_be_used_more_than_once(spark, filled):
    """Filters of one use don't act on another, as pushed ones would."""
    every = read_tree(spark, filled)
    total = every.count()
    deep, others = every.filter("path like 'deep/%'"), every.filter("not path like 'deep/%'")
    assert 0 < deep.count() < total == every.count() == deep.union(others).count()
    assert deep.select("path").join(every.select("path", "size"), "path", "right").count() == total


def test_folders_aside_are_not_listed(filled, monkeypatch):
    listed = []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: listed.append(os.path.relpath(path, filled)) or scandir(path))
    reader = tree.TreeReader({"path": filled, "below": "deep/a/b", "exempt": json.dumps([".git/", "LICENSE"])})
    assert [path for part in reader.partitions() for path in part.paths] == ["deep/a/b/c/d.py"]
    assert listed == [".", "deep", "deep/a", "deep/a/b", "deep/a/b/c"]
    listed.clear()
    assert len(tree.Walk({"path": filled, "exempt": json.dumps([".git/"])}).parts()) == 1
    assert "deep/.git" not in listed and ".hidden" in listed


def test_scan_tree_is_scan_folder(spark, filled):
    (tmp := open(f"{filled}/.gitignore", "w")).write("_under/\n*.py\n")
    tmp.close()
    for config in (ScanConfig(max_file_size=None, entropy_limit=3.0), ScanConfig(max_file_size=40, entropy_limit=3.0, exempt=())):
        want = sorted(map(tuple, explode_hits(scan_folder(spark, filled, config)).collect()), key=repr)
        assert sorted(map(tuple, explode_hits(scan_tree(spark, filled, config, blockBytes=64)).collect()), key=repr) == want
        assert want


def test_empty_missing_and_foreign_trees(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert read_tree(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="No such file"):
        read_tree(spark, str(tmp_path / "none")).count()
    with pytest.raises(ValueError, match="mounted"):
        read_tree(spark, "s3://somewhere/else")


def test_names_that_are_not_utf8(spark, tmp_path):
    with open(os.path.join(os.fsencode(str(tmp_path)), b"n\xe9"), "w") as handle:
        handle.write("x")
    assert [(r["path"], r["text"]) for r in read_tree(spark, str(tmp_path)).collect()] == [("n�", "x")]


def watch(spark, root, tmp_path):
    started = start_scan(stream_tree(spark, root, settle=0.05), entropy_filter(3.0), f"{tmp_path}/found", f"{tmp_path}/state")
    started.awaitTermination()
    return sum(p["numInputRows"] for p in started.recentProgress)


def found(spark, tmp_path):
    stored = spark.read.schema(FINDINGS).parquet(f"{tmp_path}/found")
    return sorted(map(tuple, stored.select("path", "line_no", "col", "token").collect()))


def batch(spark, root):
    return sorted(map(tuple, scan_exact(read_tree(spark, root), entropy_filter(3.0)).select("path", "line_no", "col", "token").collect()))


def settled():
    import time

    time.sleep(0.3)


def test_stream_follows_a_growing_tree(spark, filled, tmp_path):
    settled()
    assert watch(spark, filled, tmp_path) == len(FILES) + 2
    assert found(spark, tmp_path) == batch(spark, filled)
    assert watch(spark, filled, tmp_path) == 0
    old = tmp_path / "old"
    old.write_text(f"moved {SECRET}")
    os.utime(old, (1, 1))
    os.rename(old, f"{filled}/deep/moved")
    put(tmp_path / "root", {"deep/new/.late": f"late {SECRET}"})
    settled()
    # A file with an old time that was moved in counts as new.
    assert watch(spark, filled, tmp_path) == 2
    assert found(spark, tmp_path) == batch(spark, filled)
    before = found(spark, tmp_path)
    put(tmp_path / "root", {"plain.txt": f"changed {SECRET}"})
    settled()
    # The link to it hasn't changed itself.
    assert watch(spark, filled, tmp_path) == 1
    assert sorted(set(found(spark, tmp_path)) - set(before)) == [("plain.txt", 1, 2, SECRET)]


def test_masked_trees_are_written_and_restored(spark, tmp_path):
    files = documents(spark, SMALL).select("path", "size", "mode", "mtime", "text")
    root = str(tmp_path / "out")
    masked = mask_lines(files, secret_lines())
    masked.write.parquet(f"{tmp_path}/masked")
    stored = spark.read.parquet(f"{tmp_path}/masked")
    for _ in range(2):
        assert write_tree(stored, root).count() == files.count()
    back = read_tree(spark, root)
    assert sorted(back.select("path", "text", "mode").collect()) == sorted(stored.select("path", "text", "mode").collect())
    assert scan(back, secret_lines()).count() == 0 < scan(files, secret_lines()).count()
    whole = back.select("path", "size", "mode", "mtime", "text")
    restored = restore_lines(whole, vault_rows(stored))
    assert write_tree(restored, f"{tmp_path}/again").count() == files.count()
    digest = F.sha2(F.col("text").cast("binary"), 256)
    again = read_tree(spark, f"{tmp_path}/again").select("path", digest)
    assert sorted(again.collect()) == sorted(files.select("path", digest).collect())


def test_a_failed_write_leaves_whole_files(spark, tmp_path, files_of):
    root = tmp_path / "out"
    put(root, {"a": "old"})
    with pytest.raises(Exception, match="outside of the tree"):
        write_tree(files_of({"a": "new", "b/c": "new", "../escaped": "x", "d": "new"}).coalesce(1), str(root)).count()
    left = {os.path.relpath(os.path.join(at, name), root): open(os.path.join(at, name)).read() for at, _, names in os.walk(root) for name in names}
    assert left == {"a": "new", "b/c": "new"}
    assert not (tmp_path / "escaped").exists()
    assert write_tree(files_of({"a": "new", "n": None}), str(root)).collect()[0]["size"] == 3
    with pytest.raises(ValueError, match="blocks"):
        write_tree(read_tree(spark, str(root)), str(root))


def test_a_task_that_dies_while_writing_leaves_the_earlier_file(tmp_path, monkeypatch, spark, files_of):
    root = tmp_path / "out"
    put(root, {"a": "old"})
    # The name that the new text would go by is taken by a folder: the write fails at its last step.
    (root / "b").mkdir()
    (root / "b" / "x").write_text("kept")
    with pytest.raises(Exception, match="(?i)is a directory"):
        write_tree(files_of({"b": "new"}), str(root)).count()
    assert sorted(os.listdir(root)) == ["a", "b"] and (root / "b" / "x").read_text() == "kept"


def test_a_small_file_takes_no_room_of_a_whole_block(tmp_path):
    """Room was made for 32 MB twice a file."""
    import tracemalloc

    from leaksieve.sources.tree import BLOCK_BYTES, MAX_LINE_BYTES, _rows

    texts = {"small": "a\nb", "empty": "", "longer": "line\n" * 5000}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    tracemalloc.start()
    read = {name: [r[4] for r in _rows(str(tmp_path), (name, 0, 0, None), BLOCK_BYTES, MAX_LINE_BYTES)] for name in texts}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == {name: [text] for name, text in texts.items()}
    assert peak < 1 << 20
