"""Scanning folders of files of any size, some of them, several at once, and only what changed."""

import os

import pytest
from pyspark.sql import functions as F

from leaksieve import ScanConfig, entropy_filter, scan, scan_by_file
from leaksieve.operators.files import left_out
from leaksieve.operators.findings import explode_hits, merge_scans
from leaksieve.operators.scan import block_hits, group_blocks
from leaksieve.operators.snapshots import changed_files, snapshot_status
from leaksieve.plans.catalog import documents, token_scan
from leaksieve.plans.run import folder_snapshot, run, scan_folder, scan_folders, scan_listed
from leaksieve.sources import folder as source
from leaksieve.sources.folder import all_readable, list_folder, read_blocks, read_files, unreadable
from leaksieve.sources.ignorefile import add_rule, read_rules, write_ignore_list

from conftest import SMALL

SECRET = "aB3$kL9@mX2#pQ5!rT8&nV1^wY4*uI7"
OPEN = ScanConfig(max_file_size=None, use_gitignore=False, exempt=())


def put(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, newline="")
    return str(root)


def flat(by_file):
    return sorted((r.path, r.line_no, r.col, r.token) for r in explode_hits(by_file).collect())


def test_documents_as_files_scan_like_the_table(spark, tmp_path):
    """The tables' texts written as files, listed, read in small blocks and scanned."""
    rows = documents(spark, SMALL).select("path", "text").collect()
    root = put(tmp_path, {r.path: r.text for r in rows})
    blocks = read_blocks(list_folder(spark, root), root, 700)
    got = group_blocks(block_hits(blocks, entropy_filter(3.0)))
    want = sorted((r.path, r.line_no, r.col, r.token) for r in token_scan(spark, SMALL).collect())
    assert len(want) > 100
    assert flat(got) == want
    assert flat(got) == sorted((r.path, r.line_no, r.col, r.token) for r in scan(blocks, entropy_filter(3.0)).collect())


def test_blocks_are_refused_where_they_are_wrong(spark, tmp_path):
    root = put(tmp_path, {"f": "a\nb\n"})
    blocks = read_blocks(list_folder(spark, root), root, 2)
    whole = read_files(list_folder(spark, root), root)
    for wrong in (
        lambda: scan(blocks, entropy_filter(1.0), line_limit=10),
        lambda: scan_by_file(blocks, entropy_filter(1.0)),
        lambda: snapshot_status(blocks, whole),
        lambda: changed_files(whole, blocks),
    ):
        with pytest.raises(ValueError, match="blocks"):
            wrong()


def test_long_lines_are_read_once(spark, tmp_path, monkeypatch):
    root = put(tmp_path, {"f": "x" * 5000 + "\nend " + SECRET})
    manifest = list_folder(spark, root)
    rows = sorted((r.line_base, len(r.text)) for r in read_blocks(manifest, root, 100).collect())
    assert rows == [(0, 5001), (1, 4 + len(SECRET))]
    with pytest.raises(Exception, match="a line of more than 1000 bytes"):
        read_blocks(manifest, root, 100, max_line_bytes=1000).collect()


def test_unreadable_files_are_kept_and_told(spark, tmp_path):
    root = put(tmp_path, {"here": SECRET, "gone": SECRET})
    manifest = spark.createDataFrame(list_folder(spark, root).collect())
    os.unlink(f"{root}/gone")
    for files in (read_files(manifest, root), read_blocks(manifest, root)):
        rows = {r.path: r for r in files.collect()}
        assert rows["gone"].text is None and "FileNotFoundError" in rows["gone"].read_error
        assert [r.path for r in unreadable(files).collect()] == ["gone"]
        assert {r.path for r in scan(files, entropy_filter(4.0)).collect()} == {"here"}
        with pytest.raises(Exception, match="cannot read gone"):
            scan(all_readable(files), entropy_filter(4.0)).collect()
    # Line numbers hang on the count of line feeds, so there an error ends the job.
    with pytest.raises(Exception):
        read_blocks(manifest, root, 5).collect()


def test_unlisted_files_are_never_opened(spark, tmp_path):
    root = put(tmp_path, {"a": SECRET, "b/c": SECRET, "d": "x"})
    os.chmod(f"{root}/a", 0)
    os.rename(f"{root}/a", f"{root}/moved")
    os.symlink(f"{root}/moved", f"{root}/a")
    assert flat(scan_listed(spark, root, ["b/c", "d", "none"], OPEN)) == [("b/c", 1, 1, SECRET)]
    many = spark.range(60_000).select(F.concat(F.lit("p"), "id").alias("path")).unionByName(spark.createDataFrame([("b/c",)], "path string"))
    assert flat(scan_listed(spark, root, many, OPEN)) == [("b/c", 1, 1, SECRET)]


def test_only_changed_files_are_opened(spark, tmp_path, monkeypatch):
    root = put(tmp_path, {"same": SECRET, "touched": SECRET, "changed": "x", "big": "y"})
    snapshot = spark.createDataFrame(folder_snapshot(spark, root).collect())
    put(tmp_path, {"changed": f"now {SECRET}", "new": SECRET, "big": "y" * 600 + " " + SECRET})
    os.utime(f"{root}/touched", (1, 1))
    asked = []
    reader = source.read_files
    monkeypatch.setattr("leaksieve.plans.run.read_files", lambda manifest, root: asked.append({r.path for r in manifest.collect()}) or reader(manifest, root))
    config = ScanConfig(changed_only=True, max_file_size=None)
    assert flat(scan_folder(spark, root, config, snapshot)) == [("big", 1, 2, SECRET), ("changed", 1, 2, SECRET), ("new", 1, 1, SECRET)]
    assert asked == [{"touched", "changed", "new", "big"}]


def test_roots_with_equal_paths_stay_apart(spark, tmp_path):
    one, two = put(tmp_path / "one", {"src/key.go": SECRET}), put(tmp_path / "two", {"src/key.go": "x\n" + SECRET, "b": SECRET})
    found = scan_folders(spark, [one, f"{two}/", one], OPEN)
    want = sorted([(f"{one}/src/key.go", 1, 1, SECRET), (f"{two}/src/key.go", 2, 1, SECRET), (f"{two}/b", 1, 1, SECRET)])
    assert flat(found) == want
    assert flat(merge_scans(scan_folders(spark, [one], OPEN), scan_folders(spark, [two], OPEN))) == want
    with pytest.raises(ValueError):
        scan_folders(spark, [], OPEN)


def test_a_written_ignore_list_is_read_again(spark, tmp_path):
    root = put(tmp_path / "tree", {"a/key": SECRET, "b": SECRET, "clean": "x"})
    found = explode_hits(scan_folder(spark, root, OPEN))
    write_ignore_list(found, f"{root}/.gitignore")
    assert sorted(read_rules(f"{root}/.gitignore")) == ["a/key", "b"]
    config = ScanConfig(max_file_size=None, use_gitignore=True)
    assert scan_folder(spark, root, config).isEmpty()
    assert read_rules(tmp_path / "missing") == []
    with pytest.raises(OSError):
        read_rules(f"{root}/b/below")


def test_a_report_is_ignored_from_then_on(spark, tmp_path):
    root = put(tmp_path / "tree", {"key": SECRET, ".gitignore": "*.secret"})
    config = ScanConfig(max_file_size=None, use_gitignore=True)
    for _ in range(2):
        assert run(scan_folder(spark, root, config), config, str(tmp_path / "tree" / "report.json"), "me", "now", f"{root}/.gitignore")
    assert read_rules(f"{root}/.gitignore").count("report.json") == 1
    assert read_rules(f"{root}/.gitignore")[0] == "*.secret"
    assert not add_rule(f"{root}/.gitignore", "report.json")


def test_the_cap_says_what_it_leaves_out(spark, tmp_path):
    root = put(tmp_path, {"small": SECRET, "large": SECRET + " " * 600, "LICENSE": "x" * 700})
    manifest = list_folder(spark, root)
    assert tuple(left_out(manifest, ScanConfig()).first()) == (1, len(SECRET) + 600)
    assert tuple(left_out(manifest, ScanConfig(max_file_size=None)).first()) == (0, 0)
    assert len(flat(scan_folder(spark, root, ScanConfig()))) == 1
    assert len(flat(scan_folder(spark, root, ScanConfig(max_file_size=None)))) == 2
