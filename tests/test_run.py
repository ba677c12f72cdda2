import pytest

from leaksieve import ScanConfig
from leaksieve.operators.snapshots import digests
from leaksieve.plans.run import run, scan_files, scan_folder
from leaksieve.sources.reports import read_report, read_report_meta

SECRET = "aB3$kL9@mX2#pQ5!rT8&nV1^wY4*uI7"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / ".gitignore").write_text("*.secret\n")
    (root / "src" / "key.go").write_text(f"key = {SECRET}\n")
    (root / "src" / "key.secret").write_text(SECRET)
    (root / "clean.go").write_text("nothing\n")
    return root


def test_folder_run(spark, tree, tmp_path):
    report = str(tmp_path / "report")
    config = ScanConfig()
    assert run(scan_folder(spark, str(tree), config), config, report, "me", "now") is True
    assert [row.path for row in read_report(spark, report).collect()] == ["src/key.go"]
    (tree / "src" / "key.go").write_text("clean now\n")
    assert run(scan_folder(spark, str(tree), config), config, report, "me", "later") is False
    assert read_report_meta(spark, report).first().timestamp == "now"
    loose = ScanConfig(use_gitignore=False, logging=False)
    assert run(scan_folder(spark, str(tree), loose), loose, str(tmp_path / "none"), "me", "now") is True
    assert not (tmp_path / "none").exists()


def test_changed_files_run(spark, files_of):
    config = ScanConfig(changed_only=True, target_regex={"any": "[a-z]"})
    before = files_of({"old": SECRET, "same": SECRET})
    after = files_of({"old": f"{SECRET} x", "same": SECRET, "LICENSE": SECRET, "big": SECRET + " " * 600})
    found = scan_files(after, config, previous=digests(before)).collect()
    assert {row.path for row in found} == {"old", "LICENSE"}
    assert dict(found[0].hits[0].payload) == {"any": "a", "complexity": "4", "entropy": "4.9542"}
    with pytest.raises(ValueError):
        scan_files(after, config)


def test_many_rules(spark, files_of):
    from leaksieve import detect_any_rule, scan
    from leaksieve.operators.scan import rule_hits

    rules = {f"rule{n}": f"key{n}_[0-9a-f]{{8}}" for n in range(150)}
    files = files_of({"f": "a key7_0123abcd b\nkey149_ffffffff", "g": "none"})
    assert {(r.line_no, r.col, r.header) for r in rule_hits(files, rules).collect()} == {(1, 2, "rule7"), (2, 1, "rule149")}
    assert scan(files, detect_any_rule(rules, 4.5)).count() == 2
