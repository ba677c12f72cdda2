import glob
import json

import pytest

from leaksieve import any_of, complexity_filter, entropy_filter, regex_filter, scan, scan_by_file
from leaksieve.operators import findings as derived
from leaksieve.operators.masking import MARKER, mask_lines, mask_reported, restore_lines, vault_rows
from leaksieve.operators.snapshots import changed_files, digests, scan_changed, snapshot_status
from leaksieve.sources import ignorefile, reports

SECRET = "aB3$kL9@mX2#pQ5!rT8&nV1^wY4*uI7"
TEXTS = {
    "one.go": f"first line\nkey = {SECRET}\n\n{SECRET} {SECRET}\r\nlast",
    'quote".go': f'say "{SECRET}" <&>',
    "clean.go": "nothing here\n",
    "none": None,
}


def by_file(frame):
    return {row.path: [(h.line_no, h.col, h.token, dict(h.payload)) for h in row.hits] for row in frame.collect()}


@pytest.fixture
def found(files_of):
    return scan_by_file(files_of(TEXTS), any_of(complexity_filter(), entropy_filter(4.0)))


def test_report_round_trip(spark, found, tmp_path):
    folder = str(tmp_path / "report")
    reports.write_report(found, folder, "someone", "2024-01-01T00:00:00Z")
    assert by_file(reports.read_report(spark, folder)) == by_file(found)
    assert reports.read_report_meta(spark, folder).first().asDict() == {
        "timestamp": "2024-01-01T00:00:00Z", "author": "someone", "freq": 4,
    }


def test_document_round_trip(spark, found, tmp_path):
    report, parts = str(tmp_path / "report"), str(tmp_path / "parts")
    reports.write_report(found, report, "someone", "now")
    reports.write_document(spark, report, parts)
    text = "".join(open(part).read() for part in sorted(glob.glob(f"{parts}/part-*")))
    document = json.loads(text)
    assert document["meta"] == {"timestamp": "now", "author": "someone", "freq": 4}
    assert sorted(document["data"]) == ["one.go", 'quote".go']
    assert document["data"]["one.go"]["Indexes"] == [2, 4, 4] and document["data"]["one.go"]["Columns"] == [3, 1, 2]
    single = tmp_path / "report.json"
    single.write_text(json.dumps(document, indent=2))
    assert by_file(reports.read_document(spark, str(single))) == by_file(found)


def test_empty_report(spark, files_of, tmp_path):
    report, parts = str(tmp_path / "report"), str(tmp_path / "parts")
    reports.write_report(scan_by_file(files_of({"a": "b"}), entropy_filter(4.0)), report, "x", "now")
    reports.write_document(spark, report, parts)
    text = "".join(open(part).read() for part in sorted(glob.glob(f"{parts}/part-*")))
    assert json.loads(text) == {"meta": {"timestamp": "now", "author": "x", "freq": 0}, "data": {}}


def test_totals_and_gates(files_of):
    files, strict = files_of(TEXTS), entropy_filter(4.0)
    assert derived.hit_total(scan(files, strict)).first().freq == 4
    assert derived.gate(files, strict).first()[0] is True
    assert derived.gate(files, entropy_filter(7.0)).first()[0] is False
    assert derived.found_any(files, strict) and not derived.found_any(files.limit(0), strict)
    assert derived.gate(files.limit(0), strict).first()[0] is False
    assert {r.path for r in derived.clean_files(files, strict).collect()} == {"clean.go", "none"}
    assert {r.path for r in derived.quarantined_files(files, strict).collect()} == {"one.go", 'quote".go'}
    assert derived.admit_batch(files, strict).count() == 0
    assert derived.admit_batch(files, entropy_filter(7.0)).count() == 4


def test_report_lines(files_of):
    files = files_of({"f": f"a {SECRET}"})
    rows = derived.report_lines(scan(files, any_of(entropy_filter(4.0), complexity_filter())))
    assert [(r.part, r.message) for r in rows.orderBy("part").collect()] == [
        (0, f"Line 1 (Col 2): {SECRET}"), (1, "  complexity: 4"), (2, "  entropy: 4.9542"),
    ]


def test_merge(files_of):
    limit = entropy_filter(4.0)
    first = scan_by_file(files_of({"a": SECRET, "b": SECRET, "c": SECRET}), limit)
    second = scan_by_file(files_of({"a": f"x {SECRET}", "b": "clean now", "d": SECRET}), limit)
    merged = by_file(derived.merge_scans(first, second))
    assert {path: hits[0][:2] for path, hits in merged.items()} == {"a": (1, 2), "b": (1, 1), "c": (1, 1), "d": (1, 1)}
    with pytest.raises(ValueError):
        derived.merge_scans()


def test_ignore_list(spark, files_of, tmp_path):
    found = scan(files_of(TEXTS), entropy_filter(4.0))
    folder = str(tmp_path / "ignore")
    ignorefile.write_ignore_list(found, folder)
    assert sorted(r.value for r in spark.read.text(folder).collect()) == ["one.go", 'quote".go']


def test_adding_ignore_rules(spark, tmp_path):
    existing = spark.createDataFrame([(1, "# mine"), (2, "  a.txt\t"), (3, "b*")], "line_no int, line string")
    entries = spark.createDataFrame([("a.txt",), ("c.txt",), ("b.txt",), ("c.txt",)], "entry string")
    folder = str(tmp_path / "rules")
    ignorefile.write_rules(ignorefile.merge_rules(existing, entries), folder)
    text = "".join(open(part).read() for part in sorted(glob.glob(f"{folder}/part-*")))
    note = ignorefile.ADDED_NOTE
    assert text.splitlines() == ["# mine", "  a.txt\t", "b*", note, "b.txt", note, "c.txt"]
    assert ignorefile.read_rules(tmp_path / "missing") == []


def test_mask_and_restore(files_of):
    files = files_of(TEXTS)
    masked = mask_lines(files, entropy_filter(4.0)).cache()
    texts = {row.path: row.text for row in masked.collect()}
    assert texts["one.go"] == f"first line\n{MARKER}\n\n{MARKER}\nlast"
    assert texts["clean.go"] == TEXTS["clean.go"] and texts["none"] is None
    vault = vault_rows(masked)
    assert {r.path: [v.line_no for v in r.vault] for r in vault.collect()} == {"one.go": [2, 4], 'quote".go': [1]}
    restored = restore_lines(masked, vault)
    assert {row.path: row.text for row in restored.collect()} == TEXTS


def test_mask_from_a_report(files_of, found):
    files = files_of(TEXTS)
    texts = {row.path: row.text for row in mask_reported(files, found).collect()}
    assert texts == {row.path: row.text for row in mask_lines(files, entropy_filter(4.0)).collect() if row.vault}
    shorter = files_of({"one.go": "just one line"})
    assert (mask_reported(shorter, found).first().text, mask_reported(shorter, found).first().unmatched) == ("just one line", [2, 4])


def test_restore_identity_on_documents(documents):
    hexes = any_of(regex_filter("sha1", "[0-9a-f]{40}"), entropy_filter(3.0))
    masked = mask_lines(documents, hexes).cache()
    assert vault_rows(masked).count() > 100
    restored = restore_lines(masked, vault_rows(masked)).select("path", "text")
    assert restored.exceptAll(documents.select("path", "text")).count() == 0
    assert restored.count() == documents.count()


def test_snapshots(files_of):
    before = files_of({"same": SECRET, "changed": SECRET, "gone": SECRET, "to-null": "x"})
    after = files_of({"same": SECRET, "changed": f"now {SECRET}", "fresh": SECRET, "plain": "x", "to-null": None})
    assert {r.path: r.status for r in snapshot_status(before, after).collect()} == {
        "changed": "modified", "gone": "deleted", "fresh": "untracked", "plain": "untracked", "to-null": "modified",
    }
    assert {r.path for r in changed_files(before, after).collect()} == {"changed", "fresh", "plain", "to-null"}
    assert set(by_file(scan_changed(before, after, entropy_filter(4.0)))) == {"changed", "fresh"}
    assert set(by_file(scan_changed(before, after, entropy_filter(4.0), max_file_size=31))) == {"fresh"}
    stored = digests(before)
    assert stored.columns == ["path", "digest"]
    assert {r.path for r in changed_files(stored, after).collect()} == {"changed", "fresh", "plain", "to-null"}
    assert set(by_file(scan_changed(stored, after, entropy_filter(4.0)))) == {"changed", "fresh"}


def test_stream_equals_batch(spark, files_of, tmp_path):
    from leaksieve.model import FILES
    from leaksieve.streaming import start_gate, start_scan, stream_table

    inbox, limit = str(tmp_path / "in"), entropy_filter(4.0)
    out = {name: str(tmp_path / name) for name in ("found", "found-log", "routed", "routed-log")}

    def run():
        for start, name in ((start_scan, "found"), (start_gate, "routed")):
            start(stream_table(spark, inbox, FILES), limit, out[name], out[f"{name}-log"]).awaitTermination()

    files_of(TEXTS).write.parquet(inbox)
    run()
    files_of({"later": SECRET}).write.mode("append").parquet(inbox)
    run()
    run()
    everything = spark.read.schema(FILES).parquet(inbox)
    got = sorted((r.path, r.line_no, r.col) for r in spark.read.parquet(out["found"]).collect())
    assert got == sorted((r.path, r.line_no, r.col) for r in scan(everything, limit).collect()) and len(got) == 5
    routed = {r.path: r.verdict for r in spark.read.parquet(out["routed"]).collect()}
    assert routed == {
        "one.go": "quarantined", 'quote".go': "quarantined", "later": "quarantined", "clean.go": "clean", "none": "clean",
    }


def test_readable_report(spark, files_of):
    found = scan(files_of({"b": f"x {SECRET}", "a": SECRET}), entropy_filter(4.0))
    rows = derived.readable_report(found).orderBy("path", "line_no", "col", "part").collect()
    assert [r.message for r in rows if r.line_no == 0] == ["Secrets in a", "Secrets in b"]
    assert rows[1].message == f"Line 1 (Col 1): {SECRET}"
    nothing = derived.readable_report(found.filter("path = 'none'")).collect()
    assert [r.message for r in nothing] == ["Nothing was found."]
