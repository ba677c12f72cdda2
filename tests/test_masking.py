"""Masking from reports and restoring: whole files, large ones, and files that changed since."""

import time

import pytest
from pyspark.sql import functions as F

from leaksieve import regex_filter
from leaksieve.operators.masking import MARKER, mask_lines, mask_reported, restore_lines, vault_rows
from leaksieve.operators.scan import scan_by_file

FLAG = regex_filter("key", "key[0-9]+")


def large(n):
    return "\n".join(f"key{i} line" if i % 2 else f"plain {i}\r" for i in range(2 * n))


def test_report_masks_what_a_scan_masks(spark, files_of):
    files = files_of({"a": "one\nkey1 x\n\nkey2\n", "b": "none", "c": "", "d": "key3", "e": None, "f": "\n\nkey4\n\n"})
    found = scan_by_file(files, FLAG)
    masked = {r.path: r.text for r in mask_lines(files, FLAG).collect() if r.vault}
    got = {r.path: (r.text, list(r.unmatched)) for r in mask_reported(files, found).collect()}
    assert got == {path: (text, []) for path, text in masked.items()}
    assert got["a"][0] == f"one\n{MARKER}\n\n{MARKER}\n"


def test_lines_that_are_gone_are_told(spark, files_of):
    found = scan_by_file(files_of({"a": "x\nkey1\ny\nkey2"}), FLAG)
    row = mask_reported(files_of({"a": "short\nnow"}), found).first()
    assert (row.text, list(row.unmatched)) == (f"short\n{MARKER}", [4])


@pytest.mark.parametrize("n", [5_000, 20_000])
def test_large_file_in_linear_time(spark, files_of, n):
    files = files_of({"big": large(n)}).cache()
    found = scan_by_file(files, FLAG).cache()
    assert found.first() is not None
    masked = mask_lines(files, FLAG).cache()
    assert masked.count() == 1
    started = time.perf_counter()
    text = mask_reported(files, found).first().text
    restored = restore_lines(masked, vault_rows(masked)).first().text
    spent = time.perf_counter() - started
    assert text == masked.first().text
    assert restored == large(n)
    assert spent < 10  # a quadratic way takes minutes


def test_untouched_files_are_not_returned(spark, files_of):
    files = files_of({"a": "key1", "b": "none"})
    assert [r.path for r in mask_reported(files, scan_by_file(files, FLAG)).collect()] == ["a"]
    assert mask_reported(files, scan_by_file(files.filter(F.lit(False)), FLAG)).collect() == []
