"""Streams over tables that are folders of part files."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from leaksieve import entropy_filter, scan
from leaksieve.model import FINDINGS
from leaksieve.plans import catalog
from leaksieve.sources.tables import document_files
from leaksieve.streaming import batch_decisions, batch_files, start_batch_gate, start_scan, stream_table


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_scan", "stream_gate"])
def test_folder_table_gives_what_a_file_gives(spark, parts, name):
    one, many = catalog.queries()[name](spark, SMALL), catalog.queries()[name](spark, parts)
    assert one.columns == many.columns
    rows = sorted(map(tuple, many.collect()), key=repr)
    assert rows == sorted(map(tuple, one.collect()), key=repr)
    assert rows


def test_batches_are_bounded(spark, parts, tmp_path):
    table = f"{parts}/documents.parquet"
    files = document_files(stream_table(spark, table, spark.read.parquet(table).schema, max_files=1))
    query = start_scan(files, entropy_filter(3.0), f"{tmp_path}/found", f"{tmp_path}/state")
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4


def test_no_hits_give_an_empty_result(spark, parts, tmp_path):
    table = f"{parts}/documents.parquet"
    files = document_files(stream_table(spark, table, spark.read.parquet(table).schema))
    start_scan(files.filter(F.lit(False)), entropy_filter(3.0), f"{tmp_path}/found", f"{tmp_path}/state").awaitTermination()
    assert spark.read.schema(FINDINGS).parquet(f"{tmp_path}/found").count() == 0


def batch_gate(spark, parts, tmp_path, token_filter, name="gate"):
    table = f"{parts}/documents.parquet"
    files = document_files(stream_table(spark, table, spark.read.parquet(table).schema, max_files=1))
    start_batch_gate(files, token_filter, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
    return files.schema


def outcome(spark, folder, schema):
    found = batch_files(spark, folder, schema)
    return sorted(map(tuple, found.select("path", "text", "flagged", "batch_id", "verdict").collect()))


def test_a_batch_is_admitted_whole_or_not_at_all(spark, parts, tmp_path):
    strict = entropy_filter(3.6)
    schema = batch_gate(spark, parts, tmp_path, strict)
    decisions = {r["batch_id"]: r for r in batch_decisions(spark, f"{tmp_path}/gate").collect()}
    whole = outcome(spark, f"{tmp_path}/gate", schema)
    assert len(decisions) == 4 and len(whole) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for number, decision in decisions.items():
        rows = [r for r in whole if r[3] == number]
        assert decision["n_files"] == len(rows) and decision["n_flagged"] == sum(r[2] for r in rows)
        assert {r[4] for r in rows} == {"refused" if any(r[2] for r in rows) else "admitted"}
    hits = {r["path"] for r in scan(document_files(spark.read.parquet(f"{SMALL}/documents.parquet")), strict).collect()}
    assert hits == {r[0] for r in whole if r[2]}
    sides = [batch_files(spark, f"{tmp_path}/gate", schema, side).count() for side in ("admitted", "refused")]
    assert sum(sides) == len(whole)


def test_a_batch_run_again_changes_nothing(spark, parts, tmp_path):
    schema = batch_gate(spark, parts, tmp_path, entropy_filter(3.0))
    before = outcome(spark, f"{tmp_path}/gate", schema)
    state = tmp_path / "gate-state" / "commits"
    # Without their commits the last two batches count as not done.
    for number in (2, 3):
        (state / str(number)).unlink()
        (state / f".{number}.crc").unlink(missing_ok=True)
    batch_gate(spark, parts, tmp_path, entropy_filter(3.0))
    assert outcome(spark, f"{tmp_path}/gate", schema) == before


def test_files_without_a_decision_are_not_shown(spark, parts, tmp_path):
    schema = batch_gate(spark, parts, tmp_path, entropy_filter(3.0))
    shown = {r[3] for r in outcome(spark, f"{tmp_path}/gate", schema)}
    left = tmp_path / "gate" / "files" / "batch_id=9"
    spark.read.parquet(f"{tmp_path}/gate/files/batch_id=0").write.parquet(str(left))
    assert {r[3] for r in outcome(spark, f"{tmp_path}/gate", schema)} == shown
