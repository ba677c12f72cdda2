"""Every named query beside its SQL, and what their plans must not contain."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from check_oracle import TABLES, rows
from leaksieve.operators import masking
from leaksieve.plans import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 164


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert rows(got.astype(object)) == rows(want.astype(object))


def plan_of(spark, name):
    execution = entry.queries()[name](spark, SMALL)._jdf.queryExecution()
    return spark._jvm.PythonSQLUtils.explainString(execution, "formatted")


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    """No Python, no nested loops, no windows, and no text is moved: joins and groups move paths, digests and hits."""
    plan = plan_of(spark, name)
    for unwanted in ("Python", "InPandas", "NestedLoop", "Cartesian", "Window"):
        assert unwanted not in plan
    moved = [
        block.split("Input [", 1)[1].split("\n")[0]
        for block in plan.split("\n\n")
        if "Exchange\n" in block
    ]
    assert not any("text#" in columns or "html#" in columns for columns in moved)


def test_only_marked_texts_meet_the_vault(spark, tmp_path):
    masked = masking.mask_lines(catalog.documents(spark, SMALL), catalog.secret_lines())
    masked.write.parquet(f"{tmp_path}/masked")
    stored = spark.read.parquet(f"{tmp_path}/masked")
    restored = masking.restore_lines(stored.drop("vault"), masking.vault_rows(stored))
    plan = spark._jvm.PythonSQLUtils.explainString(restored._jdf.queryExecution(), "formatted")
    scans = [block for block in plan.split("\n\n") if "Scan parquet" in block]
    assert any("StringContains(text" in block for block in scans)


def test_scans_read_needed_columns_only(spark):
    plan = plan_of(spark, "scan_conversations")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan
    assert "n_chars" not in plan_of(spark, "scan_eligible")
    plan = plan_of(spark, "merge_scans")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
