"""The ignore file: reading rules, adding flagged paths."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDED_NOTE = "# flagged paths, from leaksieve"


def read_rules(path: str | Path) -> list[str]:
    """The lines of an ignore file, or of a folder of parts in the order of their names; none if it doesn't exist.

    An ignore file is held by the driver: its rules become part of the plan.
    """
    path = Path(path)
    if path.is_dir():
        parts = sorted(part for part in path.iterdir() if part.name.startswith("part-"))
        return [line for part in parts for line in read_rules(part)]
    try:
        return path.read_text(encoding="utf-8", errors="replace").splitlines()
    except FileNotFoundError:
        return []


def add_rule(path: str | Path, entry: str) -> bool:
    """Add one entry to the end of an ignore file unless a line equals it after trimming; says whether it was added."""
    path = Path(path)
    lines = read_rules(path)
    if entry in (line.strip() for line in lines):
        return False
    with open(path, "a", encoding="utf-8") as handle:
        broken = path.stat().st_size and not path.read_bytes().endswith(b"\n")
        handle.write(("\n" if broken else "") + f"{ADDED_NOTE}\n{entry}\n")
    return True


def ignore_list(findings: DataFrame) -> DataFrame:
    """Every flagged path once."""
    return findings.select("path").distinct()


def write_ignore_list(findings: DataFrame, folder: str) -> None:
    ignore_list(findings).select(F.col("path").alias("value")).write.mode("append").text(folder)


def merge_rules(existing: DataFrame, entries: DataFrame) -> DataFrame:
    """The lines of an ignore file after adding the entries it lacks.

    ``existing`` has ``line_no`` and ``line``; ``entries`` has ``entry``. An
    entry is there if some line equals it after trimming; if not, a note and the
    entry are added. Result: ``line_no``, ``part``, ``entry``, ``line``, in that
    order; added lines have no ``line_no`` and come last, by entry. They are not
    numbered through, since that would put all of them in one task.
    """
    # What counts as blank at either end.
    present = existing.select(F.regexp_replace("line", r"(?U)\A\s+|\s+\z", "").alias("entry"))
    missing = entries.select("entry").distinct().join(present, "entry", "left_anti")
    added = missing.select(
        F.lit(None).cast("int").alias("line_no"),
        F.posexplode(F.array(F.lit(ADDED_NOTE), "entry")).alias("part", "line"),
        "entry",
    )
    kept = existing.select(
        F.col("line_no").cast("int"), F.lit(0).alias("part"), "line", F.lit(None).cast("string").alias("entry")
    )
    return kept.unionByName(added)


def write_rules(merged: DataFrame, folder: str) -> None:
    """Write merged rules as text whose parts, in name order, are the file."""
    order = [F.col("line_no").asc_nulls_last(), "entry", "part"]
    merged.orderBy(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(folder)
