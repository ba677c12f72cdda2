"""Predicates that decide which files are scanned. All are narrow and need no text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.globs import compile_ignore_rules, ignored_by
from leaksieve.model import DEFAULT_EXEMPT, ScanConfig

EXECUTE_BITS = 0o111


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def exempt_by_name(path: Column, exempt: Iterable[str] = DEFAULT_EXEMPT) -> Column:
    return basename(path).isin(*exempt)


def exempt_by_path(path: Column, exempt: Iterable[str] = DEFAULT_EXEMPT) -> Column:
    """The path, or a part of it after a slash, starts with an entry.

    That is a substring test: ``LICENSE-MIT`` is exempt because ``LICENSE`` is.
    One alternation, so that a computed path is evaluated once and not per entry.
    """
    names = "|".join(re.escape(entry) for entry in exempt)
    return path.rlike(rf"(?:\A|/)(?:{names})") if names else F.lit(False)


def is_exempt(path: Column, exempt: Iterable[str] = DEFAULT_EXEMPT) -> Column:
    """By name or by path; a base name that equals an entry also starts with it."""
    return exempt_by_path(path, exempt)


def is_executable(mode: Column) -> Column:
    """Any execute bit; an unknown mode is not executable."""
    return F.coalesce(mode.bitwiseAND(EXECUTE_BITS) != 0, F.lit(False))


def within_size(size: Column, limit: int | None) -> Column:
    return F.lit(True) if limit is None else size <= limit


def left_out(files: DataFrame, config: ScanConfig) -> DataFrame:
    """One row with the number and bytes of the files that nothing but the size cap keeps from a scan."""
    over = ~within_size(F.col("size"), config.max_file_size)
    wanted = ~is_executable(F.col("mode")) & ~is_exempt(F.col("path"), config.exempt)
    return files.filter(over & wanted).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def is_ignored(path: Column, rule_lines: Iterable[str]) -> Column:
    return ignored_by(path, compile_ignore_rules(rule_lines))


def eligible(files: DataFrame, config: ScanConfig, ignore_lines: Iterable[str] = ()) -> DataFrame:
    """Files a folder scan reads. Works on a manifest as well, before any text is read."""
    kept = files.filter(within_size(F.col("size"), config.max_file_size))
    kept = kept.filter(~is_executable(F.col("mode")) & ~is_exempt(F.col("path"), config.exempt))
    if config.use_gitignore:
        kept = kept.filter(~is_ignored(F.col("path"), ignore_lines))
    return kept
