"""A whole scan: settings, predicates, filter, gate and report."""

from __future__ import annotations

import json
import os
from collections.abc import Collection, Iterable, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.model import ScanConfig
from leaksieve.operators.files import eligible, within_size
from leaksieve.operators.filters import TokenFilter, configured_filters, default_scan
from leaksieve.operators.scan import block_hits, group_blocks, listed_files, scan_by_file
from leaksieve.operators.snapshots import changed_manifest, scan_changed
from leaksieve.session import scratch_dir
from leaksieve.sources.folder import all_readable, list_folder, read_blocks, read_files
from leaksieve.sources.ignorefile import add_rule, read_rules
from leaksieve.sources.reports import write_report
from leaksieve.sources.tree import local_root, read_tree


def effective_filter(config: ScanConfig) -> TokenFilter:
    rules, limit, mode = config.target_regex, config.entropy_limit, config.entropy_mode
    return default_scan(limit, configured_filters(rules, limit, mode) if rules else None, mode)


def scan_files(
    files: DataFrame, config: ScanConfig, ignore_lines: Iterable[str] = (), previous: DataFrame | None = None
) -> DataFrame:
    """By-file findings of a table of files.

    With ``changed_only`` the files that differ from ``previous`` are scanned,
    and of the predicates only the size applies.
    """
    if config.changed_only:
        if previous is None:
            raise ValueError("scanning changes needs the previous snapshot")
        return scan_changed(previous, files, effective_filter(config), config.max_file_size)
    return scan_by_file(eligible(files, config, ignore_lines), effective_filter(config))


def scan_manifest(manifest: DataFrame, root: str, config: ScanConfig) -> DataFrame:
    """By-file findings of the files of a manifest, whatever their size.

    Files are read in blocks of whole lines; hits of a file's blocks are put
    together afterwards, and no text is. A file that cannot be read ends the job.
    """
    blocks = all_readable(read_blocks(manifest, root, exact=True))
    return group_blocks(block_hits(blocks, effective_filter(config)))


def scan_folder(spark: SparkSession, root: str, config: ScanConfig, previous: DataFrame | None = None) -> DataFrame:
    """By-file findings of a folder tree. Files that are not eligible are never opened.

    With ``changed_only``, ``previous`` is the manifest of an earlier state with a column
    ``digest`` (see ``folder_snapshot``). Only files whose size or time differs are
    opened, and of those only the ones with another digest are scanned.
    """
    manifest = list_folder(spark, root)
    if config.changed_only:
        if previous is None:
            raise ValueError("scanning changes needs the previous snapshot")
        candidates = manifest.filter(within_size(F.col("size"), config.max_file_size))
        if {"size", "mtime"} <= set(previous.columns):
            candidates = changed_manifest(previous, candidates)
        files = all_readable(read_files(candidates, root))
        return scan_changed(previous, files, effective_filter(config))
    rules = read_rules(f"{root}/.gitignore") if config.use_gitignore else []
    return scan_manifest(eligible(manifest, config, rules), root, config)


def scan_tree(spark: SparkSession, root: str, config: ScanConfig, **options: object) -> DataFrame:
    """By-file findings of a folder tree by ``read_tree``: listing and reading are one job. Size, exemptions and modes are part of the walk."""
    rules = read_rules(f"{local_root(root)}/.gitignore") if config.use_gitignore else []
    chosen = {"exempt": json.dumps(config.exempt), "executables": "false"} | options
    if config.max_file_size is not None:
        chosen["maxSize"] = config.max_file_size
    blocks = all_readable(read_tree(spark, root, **chosen))
    return group_blocks(block_hits(eligible(blocks, config, rules), effective_filter(config)))


def scan_folders(spark: SparkSession, roots: Sequence[str], config: ScanConfig) -> DataFrame:
    """By-file findings of several folder trees; a path begins with its root, so equal relative paths stay apart."""
    if not roots:
        raise ValueError("no roots")
    found = [
        scan_folder(spark, root, config).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "path"))
        for root in dict.fromkeys(roots)
    ]
    return reduce(DataFrame.unionByName, found)


def scan_listed(spark: SparkSession, root: str, paths: DataFrame | Collection[str], config: ScanConfig) -> DataFrame:
    """By-file findings of the listed files of a folder tree; the others are never opened."""
    return scan_manifest(listed_files(list_folder(spark, root), paths, config.max_file_size), root, config)


def folder_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """What to store of a folder in order to scan only what changes: path, size, mtime and digest of every file."""
    files = all_readable(read_files(list_folder(spark, root), root))
    return files.select("path", "size", "mtime", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def run(
    by_file: DataFrame, config: ScanConfig, report: str, author: str, timestamp: str, ignore_file: str | Path | None = None
) -> bool:
    """Evaluate findings once and say whether there are any.

    A report is written only if there are and ``logging`` is on; otherwise an
    earlier one stays as it is. The name of a written report is added to
    ``ignore_file``, if one is given, so that later scans pass over it.
    """
    spark = by_file.sparkSession
    stored = scratch_dir(spark, "findings")
    by_file.write.parquet(stored)
    found = spark.read.schema(by_file.schema).parquet(stored)
    if found.isEmpty():
        return False
    if config.logging:
        write_report(found, report, author, timestamp)
        if ignore_file is not None:
            add_rule(ignore_file, os.path.basename(report.rstrip("/")))
    return True
