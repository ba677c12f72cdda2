"""Applying a token filter to files.

Every operator here is narrow: text is read, tested and dropped in the same
task. Only hits, which are few and small, are left to shuffle.

A file is first asked as a whole whether any of its tokens matches, which needs
no line numbers; only flagged files are cut into lines and fields.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.text import fields, raw_lines
from leaksieve.functions.views import byte_fields, rune_text
from leaksieve.operators.filters import TokenFilter, any_of, payload, regex_filters
from leaksieve.operators.tokens import literals, readable_lines, tokens


def has_hit(text: Column, token_filter: TokenFilter | None) -> Column:
    """Whether any token of ``text`` matches; false for a null text."""
    return F.coalesce((token_filter or any_of()).in_text(text), F.lit(False))


def one_row_per_file(files: DataFrame) -> None:
    if "line_base" in files.columns:
        raise ValueError("files were cut into blocks; this operator needs one row per file")


def scan(
    files: DataFrame,
    token_filter: TokenFilter | None,
    keep: tuple[str, ...] = ("path",),
    line_limit: int | None = None,
) -> DataFrame:
    """Findings: one row per matching token. No filter means no findings."""
    if line_limit is not None:
        one_row_per_file(files)
    token_filter = token_filter or any_of()
    flagged = files.filter(has_hit(F.col("text"), token_filter))
    base = F.col("line_base") if "line_base" in files.columns else None
    return flagged.select(*keep, F.inline(located_hits(F.col("text"), token_filter, line_limit, base)))


def scan_literals(files: DataFrame, token_filter: TokenFilter) -> DataFrame:
    """As ``scan``, but over quoted literals of files in a known language."""
    hits = literals(files).filter(token_filter.match(F.col("token")))
    return hits.withColumn("payload", payload(token_filter.evidence(F.col("token"))))


def scan_paths(
    files: DataFrame,
    paths: DataFrame | Collection[str],
    token_filter: TokenFilter | None,
    max_file_size: int | None,
) -> DataFrame:
    """Findings of the listed files only; no predicate but the size applies.

    One plan for lists of every length: a semi join below the scan, so unlisted
    texts are not looked at. Spark sends a list to the texts while its bytes are few; beyond
    that both meet by path, with a runtime filter where it pays. Files of a
    folder are better listed on the manifest, before any text is read (``scan_listed``).
    """
    return scan(listed_files(files, paths, max_file_size), token_filter)


def listed_files(files: DataFrame, paths: DataFrame | Collection[str], max_file_size: int | None) -> DataFrame:
    """The rows of a table of files, or of a manifest, whose path is listed."""
    if not isinstance(paths, DataFrame):
        paths = files.sparkSession.createDataFrame([(path,) for path in dict.fromkeys(paths)], "path string")
    candidates = files if max_file_size is None else files.filter(F.col("size") <= max_file_size)
    return candidates.join(paths.select("path"), "path", "left_semi")


def located_hits(
    text: Column,
    token_filter: TokenFilter,
    line_limit: int | None = None,
    line_base: Column | None = None,
    cut: Callable[[Column], Column] = fields,
) -> Column:
    """All hits of one text as an array in line and field order."""

    def in_line(line: Column, index: Column) -> Column:
        number = index + 1 if line_base is None else index + 1 + line_base

        def located(token: Column, at: Column) -> Column:
            place = F.struct(
                number.cast("int").alias("line_no"), (at + 1).cast("int").alias("col"), token.alias("token")
            )
            return F.when(token_filter.match(token), place)

        return F.array_compact(F.transform(cut(line), located))

    # Blank last lines and carriage returns hold no tokens, so a plain cut will do.
    pieces = raw_lines(text) if line_limit is None else readable_lines(text, line_limit)
    return F.transform(
        F.flatten(F.transform(pieces, in_line)),
        lambda hit: F.struct(
            hit.line_no.alias("line_no"),
            hit.col.alias("col"),
            hit.token.alias("token"),
            payload(token_filter.evidence(hit.token)).alias("payload"),
        ),
    )


def _view_filter(token_filter: TokenFilter | None) -> TokenFilter:
    found = any_of() if token_filter is None else token_filter.on_view
    if found is None:
        raise ValueError("the filter cannot be applied to bytes: give it on_view")
    return found


def _exact_flag(token_filter: TokenFilter | None) -> Column:
    text, views = F.col("text"), _view_filter(token_filter)
    in_view = F.coalesce(F.exists(byte_fields(text), views.match), F.lit(False))
    return F.when(F.col("valid_utf8"), has_hit(text, token_filter)).otherwise(in_view)


def _exact_hits(token_filter: TokenFilter | None, line_base: Column | None) -> Column:
    """``located_hits`` of a text or, where ``valid_utf8`` is false, of a byte view, whose tokens are reported as text with replacement characters."""
    text, views = F.col("text"), _view_filter(token_filter)
    found = located_hits(text, views, None, line_base, byte_fields)
    readable = F.transform(found, lambda hit: hit.withField("token", rune_text(hit.token)))
    return F.when(F.col("valid_utf8"), located_hits(text, token_filter or any_of(), None, line_base)).otherwise(readable)


def scan_exact(files: DataFrame, token_filter: TokenFilter | None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """As ``scan``, for files whose ``text`` is a byte view where ``valid_utf8`` is false: lengths, white space and entropies are those of the bytes."""
    base = F.col("line_base") if "line_base" in files.columns else None
    return files.filter(_exact_flag(token_filter)).select(*keep, F.inline(_exact_hits(token_filter, base)))


def scan_by_file(files: DataFrame, token_filter: TokenFilter | None, line_limit: int | None = None) -> DataFrame:
    """Files with hits, each with its hits in order. A file is one row, so nothing is grouped."""
    one_row_per_file(files)
    token_filter = token_filter or any_of()
    flagged = files.filter(has_hit(F.col("text"), token_filter))
    found = flagged.select("path", located_hits(F.col("text"), token_filter, line_limit).alias("hits"))
    # A test on the hits is pushed below them and evaluates them twice; only a cut text needs it.
    return found if line_limit is None else found.filter(F.size("hits") > 0)


def group_blocks(found: DataFrame) -> DataFrame:
    """By-file findings of ``block_hits``: the hits of a file's blocks, in order. Only hits are moved."""

    def by_place(a: Column, b: Column) -> Column:
        return F.when(a.line_base < b.line_base, -1).when(a.line_base > b.line_base, 1).otherwise(0)

    blocks = F.array_sort(F.collect_list(F.struct("line_base", "hits")), by_place)
    return found.groupBy("path").agg(F.flatten(F.transform(blocks, lambda block: block.hits)).alias("hits"))


def block_hits(files: DataFrame, token_filter: TokenFilter | None) -> DataFrame:
    """``path``, ``line_base`` and ``hits`` of the blocks of files (see ``read_blocks``) that have any.

    Blocks that were read with ``exact`` may hold byte views, and are scanned as such.
    """
    token_filter = token_filter or any_of()
    if "exact" in files.columns:
        flagged = files.filter(_exact_flag(token_filter))
        return flagged.select("path", "line_base", _exact_hits(token_filter, F.col("line_base")).alias("hits"))
    flagged = files.filter(has_hit(F.col("text"), token_filter))
    return flagged.select("path", "line_base", located_hits(F.col("text"), token_filter, None, F.col("line_base")).alias("hits"))


def rule_hits(files: DataFrame, rules: dict[str, str], keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Every rule tried on every token: one row per token and matching rule.

    Rules are few and known to the driver, so they become literal patterns in
    one projection. Patterns that came from a joined column would be compiled
    anew for each pair.
    """
    if not rules:
        raise ValueError("no rules")
    members = regex_filters(rules)
    asked = tokens(files.filter(has_hit(F.col("text"), any_of(*members))), keep)
    verdicts = [
        F.when(
            member.match(F.col("token")),
            F.struct(F.lit(header).alias("header"), member.evidence(F.col("token"))[header].alias("value")),
        )
        for header, member in zip(rules, members)
    ]
    found = asked.select(*keep, "line_no", "col", F.explode(F.array_compact(F.array(*verdicts))).alias("found"))
    return found.select(*keep, "line_no", "col", "found.header", "found.value")
