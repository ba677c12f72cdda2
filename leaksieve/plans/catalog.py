"""The named queries: each operator over the whole of the given tables.

Evidence maps are flattened to columns and counters cast to one type, so that
each result can be compared row by row with plain SQL (see ``oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.functions.entropy import LONG_BYTES, entropy, entropy_text, long_entropy, short_entropy, standard_entropy
from leaksieve.functions.text import fields
from leaksieve.functions.views import byte_view
from leaksieve.model import FILES, FINDINGS, ScanConfig
from leaksieve.operators import files as predicates
from leaksieve.operators import findings as derived
from leaksieve.operators import masking, snapshots
from leaksieve.operators.filters import (
    TokenFilter,
    all_of,
    any_of,
    complexity_filter,
    configured_filters,
    default_scan,
    detect_any_rule,
    entropy_filter,
    regex_filter,
)
from leaksieve.operators.languages import with_language
from leaksieve.operators.rules import rule_table_hits
from leaksieve.operators.scan import has_hit, rule_hits, scan, scan_by_file, scan_exact, scan_literals, scan_paths
from leaksieve.operators.tokens import lines, token_counts, tokens
from leaksieve.operators.units import scan_units
from leaksieve.plans.run import scan_tree
from leaksieve.session import scratch_dir
from leaksieve.sources import ignorefile
from leaksieve.sources.tables import (
    as_byte_files,
    conversation_files,
    document_files,
    document_path,
    page_files,
    read_table,
)
from leaksieve.sources.tree import stream_tree, write_tree
from leaksieve.streaming import batch_files, start_batch_gate, start_gate, start_scan, stream_table

Query = Callable[[SparkSession, str], DataFrame]

# Prose holds few tokens above 3.5; markup has some above the default of 4.5.
PROSE_LIMIT = 3.5
LOOSE_LIMIT = 3.0
PAGE_LIMIT = 4.5
MAX_SIZE = 4096
TREE_SIZE = 1 << 20
LINE_LIMIT = 1000
RULES = {
    "sha1": "[0-9a-f]{40}",
    "email": r"[\w.+-]+@[\w.-]+",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
}
PAGE_RULES = {"attribute": "[a-z]+=", "number": "[0-9]+"}
IGNORE_LINES = ("# local secrets", "", "*.secret", "!keep.secret")
EXTRA_EXEMPT = (".env", "doc.md")
AUTHOR = "scanner"
TIMESTAMP = "2024-01-01T00:00:00Z"

_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return document_files(read_table(spark, folder, "documents"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return page_files(read_table(spark, folder, "pages"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_files(read_table(spark, folder, "conversations"))


def flat(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings with the evidence under ``keys`` as columns."""
    values = [F.col("payload").getItem(key).alias(key) for key in keys]
    return findings.select(*[name for name in findings.columns if name != "payload"], *values)


def flat_hits(by_file: DataFrame) -> DataFrame:
    """By-file findings with the hits as one text."""
    hit = F.transform("hits", lambda h: F.concat_ws(":", h.line_no, h.col, h.token))
    return by_file.select("path", F.size("hits").alias("n_hits"), F.array_join(hit, "\n").alias("hits"))


def prose_filter() -> TokenFilter:
    return any_of(complexity_filter(), entropy_filter(PROSE_LIMIT))


# Sources and sinks


@query("files_manifest")
def files_manifest(spark, folder):
    return documents(spark, folder).select("path", "size", "mode")


@query("scan_file_list")
def scan_file_list(spark, folder):
    labelled = read_table(spark, folder, "labels").select("doc_id").distinct()
    listed = read_table(spark, folder, "documents").select("doc_id", "source", "lang").join(labelled, "doc_id")
    paths = listed.select(document_path().alias("path"))
    return flat(scan_paths(documents(spark, folder), paths, entropy_filter(LOOSE_LIMIT), MAX_SIZE), "entropy")


def document_tree(spark: SparkSession, folder: str) -> str:
    """All documents as files of a new tree, modes included; a thousand share a folder, and names end with the number."""
    root = scratch_dir(spark, "tree")
    number = F.regexp_extract("path", r"/d(\d+)/", 1)
    shared = F.concat(F.lit("/d"), F.expr("bigint(regexp_extract(path, '/d([0-9]+)/', 1)) div 1000").cast("string"), F.lit("/"))
    path = F.concat(F.regexp_replace(F.col("path"), F.lit(r"/d\d+/"), shared), F.lit("~"), number)
    write_tree(documents(spark, folder).withColumn("path", path), root).write.format("noop").mode("overwrite").save()
    return root


@query("folder_scan")
def folder_scan(spark, folder):
    """Documents as files of a tree, read back by the data source: size, exemptions and modes decide, in blocks."""
    config = ScanConfig(max_file_size=TREE_SIZE, entropy_limit=LOOSE_LIMIT, use_gitignore=False)
    return flat_hits(scan_tree(spark, document_tree(spark, folder), config))


def snapshots_of_documents(spark, folder):
    """The documents as they are, and an earlier state of them.

    Earlier one source was not there yet, German texts read otherwise, and the
    conversations lay beside them.
    """
    earlier = read_table(spark, folder, "documents", F.col("source") != "src3").withColumn(
        "text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    )
    return document_files(earlier).unionByName(conversations(spark, folder)), documents(spark, folder)


@query("changed_files")
def changed_files(spark, folder):
    return snapshots.changed_files(*snapshots_of_documents(spark, folder))


@query("snapshot_status")
def snapshot_status(spark, folder):
    return snapshots.snapshot_status(*snapshots_of_documents(spark, folder))


@query("scan_changed")
def scan_changed(spark, folder):
    found = snapshots.scan_changed(*snapshots_of_documents(spark, folder), entropy_filter(LOOSE_LIMIT))
    return flat(derived.explode_hits(found), "entropy")


@query("report_rows")
def report_rows(spark, folder):
    entries = derived.report_entries(scan_by_file(documents(spark, folder), entropy_filter(PROSE_LIMIT)))
    return entries.select(
        "path",
        F.array_join("entry.Lines", "\n").alias("lines"),
        F.array_join("entry.Indexes", ",").alias("indexes"),
        F.array_join("entry.Columns", ",").alias("columns"),
        F.array_join(F.transform("entry.Extracted", lambda evidence: evidence["entropy"]), ",").alias("extracted"),
    )


@query("ignore_list")
def ignore_list(spark, folder):
    return ignorefile.ignore_list(scan(documents(spark, folder), prose_filter()))


@query("merge_ignore_rules")
def merge_ignore_rules(spark, folder):
    table = read_table(spark, folder, "documents").withColumn("path", document_path())
    listed = table.filter(has_hit(F.col("text"), complexity_filter()))
    existing = listed.select(
        F.col("doc_id").alias("line_no"), F.concat(F.lit("  "), F.col("path"), F.lit("\t ")).alias("line")
    )
    flagged = ignorefile.ignore_list(scan(documents(spark, folder), prose_filter()))
    merged = ignorefile.merge_rules(existing, flagged.select(F.col("path").alias("entry")))
    return merged.fillna({"line_no": -1, "entry": ""})


# File predicates


def kept(files: DataFrame, unwanted) -> DataFrame:
    return files.filter(~unwanted).select("path", "size")


@query("exempt_basename")
def exempt_basename(spark, folder):
    return kept(documents(spark, folder), predicates.exempt_by_name(F.col("path")))


@query("exempt_path")
def exempt_path(spark, folder):
    return kept(documents(spark, folder), predicates.exempt_by_path(F.col("path")))


@query("exempt_extended")
def exempt_extended(spark, folder):
    config = ScanConfig().add_exempt(*EXTRA_EXEMPT)
    return kept(documents(spark, folder), predicates.is_exempt(F.col("path"), config.exempt))


@query("ignore_rules")
def ignore_rules(spark, folder):
    return kept(documents(spark, folder), predicates.is_ignored(F.col("path"), IGNORE_LINES))


@query("non_executable")
def non_executable(spark, folder):
    return kept(documents(spark, folder), predicates.is_executable(F.col("mode")))


@query("size_cap")
def size_cap(spark, folder):
    limit = ScanConfig().max_file_size
    return documents(spark, folder).filter(predicates.within_size(F.col("size"), limit)).select("path", "size")


@query("eligible_files")
def eligible_files(spark, folder):
    config = ScanConfig(max_file_size=MAX_SIZE)
    return predicates.eligible(documents(spark, folder), config, IGNORE_LINES).select("path", "size")


@query("scan_eligible")
def scan_eligible(spark, folder):
    """The whole default run: predicates, then the default filter."""
    config = ScanConfig(max_file_size=1 << 20, entropy_limit=PROSE_LIMIT)
    chosen = predicates.eligible(documents(spark, folder), config, IGNORE_LINES)
    return flat(scan(chosen, default_scan(config.entropy_limit)), "entropy")


# Tokenisers


@query("lines")
def file_lines(spark, folder):
    return lines(documents(spark, folder))


@query("fields_per_line")
def fields_per_line(spark, folder):
    rows = lines(documents(spark, folder))
    return rows.select("path", "line_no", F.size(fields(F.col("line"))).alias("n_fields"))


@query("token_totals")
def token_totals(spark, folder):
    return token_counts(documents(spark, folder)).unionByName(token_counts(pages(spark, folder)))


@query("token_scan")
def token_scan(spark, folder):
    return flat(scan(documents(spark, folder), entropy_filter(LOOSE_LIMIT)), "entropy")


@query("long_line_cutoff")
def long_line_cutoff(spark, folder):
    return flat(scan(documents(spark, folder), entropy_filter(LOOSE_LIMIT), line_limit=LINE_LIMIT), "entropy")


@query("literal_scan")
def literal_scan(spark, folder):
    return flat(scan_literals(pages(spark, folder), entropy_filter(PROSE_LIMIT)), "entropy")


@query("unit_scan")
def unit_scan(spark, folder):
    """Comments, strings and words of sources and pages as units."""
    files = documents(spark, folder).unionByName(pages(spark, folder))
    return flat(scan_units(files, prose_filter()), "complexity", "entropy")


@query("language_tag")
def language_tag(spark, folder):
    files = documents(spark, folder).select("path").unionByName(pages(spark, folder).select("path"))
    return with_language(files)


# Functions of a token


@query("entropy_short")
def entropy_short(spark, folder):
    rows = tokens(documents(spark, folder)).select("token").unionByName(tokens(pages(spark, folder)).select("token"))
    short = rows.distinct().filter(F.octet_length("token") < LONG_BYTES)
    return short.select(
        "token",
        entropy_text(short_entropy(F.col("token"))).alias("entropy"),
        entropy_text(standard_entropy(F.col("token"))).alias("standard"),
    )


@query("entropy_long")
def entropy_long(spark, folder):
    long = lines(documents(spark, folder)).filter(F.octet_length("line") >= LONG_BYTES)
    return long.select("path", "line_no", entropy_text(long_entropy(F.col("line"))).alias("entropy"))


@query("token_entropy")
def token_entropy(spark, folder):
    rows = lines(documents(spark, folder)).unionByName(lines(conversations(spark, folder)))
    return rows.select("path", "line_no", entropy_text(entropy(F.col("line"))).alias("entropy"))


@query("entropy_filter")
def entropy_scan(spark, folder):
    return flat(scan(documents(spark, folder), entropy_filter(PROSE_LIMIT)), "entropy")


@query("scan_bytes")
def scan_bytes(spark, folder):
    """Documents as content that is not UTF-8: accented letters have lost the first of their two bytes."""
    table = read_table(spark, folder, "documents")
    cut = F.encode(F.translate(byte_view(F.col("text").cast("binary")), "\xc3", ""), "ISO-8859-1")
    return flat(scan_exact(as_byte_files(table, document_path(), cut), prose_filter()), "complexity", "entropy")


@query("complexity_filter")
def complexity_scan(spark, folder):
    return flat(scan(documents(spark, folder), complexity_filter()), "complexity")


@query("regex_filter")
def regex_scan(spark, folder):
    return flat(scan(documents(spark, folder), regex_filter("sha1", RULES["sha1"])), "sha1")


@query("regex_rules_join")
def regex_rules_join(spark, folder):
    return rule_hits(documents(spark, folder), RULES).unionByName(rule_hits(pages(spark, folder), RULES))


def rule_table(spark, folder):
    """A rule for the first long word of each document, and the fixed rules."""
    word = F.regexp_extract("text", "[A-Za-z]{7,12}", 0)
    worded = read_table(spark, folder, "documents").select(F.concat(F.lit("w"), "doc_id").alias("header"), word.alias("word"))
    worded = worded.filter("word <> ''").select("header", F.concat(F.lit(r"(?i)\b"), "word", F.lit("[a-z]?")).alias("pattern"))
    return worded.unionByName(spark.createDataFrame(list(RULES.items()), "header string, pattern string"))


@query("rules_table_scan")
def rules_table_scan(spark, folder):
    return rule_table_hits(documents(spark, folder), rule_table(spark, folder))


# Filter algebra


@query("any_filters")
def any_filters(spark, folder):
    either = any_of(complexity_filter(), None, entropy_filter(PROSE_LIMIT), regex_filter("email", RULES["email"]))
    return flat(scan(documents(spark, folder), either), "complexity", "entropy", "email")


@query("all_filters")
def all_filters(spark, folder):
    both = all_of(complexity_filter(), entropy_filter(LOOSE_LIMIT), None)
    return flat(scan(documents(spark, folder), both), "complexity", "entropy")


@query("configured_filters")
def configured_scan(spark, folder):
    every = configured_filters(PAGE_RULES, PROSE_LIMIT)
    return flat(scan(pages(spark, folder), every), "attribute", "number", "complexity", "entropy")


@query("default_scan")
def default_filter_scan(spark, folder):
    configured = configured_filters(PAGE_RULES, PAGE_LIMIT)
    effective = default_scan(PAGE_LIMIT, configured)
    return flat(scan(pages(spark, folder), effective), "attribute", "number", "complexity", "entropy")


@query("detect_any_rule")
def detect_any_rule_scan(spark, folder):
    detect = detect_any_rule(RULES, PROSE_LIMIT)
    found = scan(documents(spark, folder), detect).unionByName(scan(conversations(spark, folder), detect))
    return flat(found, "sha1", "email", "aws_key", "complexity", "entropy")


# Results


@query("findings_by_file")
def findings_by_file(spark, folder):
    return flat_hits(scan_by_file(documents(spark, folder), entropy_filter(LOOSE_LIMIT)))


@query("hit_total")
def hit_total(spark, folder):
    return derived.hit_total(scan(documents(spark, folder), prose_filter()))


@query("scan_gate")
def scan_gate(spark, folder):
    wide, narrow = entropy_filter(PROSE_LIMIT), entropy_filter(PAGE_LIMIT)
    return (
        derived.gate(documents(spark, folder), wide)
        .select(F.lit("documents").alias("batch"), "has_findings")
        .unionByName(
            derived.gate(conversations(spark, folder), narrow).select(
                F.lit("conversations").alias("batch"), "has_findings"
            )
        )
    )


@query("admit_batch")
def admit_batch(spark, folder):
    refused = derived.admit_batch(documents(spark, folder), entropy_filter(PROSE_LIMIT))
    admitted = derived.admit_batch(conversations(spark, folder), entropy_filter(PAGE_LIMIT))
    return refused.unionByName(admitted).select("path", "size")


@query("clean_files")
def clean_files(spark, folder):
    return derived.clean_files(documents(spark, folder), prose_filter()).select("path", "size")


@query("quarantined_files")
def quarantined_files(spark, folder):
    return derived.quarantined_files(documents(spark, folder), prose_filter()).select("path", "size")


@query("merge_scans")
def merge_scans(spark, folder):
    english = document_files(read_table(spark, folder, "documents", F.col("lang") == "en"))
    first = scan_by_file(documents(spark, folder), entropy_filter(LOOSE_LIMIT))
    return flat_hits(derived.merge_scans(first, scan_by_file(english, entropy_filter(PROSE_LIMIT))))


@query("report_lines")
def report_lines(spark, folder):
    found = derived.report_lines(scan(documents(spark, folder), prose_filter()))
    return found.orderBy("path", "line_no", "col", "part")


@query("report_meta")
def report_meta(spark, folder):
    return derived.report_meta(scan(documents(spark, folder), prose_filter()), AUTHOR, TIMESTAMP)


# Masking


def secret_lines() -> TokenFilter:
    return any_of(regex_filter("sha1", RULES["sha1"]), regex_filter("email", RULES["email"]))


@query("mask_lines")
def mask_lines(spark, folder):
    masked = masking.mask_lines(documents(spark, folder), secret_lines())
    return masked.select("path", F.size("vault").alias("n_masked"), "text")


@query("mask_reported")
def mask_reported(spark, folder):
    files = documents(spark, folder)
    stored = scratch_dir(spark, "reported")
    scan_by_file(files, entropy_filter(PROSE_LIMIT)).write.parquet(stored)
    return masking.mask_reported(files, spark.read.parquet(stored)).select("path", "text")


@query("restore_lines")
def restore_lines(spark, folder):
    masked = masking.mask_lines(documents(spark, folder), secret_lines())
    stored = scratch_dir(spark, "vault")
    masking.vault_rows(masked).write.parquet(stored)
    return masking.restore_lines(masked, spark.read.parquet(stored)).select("path", "text")


# Other corpora and streams


@query("scan_pages")
def scan_pages(spark, folder):
    return flat(scan(pages(spark, folder), any_of(complexity_filter(), entropy_filter(PAGE_LIMIT))), "complexity", "entropy")


@query("scan_conversations")
def scan_conversations(spark, folder):
    return flat(scan(conversations(spark, folder), entropy_filter(LOOSE_LIMIT)), "entropy")


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    table = f"{folder}/documents.parquet"
    return document_files(stream_table(spark, table, spark.read.parquet(table).schema))


@query("stream_scan")
def stream_scan(spark, folder):
    run = scratch_dir(spark, "stream-scan")
    started = start_scan(
        document_stream(spark, folder), entropy_filter(LOOSE_LIMIT), f"{run}/found", f"{run}/checkpoint"
    )
    started.awaitTermination()
    return flat(spark.read.schema(FINDINGS).parquet(f"{run}/found"), "entropy")


@query("stream_folder_scan")
def stream_folder_scan(spark, folder):
    """Documents as files of a tree, watched as a stream."""
    run = scratch_dir(spark, "stream-folder")
    watched = stream_tree(spark, document_tree(spark, folder), settle=0)
    start_scan(watched, entropy_filter(LOOSE_LIMIT), f"{run}/found", f"{run}/checkpoint").awaitTermination()
    return flat(spark.read.schema(FINDINGS).parquet(f"{run}/found"), "entropy")


@query("stream_gate")
def stream_gate(spark, folder):
    run = scratch_dir(spark, "stream-gate")
    started = start_gate(document_stream(spark, folder), prose_filter(), f"{run}/routed", f"{run}/checkpoint")
    started.awaitTermination()
    routed = T.StructType([*FILES.fields, T.StructField("verdict", T.StringType())])
    return spark.read.schema(routed).parquet(f"{run}/routed").select("path", "size", "verdict")


@query("stream_batch_gate")
def stream_batch_gate(spark, folder):
    """Batches of two streams: documents, of which some have hits, and conversations, of which none has."""
    table = f"{folder}/conversations.parquet"
    chats = conversation_files(stream_table(spark, table, spark.read.parquet(table).schema))
    parts = []
    for files, wanted in ((document_stream(spark, folder), prose_filter()), (chats, entropy_filter(PAGE_LIMIT))):
        run = scratch_dir(spark, "stream-batch-gate")
        start_batch_gate(files, wanted, f"{run}/gated", f"{run}/checkpoint").awaitTermination()
        parts.append(batch_files(spark, f"{run}/gated", files.schema).select("path", "size", "flagged", "verdict"))
    return parts[0].unionByName(parts[1])
