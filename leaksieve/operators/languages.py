"""Language tags from file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File extension and grammar name.
EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".cs": "c-sharp",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".swift": "swift",
    ".m": "objc",
    ".mm": "objc",
    ".rb": "ruby",
    ".php": "php",
    ".php3": "php",
    ".php4": "php",
    ".php5": "php",
    ".phps": "php",
    ".lua": "lua",
    ".json": "json",
    ".json5": "json5",
    ".jsonnet": "jsonnet",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".ini": "ini",
    ".xml": "xml",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".less": "less",
    ".sql": "sql",
    ".graphql": "graphql",
    ".gql": "graphql",
    ".md": "markdown",
    ".markdown": "markdown",
    ".mdx": "markdown",
    ".dockerfile": "dockerfile",
    ".sh": "bash",
    ".bash": "bash",
    ".zsh": "bash",
    ".fish": "fish",
    ".nix": "nix",
    ".dhall": "dhall",
    ".hcl": "hcl",
    ".tf": "hcl",
    ".cue": "cue",
    ".edn": "clojure",
    ".clj": "clojure",
    ".cljs": "clojure",
    ".cljc": "clojure",
    ".scala": "scala",
    ".sc": "scala",
    ".ml": "ocaml",
    ".mli": "ocaml-interface",
    ".re": "rescript",
    ".rei": "rescript",
    ".svelte": "svelte",
    ".vue": "vue",
    ".astro": "astro",
    ".pug": "pug",
    ".erb": "eex",
    ".eex": "eex",
    ".heex": "heex",
    ".jinja2": "jinja2",
    ".twig": "twig",
    ".mustache": "embedded-template",
    ".hbs": "embedded-template",
    ".org": "org",
    ".bib": "bibtex",
    ".latex": "latex",
    ".tex": "latex",
    ".jl": "julia",
    ".r": "r",
    ".mat": "matlab",
    ".hs": "haskell",
    ".lhs": "haskell",
    ".elm": "elm",
    ".erlang": "erlang",
    ".ex": "elixir",
    ".exs": "elixir",
    ".janet": "janet-simple",
    ".zig": "zig",
    ".odin": "odin",
    ".nim": "nim",
    ".vala": "vala",
    ".v": "v",
    ".vhdl": "vhdl",
    ".sv": "verilog",
    ".svh": "verilog",
    ".proto": "proto",
    ".thrift": "thrift",
    ".capnp": "capnp",
    ".wasm": "wat",
    ".wast": "wast",
    ".wgsl": "wgsl",
    ".wit": "wit",
    ".ron": "ron",
    ".rego": "rego",
    ".prisma": "prisma",
    ".tla": "tlaplus",
    ".typ": "typst",
    ".csv": "csv",
    ".tsv": "csv",
}


def languages(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{ext}', '{language}')" for ext, language in EXTENSIONS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known(ext, language)")


def with_language(files: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Add ``language``, null if the extension is unknown.

    The table is fixed and small, hence the broadcast. ``extra`` may add rows of
    the same shape; its size is not known here, so then the choice is Spark's.
    """
    known = languages(files.sparkSession)
    side = F.broadcast(known) if extra is None else known.unionByName(extra)
    extension = F.regexp_extract("path", r"(\.[^./]*)\z", 1)
    return files.withColumn("ext", extension).join(side, "ext", "left").drop("ext")
