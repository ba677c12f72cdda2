"""Relations and settings shared by all operators."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

PAYLOAD = T.MapType(T.StringType(), T.StringType())

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("mtime", T.TimestampType()),
])

FILES = T.StructType([*MANIFEST.fields, T.StructField("text", T.StringType())])

FINDINGS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("token", T.StringType()),
    T.StructField("payload", PAYLOAD),
])

# One file's entry and the whole report document; the field names are the fixed file format.
CODE_LINES = T.StructType([
    T.StructField("Lines", T.ArrayType(T.StringType())),
    T.StructField("Indexes", T.ArrayType(T.IntegerType())),
    T.StructField("Columns", T.ArrayType(T.IntegerType())),
    T.StructField("Extracted", T.ArrayType(PAYLOAD)),
])
REPORT_META = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("freq", T.LongType()),
])
REPORT_DOCUMENT = T.StructType([
    T.StructField("meta", REPORT_META),
    T.StructField("data", T.MapType(T.StringType(), CODE_LINES)),
])

DEFAULT_ENTROPY_LIMIT = 4.5
# The size cap of the settings format: far below most files. ``None`` in its place means no cap.
COMPAT_MAX_FILE_SIZE = 500
DEFAULT_MAX_FILE_SIZE = COMPAT_MAX_FILE_SIZE

REPORT_NAME = ".leaksieve.json"

# Names exempt from scanning by default.
DEFAULT_EXEMPT = (
    "uv.lock",
    "pyproject.toml",
    "pnpm-lock.yaml",
    "package-lock.json",
    "yarn.lock",
    "go.sum",
    "deno.lock",
    "Cargo.lock",
    ".gitignore",
    ".python-version",
    "LICENSE",
    REPORT_NAME,
    ".git/",
    "leaksieve/",
)


@dataclass(frozen=True)
class ScanConfig:
    """Effective settings of a scan.

    ``max_file_size`` is in bytes, ``None`` for no cap; the default is that of the settings
    format, and ``left_out`` counts the files it keeps from a scan. ``entropy_mode``
    is ``compat`` or ``standard`` (see ``entropy_filter``).
    """

    entropy_limit: float = DEFAULT_ENTROPY_LIMIT
    max_file_size: int | None = DEFAULT_MAX_FILE_SIZE
    logging: bool = True
    use_gitignore: bool = True
    changed_only: bool = False
    target_regex: dict[str, str] = field(default_factory=dict)
    exempt: tuple[str, ...] = DEFAULT_EXEMPT
    entropy_mode: str = "compat"

    def __post_init__(self) -> None:
        if self.max_file_size is not None and self.max_file_size <= 0:
            object.__setattr__(self, "max_file_size", DEFAULT_MAX_FILE_SIZE)

    def add_exempt(self, *names: str) -> "ScanConfig":
        return replace(self, exempt=tuple(dict.fromkeys((*self.exempt, *names))))

    def with_settings(self, doc: dict[str, Any]) -> "ScanConfig":
        """Apply a decoded settings document over these values.

        The document wins over values given before. ``use_gitignore`` is taken
        as written, false when absent; the other switches can only turn on, and
        limits that are not positive are ignored.
        """
        rules = doc.get("filter", {})
        changes: dict[str, Any] = {"use_gitignore": bool(doc.get("use_gitignore", False))}
        if doc.get("logging"):
            changes["logging"] = True
        if doc.get("use_gitdiff"):
            changes["changed_only"] = True
        if rules.get("ent_limit", 0) > 0:
            changes["entropy_limit"] = float(rules["ent_limit"])
        if rules.get("max_file_size", 0) > 0:
            changes["max_file_size"] = int(rules["max_file_size"])
        if rules.get("target_regex"):
            changes["target_regex"] = dict(rules["target_regex"])
        return replace(self, **changes)

    @classmethod
    def load(cls, path: str | Path, **flags: Any) -> "ScanConfig":
        """Settings from ``flags``, then from the TOML file; a missing file raises."""
        with open(path, "rb") as handle:
            return cls(**flags).with_settings(tomllib.load(handle))
