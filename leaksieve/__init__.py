"""Finding leaked secrets in large collections of text with Spark."""

from leaksieve.model import ScanConfig
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
from leaksieve.operators.scan import scan, scan_by_file, scan_paths

__all__ = [
    "ScanConfig",
    "TokenFilter",
    "all_of",
    "any_of",
    "complexity_filter",
    "configured_filters",
    "default_scan",
    "detect_any_rule",
    "entropy_filter",
    "regex_filter",
    "scan",
    "scan_by_file",
    "scan_paths",
]
