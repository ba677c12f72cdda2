from leaksieve.functions.complexity import class_count
from leaksieve.functions.entropy import entropy, entropy_text, long_entropy, short_entropy
from leaksieve.functions.globs import compile_ignore_rules, ignored_by
from leaksieve.functions.regexes import check_pattern, to_java_regex
from leaksieve.functions.text import fields, fields_from, split_lines

__all__ = [
    "check_pattern",
    "class_count",
    "compile_ignore_rules",
    "entropy",
    "entropy_text",
    "fields",
    "fields_from",
    "ignored_by",
    "long_entropy",
    "short_entropy",
    "split_lines",
    "to_java_regex",
]
