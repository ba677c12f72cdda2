"""Ignore rules (the public gitignore glob language) as native predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLOB = re.compile(r"(?P<inner>/\*\*/)|(?P<lead>\A\*\*/)|(?P<tail>/\*\*\Z)|\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|.", re.DOTALL)


def _glob_to_regex(glob: str) -> str:
    def piece(match: re.Match) -> str:
        text = match[0]
        if match["inner"]:
            return "/(?:.*/)?"
        if match["lead"]:
            return "(?:.*/)?"
        if match["tail"]:
            return "/.*"
        if text[0] == "*":
            return "[^/]*"
        if text == "?":
            return "[^/]"
        if text[0] == "[" and len(text) > 1:
            negated = text[1] in "!^"
            body = text[2 if negated else 1:-1]
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body)
            return "(?!/)[" + ("^" if negated else "") + body + "]"
        return re.escape(text[-1])

    return _GLOB.sub(piece, glob)


def compile_ignore_rules(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """``(regex, negated)`` per rule, in file order, for paths relative to the root."""
    rules = []
    for raw in lines:
        line = re.sub(r"(?<!\\) +\Z", "", raw.rstrip("\r\n"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        if negated:
            line = line[1:]
        folder_only = line.endswith("/")
        line = line.rstrip("/") if folder_only else line
        if not line:
            continue
        anchored = "/" in line
        body = _glob_to_regex(line.removeprefix("/"))
        head = "" if anchored else "(?:.*/)?"
        tail = "/.*" if folder_only else "(?:/.*)?"
        rules.append((rf"(?s)\A{head}{body}{tail}\z", negated))
    return rules


def ignored_by(path: Column, rules: Iterable[tuple[str, bool]]) -> Column:
    """True where the last rule that matches ``path`` is not negated.

    Rules come from one ignore file, so they fold into a single CASE: neighbours
    of the same sign become one alternation and the last group is asked first.
    No join and no shuffle, whatever the number of paths.
    """
    verdict = None
    groups = [(sign, [regex for regex, _ in run]) for sign, run in groupby(rules, key=lambda rule: rule[1])]
    for negated, regexes in reversed(groups):
        hit = path.rlike("|".join(f"(?:{regex})" for regex in regexes))
        verdict = F.when(hit, F.lit(not negated)) if verdict is None else verdict.when(hit, F.lit(not negated))
    return F.lit(False) if verdict is None else verdict.otherwise(F.lit(False))
