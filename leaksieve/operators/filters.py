"""Token filters and their algebra.

A filter pairs a predicate with the evidence it attaches to a hit. Both are
functions from a token column to native columns, so a composed filter is one
expression tree inside one ``filter``; evidence is computed for hits only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaksieve.functions.complexity import MIN_BYTES, MIN_CLASSES, class_count
from leaksieve.functions.entropy import (
    LONG_BYTES,
    entropy,
    entropy_text,
    long_entropy,
    short_entropy,
    standard_entropy,
)
from leaksieve.functions.regexes import check_pattern, check_patterns, relaxed_regex
from leaksieve.functions.text import fields_from
from leaksieve.functions.views import byte_entropy, rune_text

Evidence = dict[str, Column]

# Least length of tokens that the field pattern asks for at most.
MOST_REPEATS = 1000


@dataclass(frozen=True)
class TokenFilter:
    """``match(token)`` is a boolean column and ``evidence(token)`` maps keys to text columns.

    A null evidence value means the key is absent. No token with fewer than
    ``min_chars`` code points can match. ``text_test`` says whether some token
    of a whole text matches; without it the tokens are asked one by one.
    ``on_view`` is the same filter for tokens that are byte views (see ``functions.views``).
    """

    match: Callable[[Column], Column]
    evidence: Callable[[Column], Evidence]
    min_chars: int = 0
    text_test: Callable[[Column], Column] | None = None
    on_view: TokenFilter | None = None

    def in_text(self, text: Column) -> Column:
        return self.text_test(text) if self.text_test else self.in_tokens(text)

    def in_tokens(self, text: Column) -> Column:
        return F.exists(fields_from(text, self.min_chars), self.match)


def _least_symbols(threshold: float) -> int:
    """A lower bound on the code points, and on the distinct ones, of a token above ``threshold``.

    R symbols of which k are distinct carry at most log2(k) bits each. Dividing
    by the byte count n >= R instead of R can only lower that once k >= 3; with
    k <= 2 the value stays below 1.0615.
    """
    if threshold < 0:
        return 0
    return 1 if threshold < 1.1 else math.ceil(2**threshold - 1e-9)


def entropy_filter(threshold: float, mode: str = "compat") -> TokenFilter:
    """Tokens whose entropy is strictly above ``threshold``."""
    least = _least_symbols(threshold)
    # Values equal to nine decimals count as ties, and a tie is not above.
    limit = threshold + 5e-10

    def match(token: Column) -> Column:
        distinct_enough = F.size(F.array_distinct(F.split(token, ""))) >= F.lit(least)
        if mode == "standard":
            return (F.char_length(token) >= least) & distinct_enough & (standard_entropy(token) > limit)
        if mode != "compat":
            raise ValueError(f"unknown entropy mode: {mode!r}")
        exact = F.when(
            F.octet_length(token) < LONG_BYTES,
            distinct_enough & (short_entropy(token) > limit),
        ).otherwise(long_entropy(token) > limit)
        return (F.char_length(token) >= min_chars) & exact

    # From 256 bytes on bytes are counted, and such a token has 64 code points at least.
    # A repeat count in a pattern is bounded; the exact test stands behind it.
    min_chars = min(least, MOST_REPEATS if mode == "standard" else LONG_BYTES // 4)
    on_view = TokenFilter(
        lambda view: (F.char_length(view) >= min_chars) & (byte_entropy(view, mode) > limit),
        lambda view: {"entropy": entropy_text(byte_entropy(view, mode))},
        min_chars,
    )
    return TokenFilter(match, lambda token: {"entropy": entropy_text(entropy(token, mode))}, min_chars, on_view=on_view)


def complexity_filter() -> TokenFilter:
    """Tokens of 15 bytes or more that mix at least three character classes."""
    return TokenFilter(
        lambda token: (F.octet_length(token) >= MIN_BYTES) & (class_count(token) >= MIN_CLASSES),
        lambda token: {"complexity": class_count(token).cast("string")},
        math.ceil(MIN_BYTES / 4),
        on_view=TokenFilter(
            lambda view: (F.char_length(view) >= MIN_BYTES) & (class_count(view) >= MIN_CLASSES),
            lambda view: {"complexity": class_count(view).cast("string")},
            MIN_BYTES,
        ),
    )


def regex_filter(header: str, pattern: str) -> TokenFilter:
    """Tokens with an unanchored match; the evidence is the leftmost matched text."""
    java = check_pattern(pattern)
    plain = TokenFilter(
        lambda token: token.rlike(java),
        lambda token: {header: F.regexp_extract(token, java, 0)},
        on_view=TokenFilter(lambda view: rune_text(view).rlike(java), lambda view: {header: F.regexp_extract(rune_text(view), java, 0)}),
    )
    relaxed = relaxed_regex(pattern)
    if relaxed is None:
        return plain
    # One pass over the text rules most files out before their tokens are asked.
    return replace(plain, text_test=lambda text: text.rlike(relaxed) & plain.in_tokens(text))


def _merge(earlier: Evidence, later: Mapping[str, Column]) -> Evidence:
    merged = dict(earlier)
    for key, value in later.items():
        merged[key] = F.coalesce(value, merged[key]) if key in merged else value
    return merged


def _on_views(combine, members: list[TokenFilter]) -> TokenFilter | None:
    """The same combination of the members for byte views, if every member has one."""
    views = [member.on_view for member in members]
    return combine(*views) if members and all(views) else None


def any_of(*members: TokenFilter | None) -> TokenFilter:
    """Matches if a member does; evidence of all matching members, the later one winning a key."""
    present = [member for member in members if member is not None]

    def evidence(token: Column) -> Evidence:
        merged: Evidence = {}
        for member in present:
            hit = member.match(token)
            merged = _merge(merged, {key: F.when(hit, value) for key, value in member.evidence(token).items()})
        return merged

    def in_text(text: Column) -> Column:
        # Members with a cheap test of whole texts are asked one by one; all others share one pass over the tokens.
        tested = [member for member in present if member.text_test]
        rest = [member for member in present if not member.text_test]
        parts = [member.in_text(text) for member in tested]
        if rest:
            shortest = min(member.min_chars for member in rest)
            parts.append(F.exists(fields_from(text, shortest), lambda t: reduce(or_, (m.match(t) for m in rest))))
        return reduce(or_, parts, F.lit(False))

    return TokenFilter(
        lambda token: reduce(or_, (member.match(token) for member in present), F.lit(False)),
        evidence,
        min((member.min_chars for member in present), default=0),
        in_text,
        _on_views(any_of, present),
    )


def all_of(*members: TokenFilter | None) -> TokenFilter:
    """Matches if every member does; with no members it matches everything, without evidence."""
    present = [member for member in members if member is not None]
    plain = TokenFilter(
        lambda token: reduce(and_, (member.match(token) for member in present), F.lit(True)),
        lambda token: reduce(_merge, (member.evidence(token) for member in present), {}),
        max((member.min_chars for member in present), default=0),
        on_view=_on_views(all_of, present),
    )
    tested = [member for member in present if member.text_test]
    if len(present) < 2 or not tested:
        return plain
    # What can be told of a whole text is asked before its tokens are.
    return replace(
        plain, text_test=lambda text: reduce(and_, (m.in_text(text) for m in tested)) & plain.in_tokens(text)
    )


def regex_filters(rules: Mapping[str, str]) -> list[TokenFilter]:
    check_patterns(rules.values())
    return [regex_filter(header, pattern) for header, pattern in rules.items()]


def configured_filters(rules: Mapping[str, str], entropy_limit: float, mode: str = "compat") -> TokenFilter:
    """Every rule, complexity and entropy on the same token."""
    return all_of(*regex_filters(rules), complexity_filter(), entropy_filter(entropy_limit, mode))


def default_scan(entropy_limit: float, configured: TokenFilter | None = None, mode: str = "compat") -> TokenFilter:
    """The effective filter of a plain scan: the configured one, if any, or entropy alone."""
    return any_of(configured, entropy_filter(entropy_limit, mode))


def detect_any_rule(rules: Mapping[str, str], entropy_limit: float) -> TokenFilter:
    """Any rule by itself, or a token that is both complex and of high entropy."""
    return any_of(*regex_filters(rules), all_of(complexity_filter(), entropy_filter(entropy_limit)))


def payload(evidence: Evidence) -> Column:
    """Evidence as one map without the absent keys."""
    if not evidence:
        return F.create_map().cast("map<string,string>")
    entries = F.array(*(F.struct(F.lit(key).alias("k"), value.alias("v")) for key, value in evidence.items()))
    return F.map_from_entries(F.filter(entries, lambda entry: entry.v.isNotNull()))
