"""Lexers of grammar families as one pattern each, whose pieces tile a text.

Every position of a text belongs to one piece: a comment, a string, a word, a run of white space or a
single other character, whichever a family's pattern finds first. What opens inside a
comment or string is part of it, so the pieces are what a lexical state machine would yield; comments,
heredocs and raw strings that nothing closes go to the end of the text. Repeats
are possessive: a text is read once, without going back over repeats and without recursion. Nesting is unrolled to ``DEPTH`` levels;
what nests deeper is cut where the inner levels fail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of nested comments, and of templates inside templates.
DEPTH = 12

_WORD = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]++"
_SPACE = r"[ \t\r\n\f\x0B]++"


def _quoted(quote: str, lines: bool, escapes: bool = True) -> str:
    """A string up to its closing quote; within one line unless ``lines``."""
    stop = quote + ("" if lines else r"\n")
    return rf"{quote}(?:[^{stop}\\]++|\\.)*+{quote}" if escapes else rf"{quote}[^{stop}]*+{quote}"


def _tripled(quote: str) -> str:
    return rf"{quote * 3}(?:[^{quote}\\]++|\\.|{quote}(?!{quote * 2}))*+{quote * 3}"


def _nested(begin: str, end: str) -> str:
    found = rf"{begin}(?:(?!{begin}|{end}).)*+(?:{end}|\z)"
    for _ in range(DEPTH - 1):
        found = rf"{begin}(?:(?!{begin}|{end}).|{found})*+(?:{end}|\z)"
    return found


def _template() -> str:
    found = r"`(?:[^`\\$]++|\\.|\$)*+`"
    for _ in range(DEPTH - 1):
        found = rf"`(?:[^`\\$]++|\\.|\$\{{(?:[^`{{}}]++|\{{[^`{{}}]*+\}}|{found})*+\}}|\$(?!\{{))*+`"
    return found


def _long_bracket(name: str) -> str:
    return rf"\[(?<{name}>=*+)\[(?:[^\]]++|\](?!\k<{name}>\]))*+(?:\]\k<{name}>\]|\z)"


_HEREDOC = r"""<<[-~]?+(?<quote>["']?+)(?<tag>[A-Za-z_][0-9A-Za-z_]*+)\k<quote>[^\n]*+\n(?:(?![ \t]*+\k<tag>(?:\n|\z))[^\n]*+\n)*+(?:[ \t]*+\k<tag>(?=\n|\z)|[^\n]*+\z)"""
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
_SLASHES, _HASH, _DASHES = r"//[^\n]*+", r"(?<!\S)#[^\n]*+", r"--[^\n]*+"
_DOUBLE, _SINGLE = _quoted('"', False), _quoted("'", False)


@dataclass(frozen=True)
class Family:
    languages: tuple[str, ...]
    comments: tuple[str, ...]
    strings: tuple[str, ...]

    def pattern(self) -> str:
        return "(?s)" + "|".join((*self.comments, *self.strings, _WORD, _SPACE, "."))

    def is_comment(self, piece: Column) -> Column:
        return piece.rlike(r"(?s)\A(?:" + "|".join(self.comments) + r")\z")


#: Regular expressions as literals of a language are not known apart from division.
FAMILIES = {
    "c": Family(
        ("c", "cpp", "c-sharp", "java", "objc", "php", "css", "scss", "less", "proto", "thrift", "vala", "odin", "zig", "capnp", "prisma"),
        (_SLASHES, _BLOCK),
        (r'R"(?<tag>[^()\\ ]{0,16}+)\((?:[^)]++|\)(?!\k<tag>"))*+(?:\)\k<tag>"|\z)', _DOUBLE, _SINGLE),
    ),
    "go": Family(("go",), (_SLASHES, _BLOCK), (_DOUBLE, _SINGLE, _quoted("`", True, escapes=False))),
    "script": Family(("javascript", "typescript", "tsx", "astro"), (_SLASHES, _BLOCK), (_DOUBLE, _SINGLE, _template())),
    "nested": Family(
        ("rust", "swift", "kotlin", "scala"),
        (_SLASHES, _nested(r"/\*", r"\*/")),
        (r'b?+r(?<hash>#*+)"(?:[^"]++|"(?!\k<hash>))*+(?:"\k<hash>|\z)', _tripled('"'), _quoted('"', True), r"'(?:[^'\\\n]|\\[^\n']{1,10}+|\\')'"),
    ),
    "python": Family(("python",), (r"#[^\n]*+",), tuple(f"[A-Za-z]{{0,2}}{s}" for s in (_tripled('"'), _tripled("'"), _DOUBLE, _SINGLE))),
    "shell": Family(("bash", "fish"), (_HASH,), (_HEREDOC, _quoted('"', True), _quoted("'", True, escapes=False))),
    "ruby": Family(
        ("ruby", "elixir"),
        (r"(?<![^\n])=begin\b(?:(?!\n=end\b).)*+(?:\n=end\b|\z)", r"#(?!\{)[^\n]*+"),
        (_HEREDOC, _tripled('"'), _quoted('"', True), _quoted("'", True)),
    ),
    "hash": Family(("toml", "yaml", "dockerfile", "r", "julia", "hcl", "nix", "graphql"), (_HASH,), (_tripled('"'), _tripled("'"), _DOUBLE, _SINGLE)),
    "sql": Family(("sql", "vhdl"), (_DASHES, _BLOCK), (r"'(?:[^']++|'')*+'", r'"(?:[^"]++|"")*+"')),
    "lua": Family(("lua",), ("--" + _long_bracket("mark"), _DASHES), (_long_bracket("level"), _DOUBLE, _SINGLE)),
    "haskell": Family(("haskell", "elm"), (_DASHES, _nested(r"\{-", r"-\}")), (_quoted('"', True),)),
    "markup": Family(("html", "xml", "vue", "svelte"), (r"<!--(?:[^-]++|-(?!->))*+(?:-->|\z)",), (r'=[ \t\r\n]*+"[^"]*+"', r"=[ \t\r\n]*+'[^']*+'", ">[^<]++")),
}

_BEFORE = r"(?s)\A(?:(?:[A-Za-z]{0,2}|=[ \t\r\n]*+)"
_OPENING = _BEFORE + r"""(["'`])|>)"""
_OPENING_THREE = _BEFORE + r"""("{3}(?=.*"{3}\z)|'{3}(?=.*'{3}\z)|["'`])|>)"""
_WITH_THREE = [name for name, family in FAMILIES.items() if any('"""' in s for s in family.strings)]


def family_of(language: Column) -> Column:
    """The family of a language, null if it has none."""
    found = F.lit(None).cast("string")
    for name, family in FAMILIES.items():
        found = F.when(language.isin(*family.languages), name).otherwise(found)
    return found


def pieces(text: Column, family: Column) -> Column:
    """The pieces that tile a text."""
    cut = F.lit(None).cast("array<string>")
    for name, each in FAMILIES.items():
        cut = F.when(family == name, F.regexp_extract_all(text, F.lit(each.pattern()), F.lit(0))).otherwise(cut)
    return cut


def kind(piece: Column, family: Column) -> Column:
    """``word``, ``string`` or ``comment``; null for white space and for single other characters, such as a comment sign by itself."""
    comment = F.lit(False)
    for name, each in FAMILIES.items():
        comment = F.when(family == name, each.is_comment(piece)).otherwise(comment)
    return (
        F.when(piece.rlike(rf"\A{_WORD}\z"), "word")
        .when((F.char_length(piece) < 2) | piece.rlike(rf"\A{_SPACE}\z"), F.lit(None))
        .when(comment, "comment")
        .otherwise("string")
    )


def _opened(piece: Column, family: Column, group: int) -> Column:
    three = F.regexp_extract(piece, _OPENING_THREE, group)
    return F.when((family == "c") & piece.startswith('R"'), "").when(family.isin(_WITH_THREE), three).otherwise(F.regexp_extract(piece, _OPENING, group))


def opening(piece: Column, family: Column) -> Column:
    """What opens a quoted string, letters before the quote included; empty for raw strings, heredocs and the like, which are kept whole."""
    return _opened(piece, family, 0)


def content(piece: Column, family: Column) -> Column:
    """A string without its quotes."""
    begin = F.char_length(opening(piece, family))
    end = F.char_length(_opened(piece, family, 1))
    return F.substring(piece, begin + 1, F.char_length(piece) - begin - end)
