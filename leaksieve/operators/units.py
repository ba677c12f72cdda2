"""Scanning lexical units: whole comments and strings, over any number of lines, and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions import lexers
from leaksieve.operators.filters import TokenFilter, payload
from leaksieve.operators.languages import with_language
from leaksieve.operators.scan import one_row_per_file


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


_HIT = "struct<line_no:int,byte_col:int,kind:string,token:string,payload:map<string,string>>"
#: Pieces whose hits are gathered in one array before they join those of the pieces ahead.
BLOCK = 1000


def _placed(marked: Column, hit) -> Column:
    """``hit(piece, line_no, byte_col)`` of the marked pieces, in order, with the row and the bytes of the row ahead of each: one pass over a text's pieces."""

    def step(state: Column, each: Column) -> Column:
        piece = each.piece
        found = F.concat(state.found, F.array(hit(piece, state.line_no, state.byte_col).cast(_HIT)))
        broken = F.contains(piece, F.lit("\n"))
        rows = F.char_length(piece) - F.char_length(F.replace(piece, F.lit("\n")))
        return F.struct(
            F.when(broken, state.line_no + rows).otherwise(state.line_no).alias("line_no"),
            F.when(broken, F.octet_length(F.substring_index(piece, "\n", -1))).otherwise(state.byte_col + F.octet_length(piece)).alias("byte_col"),
            F.when(each.hit, found).otherwise(state.found).alias("found"),
        )

    def block(state: Column, each: Column) -> Column:
        none = F.array().cast(f"array<{_HIT}>").alias("found")
        inner = F.aggregate(each, F.struct(state.line_no.alias("line_no"), state.byte_col.alias("byte_col"), none), step)
        return _let(inner, lambda s: F.struct(s.line_no.alias("line_no"), s.byte_col.alias("byte_col"), F.concat(state.found, F.array(s.found)).alias("found")))

    numbers = F.sequence(F.lit(0), F.floor((F.size(marked) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda n: F.slice(marked, n * BLOCK + 1, BLOCK))
    start = F.struct(F.lit(1).alias("line_no"), F.lit(0).alias("byte_col"), F.array().cast(f"array<array<{_HIT}>>").alias("found"))
    return F.aggregate(blocks, start, block, lambda state: F.flatten(state.found))


def scan_units(files: DataFrame, token_filter: TokenFilter, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Findings in lexical units of files in a language of a known family: ``language, line_no, byte_col, kind, token, payload``.

    A unit is filtered as a whole, white space included. Strings are without their quotes, and their place is that of
    the first byte inside; raw strings and heredocs keep what delimits them. Places are counted in one pass
    over the pieces of a file with hits. A file is one row in one task; null texts have no units.
    """
    one_row_per_file(files)
    known = with_language(files).withColumn("family", lexers.family_of(F.col("language"))).filter("family is not null")
    family = F.col("family")

    def text_of(piece: Column, unit: Column) -> Column:
        return F.when(unit == "string", lexers.content(piece, family)).otherwise(piece)

    def wanted(piece: Column) -> Column:
        def matches(unit: Column) -> Column:
            return unit.isNotNull() & _let(text_of(piece, unit), token_filter.match)

        asked = F.when(F.char_length(piece) >= token_filter.min_chars, _let(lexers.kind(piece, family), matches))
        return F.coalesce(asked, F.lit(False))

    def hit(piece: Column, line_no: Column, ahead: Column) -> Column:
        def located(unit: Column) -> Column:
            begin = F.when(unit == "string", F.octet_length(lexers.opening(piece, family))).otherwise(0)

            def row(text: Column) -> Column:
                return F.struct(line_no, (ahead + begin + 1).cast("int"), unit, text, payload(token_filter.evidence(text)))

            return _let(text_of(piece, unit), row)

        return _let(lexers.kind(piece, family), located)

    def hits(cut: Column) -> Column:
        marked = F.transform(cut, lambda piece: F.struct(piece.alias("piece"), wanted(piece).alias("hit")))
        return _let(marked, lambda m: F.when(F.exists(m, lambda each: each.hit), _placed(m, hit)))

    return known.select(*keep, "language", F.inline(_let(lexers.pieces(F.col("text"), family), hits)))
