"""Shannon entropy of a string, as native expressions.

Three notions are offered. ``short_entropy`` counts code points but divides by
the *byte* length, ``long_entropy`` counts bytes, and ``entropy`` picks the
second from 256 bytes on. For ASCII they agree with the textbook value.

With R symbols in n units, and a count c per distinct symbol,

    -sum(c/n * log2(c/n)) = R/n * log2(n) - sum(c * log2(c)) / n

where symbols that occur once add nothing to the last sum. So it is enough to
sort the symbols and look at runs of two or more: one native sort and one
pattern pass, and a lambda only for the repeated symbols.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_BYTES = 256

_REPEATED = r"(?s)(.)\1+"


def entropy_of_symbols(symbols: Column, units: Column) -> Column:
    """Entropy of the characters of ``symbols``, each weighing one of ``units``."""
    n = units.cast("double")
    ordered = F.array_join(F.sort_array(F.split(symbols, "")), "")
    repeats = F.regexp_extract_all(ordered, F.lit(_REPEATED), F.lit(0))
    weight = F.aggregate(
        repeats,
        F.lit(0.0),
        lambda total, run: total + F.length(run) * F.log2(F.length(run).cast("double")),
    )
    return F.when(symbols == "", F.lit(0.0)).otherwise(F.length(symbols) / n * F.log2(n) - weight / n)


def short_entropy(token: Column) -> Column:
    return entropy_of_symbols(token, F.octet_length(token))


def standard_entropy(token: Column) -> Column:
    """The textbook value over code points."""
    return entropy_of_symbols(token, F.char_length(token))


def long_entropy(token: Column) -> Column:
    # Latin-1 maps every byte to one character, which turns bytes into symbols.
    return entropy_of_symbols(F.decode(token.cast("binary"), "ISO-8859-1"), F.octet_length(token))


def entropy(token: Column, mode: str = "compat") -> Column:
    if mode == "standard":
        return standard_entropy(token)
    if mode != "compat":
        raise ValueError(f"unknown entropy mode: {mode!r}")
    return F.when(F.octet_length(token) < LONG_BYTES, short_entropy(token)).otherwise(long_entropy(token))


def entropy_text(value: Column) -> Column:
    """Four decimals as C's ``printf`` has them: the double itself is rounded, exact ties to even. Nine decimals first, so that float noise makes no tie.

    ``bround`` and ``format_string`` round the shortest decimal that reads as the double: 4.12355 is a tie to them, where the double lies below.
    """

    def text(nine: Column) -> Column:
        # Ten-thousandths below, and on which side of the middle (2 * below + 1) / 20000 the double lies: its halves
        # are exact when multiplied by 625, and so is what is left of them.
        below = F.floor(nine * 10000)
        high = nine.cast("float").cast("double")
        over = (high * 625 - (below * 2 + 1) / F.lit(32.0)) + (nine - high) * 625
        steps = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
        return F.format_string("%d.%04d", F.floor(steps / 10000), steps % 10000)

    return F.element_at(F.transform(F.array(F.round(value, 9)), text), 1)
