"""Content that is not UTF-8, as a view with one character for each byte.

The view is the ISO-8859-1 reading of the bytes, so nothing is lost and native expressions apply. Read as
runes, a byte that begins no well-formed sequence is one replacement character by itself; lengths are counts of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaksieve.functions.entropy import LONG_BYTES, entropy_of_symbols

# The well-formed sequences of UTF-8, by their bytes; and white space outside ASCII.
_SEQUENCES = (
    r"[\xC2-\xDF][\x80-\xBF]",
    r"\xE0[\xA0-\xBF][\x80-\xBF]",
    r"[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}",
    r"\xED[\x80-\x9F][\x80-\xBF]",
    r"\xF0[\x90-\xBF][\x80-\xBF]{2}",
    r"[\xF1-\xF3][\x80-\xBF]{3}",
    r"\xF4[\x80-\x8F][\x80-\xBF]{2}",
)
_SPACE = r"(?:[\t\n\x0B\f\r ]|\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80)++"
_RUNES = "(?s)" + "|".join((r"[\x00-\x7F]++", *_SEQUENCES, "."))
_REPLACEMENT = "\xef\xbf\xbd"


def byte_view(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def text_or_view(content: Column) -> Column:
    """The text of binary content, or its view if it is not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(byte_view(content))


def byte_fields(view: Column) -> Column:
    """The fields of a view, cut at the white space of its runes."""
    return F.filter(F.split(view, _SPACE), lambda field: field != "")


def rune_text(view: Column) -> Column:
    """The view as text: each byte outside a well-formed sequence becomes a replacement character."""
    pieces = F.transform(
        F.regexp_extract_all(view, F.lit(_RUNES), F.lit(0)),
        lambda piece: F.when((F.char_length(piece) == 1) & (piece >= F.lit("\x80")), F.lit(_REPLACEMENT)).otherwise(piece),
    )
    return F.encode(F.array_join(pieces, ""), "ISO-8859-1").cast("string")


def byte_entropy(view: Column, mode: str = "compat") -> Column:
    """``entropy`` of the bytes that a view stands for."""
    runes = rune_text(view)
    if mode == "standard":
        return entropy_of_symbols(runes, F.char_length(runes))
    if mode != "compat":
        raise ValueError(f"unknown entropy mode: {mode!r}")
    size = F.char_length(view)
    return F.when(size < LONG_BYTES, entropy_of_symbols(runes, size)).otherwise(entropy_of_symbols(view, size))
