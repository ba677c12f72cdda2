"""Awkward rows that every operator meets."""

from __future__ import annotations

import re

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size string, score string, key string, label string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def documents(spark, texts: list[tuple[int | None, str | None]]):
    """A documents table with further columns whose names operators use inside."""
    rows = [(i, t, None, None if n % 3 == 0 else "a", None, n, "x", "y", "z", None, "w") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))
