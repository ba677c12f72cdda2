"""Token counts of texts under a byte-level BPE vocabulary with word ends, without encoding most words.

A vocabulary string need not encode as itself: the merges may never put it together.
``WholeTokens`` proves, once and before any text is read, for which strings they do: it runs
the merges on every string of the vocabulary alone and keeps those that end as
one token. A pre-token among them counts one and is never merged. The rest, which are
few distinct strings, are merged.

Normalising and cutting are those of the tokenizer file, done by its library. For
letters below U+0300 that the library is shown to treat likewise, one pass of the file's
pattern over the lower-cased text does the same; other words go to the library. Texts
are taken in pieces that end at a space, which no rule of the file looks across.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Sent
from .words import Memory

#: Characters of a text that are cut into pre-tokens at a time, up to the next space.
PIECE_CHARS = 1 << 18
#: Bytes up to which the pairs of a word are looked through for each merge.
LONG_WORD = 48
#: Merged words that a task remembers.
REMEMBERED = 1 << 18
#: Letters from here on may compose with others when normalised.
FIRST_COMBINING = 0x300


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printing Latin-1 letters for themselves, the others from U+0100 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class Merges:
    """The merge table: symbols are vocabulary numbers, the last one of a word carries the word's end."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[list[str] | str], end: str) -> None:
        letters = byte_letters()
        self.inner = [vocabulary[letters[b]] for b in range(256)]
        self.last = [vocabulary[letters[b] + end] for b in range(256)]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rules.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one word: the pair of lowest rank is merged first, of equals the leftmost."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[b] for b in word[-1:]]
        return self._merge_long(ids) if len(ids) > LONG_WORD else self._merge(ids)

    def _merge(self, ids: list[int]) -> list[int]:
        find, none = self.rules.get, (len(self.rules), -1)
        found = [find(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            least = min(found)
            if least is none:
                break
            at = found.index(least)
            ids[at : at + 2] = [least[1]]
            del found[at]
            if at:
                found[at - 1] = find((ids[at - 1], least[1]), none)
            if at < len(found):
                found[at] = find((least[1], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As ``_merge``, with a queue of places: its time grows little faster than the word."""
        rules, n = self.rules, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*rules[pair], at, pair) for at, pair in enumerate(zip(ids, ids[1:])) if pair in rules]
        heapq.heapify(queue)
        # Ranks differ by pair, so entries order by rank and place.
        while queue:
            _, made, at, pair = heapq.heappop(queue)
            right = after[at]
            if right >= n or (ids[at], ids[right]) != pair:
                continue
            ids[at], ids[right] = made, -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
                found = (made, ids[after[at]])
                if found in rules:
                    heapq.heappush(queue, (*rules[found], at, found))
            if before[at] >= 0:
                found = (ids[before[at]], made)
                if found in rules:
                    heapq.heappush(queue, (*rules[found], before[at], found))
        return [i for i in ids if i >= 0]


class WholeTokens:
    """Counts tokens as the library does for one tokenizer file: words proved to be one token directly, others by merges.

    ``ValueError`` if the file's model is not of the kind this covers.
    """

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, cut = spec["model"], spec["pre_tokenizer"]
        steps = cut.get("pretokenizers", [cut])
        byte_level = steps[-1]
        simple = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        if model["type"] != "BPE" or not simple or byte_level["type"] != "ByteLevel":
            raise ValueError(f"not a byte-level BPE tokenizer: {path}")
        if byte_level.get("add_prefix_space") or byte_level.get("use_regex"):
            raise ValueError(f"pre-tokens must be cut before the byte level: {path}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"added tokens must stand for themselves: {path}")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.whole = self._proved(model["vocab"], model.get("end_of_word_suffix") or "")
        # The library's own normaliser and cutter, without the byte letters and without a vocabulary.
        small = {"type": "BPE", "dropout": None, "unk_token": None, "vocab": {}, "merges": []}
        self.cutter_spec = json.dumps(spec | {"model": small, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps[:-1]}})
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._others = Memory(REMEMBERED)
        self.pattern, self.wide = self._plain_pattern(spec, steps[:-1])

    def _proved(self, vocabulary: dict[str, int], end: str) -> frozenset[str]:
        """The words whose merges end in one token; words that are no text can be no pre-token."""
        numbers = {letter: byte for byte, letter in byte_letters().items()}
        found = set()
        for string, number in vocabulary.items():
            if not string.endswith(end) or any(letter not in numbers for letter in string[: len(string) - len(end)]):
                continue
            word = bytes(numbers[letter] for letter in string[: len(string) - len(end)])
            if word and self.merges.encode(word) == [number]:
                try:
                    found.add(word.decode())
                except UnicodeDecodeError:
                    continue
        return frozenset(found)

    def _plain_pattern(self, spec: dict, steps: list[dict]) -> tuple[regex.Pattern | None, regex.Pattern]:
        """The pattern that cuts lower-cased text as the library does, and one that finds the letters for which that isn't shown."""
        every = regex.compile(r"[^ \n]")
        wanted = ["NFC", "Replace", "Lowercase"]
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        spaces = [n for n in normal if n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "]
        inverted = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and "Regex" in s["pattern"]]
        if [n["type"] for n in normal] != wanted or not spaces or len(steps) != 1 or not inverted:
            return None, every
        pattern = regex.compile(inverted[0]["pattern"]["Regex"])
        shown = []
        for letter in map(chr, range(FIRST_COMBINING)):
            around = [f"a{letter}a", f"1{letter}", f"-{letter}-", letter * 2, f"'{letter}s"]
            if all(pattern.findall(text.lower()) == self._library_words(text) for text in around):
                shown.append(letter)
        return pattern, regex.compile("[^" + "".join(f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}" for c in shown) + "]")

    def _library_words(self, text: str) -> list[str]:
        return [word for word, _ in self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(text))]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cutter"}

    @property
    def cutter(self) -> Tokenizer:
        if "_cutter" not in self.__dict__:
            self._cutter = Tokenizer.from_str(self.cutter_spec)
        return self._cutter

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that end after an ASCII space or line feed."""
        at = 0
        while at < len(text):
            end = at + PIECE_CHARS
            if end < len(text):
                found = re.compile("[ \n]").search(text, end)
                end = found.end() if found else len(text)
            yield text[at:end]
            at = end

    def count(self, text: str) -> int:
        total = 0
        for piece in self.pieces(text):
            plain = [piece]
            if self.added and any(mark in piece for mark in self.added):
                plain = re.split("|".join(map(re.escape, self.added)), piece)
                total += len(plain) - 1
            for part in plain:
                total += self._count_plain(part) if part else 0
        return total

    def _count_plain(self, text: str) -> int:
        others = ""
        if self.wide.search(text):
            parts = text.replace("\n", " ").split(" ")
            others = " ".join(part for part in parts if self.wide.search(part))
            text = " ".join(part for part in parts if not self.wide.search(part))
        times = Counter(self.pattern.findall(text.lower()) if self.pattern else ())
        if others:
            times.update(self._library_words(others))
        total = sum(times.values())
        for word in times.keys() - self.whole:
            tokens = self._others.get(word)
            if tokens is None:
                tokens = len(self.merges.encode(word.encode()))
                if len(word) < 256:
                    self._others[word] = tokens
            total += times[word] * (tokens - 1)
        return total


def token_counts(text: Column, counter: Sent) -> Column:
    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: counter.value.count(t) if t else 0).astype("int64")

    return counted(text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a tokenizer file, read by the driver alone; its
    tables, whose size is the vocabulary's, are broadcast. Null and empty texts have 0 tokens. Null ids and
    equal rows each return; other columns are not looked at. A text is counted in one task, however long, in pieces.
    """
    counter = Sent(docs.sparkSession, WholeTokens(vocabulary))
    text = F.col(text_column).cast("string")
    counted = docs.select(
        F.col(id_column),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts(text, counter).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
