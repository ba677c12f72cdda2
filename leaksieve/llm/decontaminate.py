"""Benchmark items inside documents, found by SimHash over item-sized windows.

Every window of as many words as an item has gets a SimHash of its shingles; a
text of fewer words is one window as it is.
Fingerprints are cut into eight blocks; if two differ in at most ``RADIUS`` bits,
some block differs in at most ``RADIUS // 8``. A table per block lists the items
within that distance of each value, so no fingerprint within the radius is
missed. The exact weighted-shingle similarity of window and item decides: the
sum of the smaller over the sum of the larger weights, a shingle's weight being
how often it occurs.

A window can only reach the similarity if enough of its places hold a shingle of
some item; windows without are passed over before any fingerprint is made.
Radius 23 of 64 bits lies 4.6 standard deviations above the distance to be
expected of windows at similarity 0.8. Texts shorter than the item are compared
with the fingerprints of all items of that length, within a wider radius.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sent
from .words import STEP, Words, mixed, packed

RADIUS = 23
#: Added to the radius for a text shorter than the item; eight words and nine have other majorities in 12 bits on average.
UNEVEN = 4
BLOCKS = 8
SHINGLE = 5
SIMILARITY = 0.8
#: Bytes of benchmark text that one pass over the documents looks for; a larger benchmark takes several passes.
PASS_BYTES = 8 << 20
#: Bytes of the arrays of one step over windows.
_ROOM = 16 << 20

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """Eight bytes for each row of shingle hashes: the majority of every bit."""
    bits = np.unpackbits(mixed(shingles + np.uint64(1))[..., None].view(np.uint8), axis=-1)
    return np.packbits(2 * bits.sum(1, dtype=np.int32) > shingles.shape[1], axis=1)


@dataclass
class Sized:
    """The items of one length in words."""

    words: int
    k: int
    ids: list = field(default_factory=list)
    bags: list[Counter] = field(default_factory=list)
    prints: np.ndarray | None = None
    near: np.ndarray | None = None


class BenchmarkIndex:
    def __init__(self, items: list[tuple[int | None, str]], k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> None:
        self.similarity, self.radius = similarity, radius
        self.sizes: dict[int, Sized] = {}
        words = Words(*packed(pa.array([t or "" for _, t in items], pa.string())))
        known: dict[int, list[np.ndarray]] = {}
        rows: dict[int, list[np.ndarray]] = {}
        for i, (item, _) in enumerate(items):
            n = int(words.first[i + 1] - words.first[i])
            if not n:
                continue
            size = self.sizes.setdefault(n, Sized(n, min(k, n)))
            hashes = words.join(np.arange(words.first[i], words.first[i + 1] - size.k + 1), size.k)
            size.ids.append(item)
            size.bags.append(Counter(hashes.tolist()))
            rows.setdefault(n, []).append(hashes)
            known.setdefault(size.k, []).append(hashes)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        values = np.arange(256)
        close = _ONES[values[:, None] ^ values[None, :]] <= radius // BLOCKS
        for n, size in self.sizes.items():
            size.prints = fingerprints(np.stack(rows[n]))
            size.near = np.stack([close[:, size.prints[:, b]] for b in range(BLOCKS)])

    def links(self, column: pa.Array) -> list[list[dict]]:
        """For each text the items it holds: id, best similarity, and the first word of the best window (the earliest, if equal)."""
        data, ends = packed(column)
        found: list[dict[tuple, tuple]] = [{} for _ in range(len(ends) - 1)]
        first = 0
        while first < len(ends) - 1:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP, "right")) - 1)
            self._look(Words(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]), found, first)
            first = last
        return [
            [{"item_id": key[1], "similarity": best, "first_word": -at} for key, (best, at) in sorted(x.items(), key=lambda e: e[0][0])]
            for x in found
        ]

    def _look(self, words: Words, found: list[dict], offset: int) -> None:
        for k, known in self.known.items():
            places = np.arange(max(0, len(words.hashes) - k + 1))
            inside = words.text[places] == words.text[places + k - 1] if len(places) else np.zeros(0, bool)
            shingles = words.join(places, k)
            table = np.zeros(1 << 20, bool)
            table[(known & np.uint64(len(table) - 1)).astype(np.int64)] = True
            hit = inside & table[(shingles & np.uint64(len(table) - 1)).astype(np.int64)]
            some = np.flatnonzero(hit)
            spot = np.minimum(np.searchsorted(known, shingles[some]), len(known) - 1)
            hit[some] = known[spot] == shingles[some]
            if not hit.any():
                continue
            before = np.concatenate([[0], np.cumsum(hit)])
            for size in self.sizes.values():
                if size.k == k:
                    self._windows(size, words, shingles, before, found, offset)
                    self._short(size, words, shingles, before, found, offset)

    def _windows(self, size: Sized, words: Words, shingles: np.ndarray, before: np.ndarray, found: list[dict], offset: int) -> None:
        span = size.words - size.k + 1
        if len(words.hashes) < size.words:
            return
        starts = np.flatnonzero(before[span:] - before[: len(before) - span] >= self.similarity * span - 1e-9)
        starts = starts[words.text[starts] == words.text[starts + size.words - 1]]
        self._compare(size, words, shingles, starts, span, found, offset)

    def _short(self, size: Sized, words: Words, shingles: np.ndarray, before: np.ndarray, found: list[dict], offset: int) -> None:
        """Texts of fewer words than the items, each as one window; one of fewer words than a shingle shares none."""
        count = np.diff(words.first)
        wanted = size.words - size.k + 1
        rows = np.flatnonzero((count < size.words) & (count >= size.k))
        # At the most all shingles of a text are the item's.
        rows = rows[count[rows] - size.k + 1 >= self.similarity * wanted - 1e-9]
        for span in np.unique(count[rows] - size.k + 1).tolist():
            starts = words.first[rows[count[rows] - size.k + 1 == span]]
            starts = starts[before[starts + span] - before[starts] >= self.similarity * wanted - 1e-9]
            self._compare(size, words, shingles, starts, span, found, offset)

    def _compare(self, size: Sized, words: Words, shingles: np.ndarray, starts: np.ndarray, span: int, found: list[dict], offset: int) -> None:
        """The windows of ``span`` shingles from each start against the items of one length."""
        wanted_span = size.words - size.k + 1
        radius = self.radius if span == wanted_span else self.radius + UNEVEN
        room = max(1, _ROOM // (64 * span + BLOCKS * len(size.ids)))
        for i in range(0, len(starts), room):
            some = starts[i : i + room]
            shown = shingles[some[:, None] + np.arange(span)]
            prints = fingerprints(shown)
            if span == wanted_span:
                close = np.zeros((len(some), len(size.ids)), bool)
                for b in range(BLOCKS):
                    close |= size.near[b][prints[:, b]]
            else:
                close = _ONES[prints[:, None] ^ size.prints].sum(2, dtype=np.int32) <= radius
            for w, item in np.argwhere(close).tolist():
                if int(_ONES[prints[w] ^ size.prints[item]].sum()) > radius:
                    continue
                bag, wanted = Counter(shown[w].tolist()), size.bags[item]
                same = (bag & wanted).total()
                score = same / (span + wanted_span - same)
                if score >= self.similarity:
                    row = int(words.text[some[w]])
                    at = -int(some[w] - words.first[row])
                    key = ((size.words, item), size.ids[item])
                    into = found[offset + row]
                    into[key] = max(into.get(key, (score, at)), (score, at))


LINKS = "array<struct<item_id:bigint,similarity:double,first_word:bigint>>"


def _links(index: Sent):
    @F.arrow_udf(LINKS)
    def links(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))
        return pa.array(index.value.links(column), kind)

    # So marked, it isn't computed once for a filter and once more for its rows.
    return links.asNondeterministic()


def item_links(docs: DataFrame, benchmark: DataFrame, text: Column, item_column: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES, **options) -> list[Column]:
    """Columns that list the items a text holds, one for each pass over the documents."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-total // pass_bytes) or 1
    out = []
    for i in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).orderBy("item", "text").collect()  # about pass_bytes
        sent = Sent(spark, BenchmarkIndex([(r["item"], r["text"]) for r in part], **options))
        out.append(_links(sent)(text.cast("string")))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row for each document and item that it holds: id, item_id, similarity, first_word (from 0).

    Documents and items without words hold and match nothing. Equal rows give
    equal links each; items with equal texts are found each under its own id. An
    empty benchmark or table gives no rows. Other columns are not looked at.
    """
    out = None
    for links in item_links(docs, benchmark, F.col(text_column), **options):
        rows = docs.select(F.col(id_column), F.explode(links).alias("__link")).select(id_column, "__link.*")
        out = rows if out is None else out.unionAll(rows)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    for links in item_links(docs, benchmark, F.col(text_column), **options):
        docs = docs.filter(F.size(links) == 0)
    return docs
