"""Removal of strings that repeat anywhere in the corpus, decided on Burrows-Wheeler transforms.

1. A window of ``length`` bytes is answered for by its seed, the 32 bytes in it whose
   hash is least. Equal windows have equal seeds at equal places. So a text gives
   a row per seed with the range of windows it answers for, its context.
2. Rows meet by seed. A context that occurs at two places is repeated as a whole;
   of those, and of contexts that differ, one goes on to step 3 where a seed has
   several. Seeds met once are done with. Chunks of texts settle what repeats
   within them, so a very common context sends a row or two per chunk.
3. The contexts of a seed come together. Each is cut back to what some other
   context shares with it to the left and right; equal remains are one. Shards
   of these remains, of bounded size, get a Burrows-Wheeler transform.
4. Backward extension of its intervals, breadth first, gives the common prefixes
   of neighbouring suffixes by increasing value and stops at ``length``: neighbours
   without a value by then share as much or more, and their windows are repeated.
5. Ranges of repeated windows go back to their texts by row.

A seed with more than ``most`` contexts takes another way in step 3: hashes of all
its windows are counted by Spark, with partial sums, so none of its rows gather.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, shared_prefix, small, stored
from .words import mixed, packed, steps

#: Bytes of a seed; a power of two.
SEED = 32
#: Contexts of a seed that one task takes together at most.
MOST_CONTEXTS = 50_000
#: Bytes of contexts that are indexed together.
SHARD_BYTES = 1 << 20
_BASE = 0xC2B2AE3D27D4EB4F
_PLACE = np.uint64((1 << 31) - 1)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``SEED`` bytes from each place, by doubling."""
    out, power, width = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while width < SEED:
            out = out[:-width] * np.uint64(power) + out[width:] if len(out) > width else out[:0]
            power, width = power * power % (1 << 64), 2 * width
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by blocks of that width read from both sides."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    full = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Seeds that answer for windows inside one text: place, hash, text, first and last start of their windows.

    The least seed is the one of the least 33 leading bits of the hash, the first
    of equals; both depend on the window alone.
    """
    hashes = seed_hashes(data)
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    low = sliding_min(ranked, length - SEED + 1)
    starts = np.arange(len(low))
    text = np.searchsorted(ends, starts, "right") - 1
    inside = np.flatnonzero(starts + length <= ends[text + 1]) if len(low) else starts
    seeds = (low[inside] & _PLACE).astype(np.int64)
    turn = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (text[inside][1:] != text[inside][:-1])])) if len(seeds) else inside
    last = inside[np.concatenate([turn[1:], [len(seeds)]]) - 1] if len(seeds) else inside
    places = seeds[turn]
    return places, hashes[places], text[inside[turn]], inside[turn], last


# A place in a text as one number: start of the context, distance to its seed, and windows after the first.
def _pack(first: np.ndarray, seed: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << 24) | ((seed - first) << 12) | (last - first)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = at >> 24
    return first, first + ((at >> 12) & 4095), first + (at & 4095)


def _anchor_rows(length: int):
    """Rows (key, context, row, at, known): ``key`` is the seed, or for a place already known to repeat a number that spreads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                data, ends = packed(batch.column("text"))
                place, seed, text, first, last = anchors(data, ends, length)
                raw = memoryview(data)
                digest = hashlib.blake2b
                context = np.array(
                    [
                        int.from_bytes(digest(raw[a : b + length], digest_size=8, salt=d.to_bytes(2, "little")).digest(), "little")
                        for a, b, d in zip(first.tolist(), last.tolist(), (place - first).tolist(), strict=True)
                    ],
                    np.uint64,
                )
                row = batch.column("row").to_numpy()[text]
                begin = ends[text]
                at = _pack(first - begin, place - begin, last - begin)
                # Of what repeats here, one place is sent on as a witness; the others are settled.
                order = np.lexsort((context, seed))
                same = (seed[order][1:] == seed[order][:-1]) & (context[order][1:] == context[order][:-1])
                leads = np.concatenate([[True], ~same])[: len(order)]
                twice = np.zeros(len(order), bool)
                twice[order] = np.concatenate([same, [False]])[: len(order)] | np.concatenate([[False], same])[: len(order)]
                settled = np.zeros(len(order), bool)
                settled[order] = ~leads
                key = np.where(settled, mixed(row.view(np.uint64) ^ at.astype(np.uint64)), seed)
                columns = [key.view(np.int64), context.view(np.int64), row, at, twice.astype(np.int8) + settled.astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "context", "row", "at", "known"])

    return run


def _context_rows(length: int):
    """The context bytes of the places asked for in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                data, ends = packed(batch.column("text"))
                asked = batch.column("asked")
                count = np.diff(asked.offsets.to_numpy())
                values = asked.flatten()
                text = np.repeat(np.arange(len(count)), count)
                at = values.field("at").to_numpy()
                first, seed, last = _unpack(at)
                raw = memoryview(data)
                pieces = [bytes(raw[a:b]) for a, b in zip((ends[text] + first).tolist(), (ends[text] + last + length).tolist(), strict=True)]
                row = batch.column("row").to_numpy()[text]
                columns = [values.field("key"), pa.array(row), pa.array(at), values.field("many"), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "row", "at", "many", "piece"])

    return run


def suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` symbols from each on (the text taken as a ring), by doubling."""
    key = np.zeros(len(symbols), np.int64)
    wide = symbols.astype(np.int64)
    for i in range(7):
        key = (key << 9) | np.roll(wide, -i)
    rank, known = np.unique(key, return_inverse=True)[1], 7
    while known < depth:
        most = int(rank.max()) + 1
        if most == len(symbols):
            break
        rank = np.unique(rank.astype(np.int64) * most + np.roll(rank, -known), return_inverse=True)[1]
        known *= 2
    return np.argsort(rank, kind="stable")


def long_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order, whether it shares ``least`` symbols or more with the one before.

    Starts from the interval of the empty string and extends every interval to the
    left by the symbols that its transform holds. The first string of length
    d + 1 whose interval ends at a place gives that place the value d. Strings of
    one length are taken together; separators (0) begin no longer string.
    """
    n = len(symbols)
    transform = np.roll(symbols, 1)[order]
    by_symbol = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)  # where the suffix one symbol longer stands
    open_place = np.ones(n + 1, bool)
    open_place[[0, n]] = False
    begin, end = np.array([0]), np.array([n])
    for depth in range(least):
        size = end - begin
        owner = np.repeat(np.arange(len(begin)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        if depth:
            keep = transform[inside] != 0
            owner, inside = owner[keep], inside[keep]
        group = owner * 512 + transform[inside]
        sort = np.argsort(group, kind="stable")
        group, target = group[sort], step[inside[sort]]
        lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([lead, [len(group)]]))
        begin = target[lead]
        end = begin + count
        fresh = open_place[end]
        if depth == 0:
            fresh |= end == n  # its last interval is open to the left all the same
        begin, end = begin[fresh], end[fresh]
        if not len(end):
            break
        open_place[end] = False
    return open_place[:n]


def repeated_windows(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Ranges of starts, first and last, of the windows of each piece that occur at another place of the pieces."""
    size = np.array([len(p) + 1 for p in pieces])
    symbols = np.zeros(int(size.sum()), np.int16)
    begin = np.cumsum(size) - size
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[:] = joined
    symbols[begin + size - 1] = 0
    order = suffixes(symbols, length)
    alike = long_prefixes(symbols, order, length)
    both = alike.copy()
    both[:-1] |= alike[1:]
    found = np.zeros(len(symbols), bool)
    found[order] = both
    room = np.arange(len(symbols)) + length <= np.repeat(begin + size - 1, size)
    starts = np.flatnonzero(found & room)
    piece = np.searchsorted(begin, starts, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    if len(starts):
        turn = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (piece[1:] != piece[:-1])]))
        last = np.concatenate([turn[1:], [len(starts)]]) - 1
        for p, a, b in zip(piece[turn].tolist(), starts[turn].tolist(), starts[last].tolist(), strict=True):
            out[p].append((a - int(begin[p]), b - int(begin[p])))
    return out


def _shared(keys: list[bytes]) -> list[int]:
    """The longest prefix that each string shares with any other."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    out = [0] * len(keys)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = shared_prefix(keys[a], keys[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def remains(pieces: list[bytes], seeds: list[int], length: int) -> list[tuple[int, bytes]]:
    """Each context of one seed cut to what another shares of it, as (bytes cut off its front, the rest); empty if no window is left."""
    left = _shared([p[:s][::-1] for p, s in zip(pieces, seeds, strict=True)])
    right = _shared([p[s + SEED :] for p, s in zip(pieces, seeds, strict=True)])
    out = []
    for piece, seed, a, b in zip(pieces, seeds, left, right, strict=True):
        rest = piece[seed - a : seed + SEED + b]
        out.append((seed - a, rest) if len(rest) >= length else (0, b""))
    return out


class _Shard:
    """Remains of many seeds, with the places they stand for."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.pieces: list[bytes] = []
        self.places: list[list[tuple[int, int, bool]]] = []
        self.size = 0

    def add(self, rows: list[tuple[int, int, bool, bytes]]) -> None:
        """The contexts (row, at, many, piece) of one seed."""
        at = np.array([r[1] for r in rows])
        first, seed, _ = _unpack(at)
        cut = remains([r[3] for r in rows], (seed - first).tolist(), self.length)
        groups: dict[tuple[int, bytes], list[tuple[int, int, bool]]] = {}
        for (row, _, many, _), begin, offset, (front, rest) in zip(rows, first.tolist(), (seed - first).tolist(), cut, strict=True):
            if rest:
                groups.setdefault((offset - front, rest), []).append((row, begin + front, many))
        for (_, rest), places in groups.items():
            self.pieces.append(rest)
            self.places.append(places)
            self.size += len(rest)

    def marks(self) -> pa.RecordBatch:
        rows, begins, lasts = [], [], []
        found = repeated_windows(self.pieces, self.length) if self.pieces else []
        for piece, places, ranges in zip(self.pieces, self.places, found, strict=True):
            if len(places) > 1 or places[0][2]:
                ranges = [(0, len(piece) - self.length)]
            for row, begin, _ in places:
                for a, b in ranges:
                    rows.append(row)
                    begins.append(begin + a)
                    lasts.append(begin + b)
        self.pieces, self.places, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rows, begins, lasts)], ["row", "first", "last"])


def _mark_rows(length: int):
    """Contexts sorted by seed come in; a seed's are held until its last is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, last = _Shard(length), [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "row", "at", "many", "piece")]
            for key, *row in zip(*columns, strict=True):
                if key != last and held:
                    if len(held) > 1:
                        shard.add(held)
                    held = []
                    if shard.size > SHARD_BYTES:
                        yield shard.marks()
                last = key
                held.append(tuple(row))
        if len(held) > 1:
            shard.add(held)
        yield shard.marks()

    return run


def _window_rows(length: int):
    """Two hashes for every window of a context, for seeds with too many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, at, many, piece in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "many", "piece")), strict=True):
                for i in range(len(piece) - length + 1):
                    digest = hashlib.blake2b(piece[i : i + length], digest_size=16).digest()
                    for column, value in zip(out, (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), row, (at >> 24) + i, many), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["w1", "w2", "row", "first", "many"])

    return run


def _kept_rows(length: int):
    """What is left of each marked text: bytes removed, maximal runs of them, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                removed, runs, rests = [], [], []
                for text, marks in zip(batch.column("text"), batch.column("marks"), strict=True):
                    data = text.as_buffer()
                    raw = memoryview(data)
                    first, last = (marks.values.field(c).to_numpy() for c in ("first", "last"))
                    order = np.argsort(first, kind="stable")
                    first, end = first[order], np.maximum.accumulate(last[order] + length)
                    gap = np.concatenate([[True], first[1:] > end[:-1]])
                    begins = first[gap]
                    stops = end[np.concatenate([np.flatnonzero(gap)[1:], [len(end)]]) - 1]
                    at, parts = 0, []
                    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
                        parts.append(raw[at:a])
                        at = b
                    parts.append(raw[at:])
                    removed.append(int((stops - begins).sum()))
                    runs.append(len(begins))
                    rests.append(b"".join(parts))
                columns = [batch.column("row"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(rests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = 200,
    result: Callable[[Column], Column] = lambda kept: kept,
    most: int = MOST_CONTEXTS,
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and ``kept``, the UTF-8 bytes that are left, or what ``result`` makes of them.

    A byte goes if it lies in a string of ``length`` bytes that starts at another place
    too, in the same text or any other. Null texts are empty; texts shorter than
    ``length`` stay whole. Rows equal in id and text count as places each.
    ``length`` is from twice the seed's 32 bytes to 4,000. Other columns are not looked at.
    """
    if not 2 * SEED <= length <= 4000:
        raise ValueError("length must be from 64 to 4000")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column), text.alias("text")).withColumn("row", F.xxhash64(F.col(id_column), "text"))
    texts = rows.filter(F.octet_length("text") >= length).select("row", "text")

    # One exchange brings the rows of a seed together; neighbours in order of context and place tell the rest.
    found = texts.mapInArrow(_anchor_rows(length), "key long, context long, row long, at long, known tinyint")
    by_seed = Window.partitionBy("key").orderBy("context", "row", "at")
    found = found.select(
        *found.columns,
        F.lag("context").over(by_seed).alias("before"),
        F.lead("context").over(by_seed).alias("after"),
        F.first("context").over(by_seed).alias("least"),
    )
    many = (F.col("known") > 0) | F.coalesce(F.col("before") == F.col("context"), F.lit(False)) | F.coalesce(F.col("after") == F.col("context"), F.lit(False))
    # One place of each context asks for a comparison if the seed has another context.
    asks = (F.col("known") < 2) & (
        F.coalesce(F.col("before") != F.col("context"), F.lit(False))
        | F.coalesce((F.col("after") != F.col("context")) & (F.col("least") == F.col("context")), F.lit(False))
    )
    path = scratch(spark, "repeats")
    found.select("key", "row", "at", many.alias("many"), asks.alias("asks")).filter("many or asks").write.parquet(path)
    hits = spark.read.schema("key long, row long, at long, many boolean, asks boolean").parquet(path)

    asked = hits.filter("asks")
    crowds = stored(asked.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"))
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct("key", "at", "many")).alias("asked"))
    contexts = texts.join(by_row, "row").mapInArrow(_context_rows(length), "key long, row long, at long, many boolean, piece binary")
    crowded = bool(crowds.limit(1).count())
    usual = contexts.join(small(crowds), "key", "left_anti") if crowded else contexts
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = usual.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_mark_rows(length), "row long, first long, last long")
    settled = hits.filter("many").select("row", F.shiftright("at", 24).alias("first"), (F.shiftright("at", 24) + F.col("at").bitwiseAND(4095)).alias("last"))
    marks = marks.unionAll(settled)
    if crowded:
        windows = contexts.join(small(crowds), "key", "left_semi").mapInArrow(_window_rows(length), "w1 long, w2 long, row long, first long, many boolean")
        place = F.struct("row", "first")
        again = windows.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("many").alias("many"))
        again = again.filter("a <> b or many").select("w1", "w2")
        marks = marks.unionAll(windows.join(again, ["w1", "w2"]).select("row", "first", F.col("first").alias("last")))

    marked = marks.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    kept = texts.join(marked, "row").mapInArrow(_kept_rows(length), "row long, n_removed long, n_spans long, kept binary")
    return _with_copies(rows, kept, id_column, length, result)


def _with_copies(rows: DataFrame, kept: DataFrame, id_column: str, length: int, result: Callable[[Column], Column]) -> DataFrame:
    """Results for all rows; those equal in id and text repeat each other, if they are long enough."""
    base = rows.select(F.col(id_column), "row", F.octet_length("text").cast("long").alias("n_bytes"), result(F.col("text")).alias("__whole"))
    kept = kept.select(F.col("row").alias("__row"), "n_removed", "n_spans", result(F.col("kept")).alias("kept")).dropDuplicates(["__row"])
    repeated = stored(rows.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row", F.lit(True).alias("again")))
    found = base.join(kept, F.col("row") == F.col("__row"), "left")
    found = found.join(small(repeated), "row", "left")
    whole = F.coalesce("again", F.lit(False)) & (F.col("n_bytes") >= length)
    return found.select(
        F.col(id_column),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, result(F.lit(b""))).otherwise(F.coalesce("kept", "__whole")).alias("kept"),
    )
