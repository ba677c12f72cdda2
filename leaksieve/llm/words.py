"""Whole Arrow batches of text as byte, word and shingle arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of vector work takes at a time (a single longer text is one step).
STEP = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of one column, at least a row each."""
    _, ends = packed(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = max(first + 1, last)
        yield batch.slice(first, last - first)
        first = last


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values end to end, and the n + 1 offsets between them; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _letters(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mixed(codes + np.uint64(1))


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


class Memory(dict):
    """What a process remembers between calls; it goes to no other, and begins anew when it holds ``most`` entries."""

    def __init__(self, most: int = 1 << 14) -> None:
        super().__init__()
        self.most = most

    def __reduce__(self) -> tuple:
        return type(self), (self.most,)

    def __setitem__(self, key, value) -> None:
        if len(self) >= self.most:
            self.clear()
        super().__setitem__(key, value)


_powers = Memory()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2^64 for i below n, kept between calls."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of packed texts, A-Z lower-cased for hashing.

    ``starts`` and ``ends`` are byte places, ``text`` the row of each word,
    ``first`` the n + 1 word offsets of the rows, ``hashes`` a value per word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        solid = ~_spaces()[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        stops[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_letters(True)[data] * up[:-1], out=sums[1:])
            self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every run of k words inside one text; a shorter text with words gives its whole sequence."""
        runs = np.arange(max(0, len(self.hashes) - k + 1))
        runs = runs[self.text[runs] == self.text[runs + k - 1]] if len(runs) else runs
        out, rows = self.join(runs, k), self.text[runs] if len(runs) else np.zeros(0, np.int64)
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for size in range(1, k):
                some = count[short] == size
                extra[some] = self.join(self.first[short[some]], size)
            out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
        return out, rows

    def join(self, firsts: np.ndarray, k: int) -> np.ndarray:
        """One hash for the k words that begin at each place."""
        with np.errstate(over="ignore"):
            out = np.full(len(firsts), k, np.uint64)
            for i in range(k):
                out = mixed(out * np.uint64(_BASE) + self.hashes[firsts + i])
        return out


def sets(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in rising order, end to end, and the n + 1 offsets between rows."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[keep], rows[keep]
    return hashes, np.searchsorted(rows, np.arange(n + 1))
