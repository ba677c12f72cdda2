"""Documents whose sets of word shingles overlap, found with signature trees.

1. Every text becomes its set of distinct k-word shingles, as 64-bit hashes. Equal
   sets are one class from here on, so copies cost a row each.
2. If 100 * |x & y| >= p * |x | y|, x and y differ in few elements. Cut the
   universe of shingles by hash into one part more than that many: some part is
   the same in both. A class therefore gives one key per part, and classes that
   share a key may be linked. The number of parts depends on a size grade;
   linked sets lie in the same or in neighbouring grades. There are some parts to spare, so
   that those with one element or none, which unlike sets share by chance, need give no key.
3. The classes of a key meet with small signatures, how many of their elements fall in
   each bucket, as bitmaps: bit (bucket, i) is set if there are more than i.
   The common bits of two bound their overlap. The number of buckets grows with the set,
   else all large sets would seem alike; the wider of two signatures is folded. What the
   bound lets pass ties classes to candidate groups (components by joins). Each text of a
   group moves once, to the task of its group.
4. There the bitmap has a bit for every element that two sets of the group share.
   In both places a signature tree holds the sets: a leaf is a set's bitmap and size, a
   node the OR of its bitmaps and its range of sizes. Two nodes are traversed
   together while the overlap that they could have at most would link some
   pair; pairs that links already join are passed over, so a group of near
   copies costs about a comparison per member.
5. A group beyond ``block_rows`` is dealt over blocks of sets of one size grade, each
   taken by itself. Then two blocks of the same or of neighbouring grades meet in a task,
   but for members that the largest component of the group holds on both sides, so no link
   between different components is missed.
6. Links joined over all groups give the component of each class.

``shingle_links`` is the join itself: nothing is passed over for being joined, all blocks
of a group meet, and every link between classes is returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .components import components
from .words import Words, mixed, packed, sets, steps

LEAF = 16
#: Bits of a signature at most.
MOST_BITS = 1 << 14
#: Elements for each bucket of a small signature; its buckets at least and, as a power of two, at most.
LOAD, LEAST_BUCKETS, MOST_BUCKETS = 4, 64, 1 << 14
#: Counts of signatures that a task unfolds at once, and those of one key, beyond which they are folded.
STEP_COUNTS, KEY_COUNTS = 1 << 22, 1 << 26
#: Classes of a key up to which all pairs are looked at; beyond, a tree; beyond the second all are tied, and no task holds them.
FEW, MOST = 16, 20_000
#: Members and bytes of text of a group that one task takes at once.
BLOCK_ROWS = 2000
BLOCK_BYTES = 4 << 20
#: Blocks that a grade of a group may have.
BLOCKS = 1 << 24


def grades(percent: int, size: int) -> list[int]:
    """Smallest sizes of the grades up to one that holds ``size`` and one more; a linked pair spans two at most."""
    floors = [1]
    while floors[-1] <= size:
        floors.append(floors[-1] * 100 // percent + 1)
    return [*floors, floors[-1] * 100 // percent + 1, (floors[-1] * 100 // percent + 1) * 100 // percent + 1]


def parts_of(percent: int, floors: list[int], grade: int) -> int:
    """Parts of a scheme for sets of this grade and the next: one more than the elements by which linked sets differ, and some to spare."""
    largest = (floors[grade + 1] - 1) + (floors[grade + 2] - 1)
    parts = largest * (100 - percent) // (100 + percent) + 1
    return parts + (1 + parts // 5 if parts > 1 else 0)


def part_keys(values: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of packed sets and the set of each: a hash for each part of the two schemes of the set's grade.

    A set and any that it is linked with agree in all parts but as many as the elements by
    which they differ at most. If fewer of its parts are thin, with one element or none, than
    that leaves, they agree in a part that is not thin. Only sets with more thin parts
    give keys for these too; if both sets are such, any part that they agree in has a key.
    """
    sizes = np.diff(first)
    floors = np.array(grades(percent, int(sizes.max(initial=1))))
    grade = np.searchsorted(floors, sizes, "right") - 1
    parts = np.array([parts_of(percent, floors.tolist(), g) for g in range(len(floors) - 2)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, rows = [], []
    spread = (mixed(values) >> np.uint64(33)).astype(np.int64)
    for back in (0, 1):
        scheme = grade - back
        live = (sizes > 0) & (scheme >= 0)
        count = np.where(live, parts[np.maximum(scheme, 0)], 0)
        # The largest set that one may be linked with in this scheme, unless it is larger itself.
        largest = floors[grade] - 1 if back else sizes * 100 // percent
        agreed = count - (sizes + largest) * (100 - percent) // (100 + percent)
        offset = np.concatenate([[0], np.cumsum(count)])
        use = live[owner]
        who = owner[use]
        slot = offset[who] + spread[use] % count[who]
        sums = np.zeros(offset[-1], np.uint64)
        row = np.repeat(np.arange(len(sizes)), count)
        thin = np.bincount(slot, minlength=offset[-1]) < 2
        lacking = np.bincount(row[thin], minlength=len(sizes)) >= agreed
        give = ~thin | lacking[row]
        with np.errstate(over="ignore"):
            np.add.at(sums, slot, mixed(values[use] ^ np.uint64(0xA5A5A5A5)))
            part = np.arange(offset[-1]) - offset[row]
            key = mixed(sums + mixed((scheme[row] << 32 | part).astype(np.uint64) + np.uint64(7)))
        keys.append(key[give])
        rows.append(row[give])
    return np.concatenate(keys), np.concatenate(rows)


def class_ids(values: np.ndarray, first: np.ndarray) -> list[int]:
    """A 64-bit digest of each set."""
    raw, out = memoryview(values.tobytes()), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True))
    return out


def text_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*packed(column))
    return sets(*words.shingles(k), len(column))


def bucket_counts(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many elements of each packed set fall in each of its buckets, 15 at most, two to a byte; and the n + 1 places between sets."""
    sizes = np.diff(first)
    buckets = 1 << np.ceil(np.log2(np.maximum(sizes, 1) / LOAD)).clip(0).astype(np.int64)
    buckets = buckets.clip(LEAST_BUCKETS, MOST_BUCKETS)
    places = np.concatenate([[0], np.cumsum(buckets)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bucket = mixed(values ^ np.uint64(0x5C5C5C5C)).view(np.int64) & (buckets[owner] - 1)
    counts = np.minimum(np.bincount(places[owner] + bucket, minlength=places[-1]), 15).astype(np.uint8)
    return counts[::2] | counts[1::2] << 4, places // 2


def folded(halves: np.ndarray, places: np.ndarray, rows: np.ndarray, buckets: int) -> np.ndarray:
    """The counts of some sets, a row each, in so many buckets: as they would be had they been counted in these."""
    out, own = np.empty((len(rows), buckets), np.uint8), np.diff(places)[rows]
    for half in np.unique(own).tolist():
        every = np.flatnonzero(own == half)
        for at in np.split(every, range(STEP_COUNTS // half or 1, len(every), STEP_COUNTS // half or 1)):
            some = halves[places[rows[at]][:, None] + np.arange(half)]
            counts = np.stack([some & 15, some >> 4], axis=2).reshape(len(at), -1, buckets)
            out[at] = np.minimum(counts.sum(1, dtype=np.uint32), 15)
    return out


def _set_rows(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                values, first = text_sets(batch.column("text"), k)
                size = np.diff(first)
                ids = pa.array(class_ids(values, first), pa.int64(), mask=size == 0)
                halves, places = bucket_counts(values, first)
                signs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(halves)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), ids, signs], ["id", "n", "class", "counts"])

    return run


def _key_rows(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                values, first = text_sets(batch.column("text"), k)
                keys, rows = part_keys(values, first, percent)
                ids = np.array(class_ids(values, first), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[rows])], ["key", "class"])

    return run


class SignatureTree:
    """Binary tree over sets: OR-combined bitmaps and size ranges.

    The common bits of two sets, and the lesser of what each has besides its
    bits (``spare``), are no fewer than their overlap, and equal to it if ``exact``.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, spare: np.ndarray, exact: bool) -> None:
        self.maps, self.sizes, self.spare, self.exact = maps, sizes, spare, exact
        order = np.lexsort([*self.maps[:, :4].T, self.sizes])
        self.nodes: list[tuple] = []
        self.top = self._node(order) if len(sizes) else -1

    @classmethod
    def of_sets(cls, values: np.ndarray, first: np.ndarray) -> SignatureTree:
        """A bit for each element that at least two of the sets hold; beyond ``MOST_BITS`` several share a bit."""
        n, sizes = len(first) - 1, np.diff(first)
        _, place, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times > 1
        bit = np.cumsum(shared) - 1
        width = max(64, min(MOST_BITS, -(-int(shared.sum()) // 64) * 64))
        keep = shared[place]
        owner, bits = np.repeat(np.arange(n), sizes)[keep], bit[place[keep]] % width
        maps = np.zeros((n, width // 8), np.uint8)
        np.bitwise_or.at(maps, (owner, bits >> 3), (1 << (bits & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        spare = np.bincount(owner, minlength=n) - np.bitwise_count(maps).sum(1, dtype=np.int64)
        return cls(maps, sizes, spare, int(shared.sum()) <= MOST_BITS)

    @classmethod
    def of_counts(cls, counts: np.ndarray, sizes: np.ndarray) -> SignatureTree:
        """A bit for each bucket and each number below its count."""
        high = np.arange(-(-max(1, int(counts.max(initial=1))) // 8) * 8, dtype=np.uint8)
        step = STEP_COUNTS // counts.shape[1] or 1
        bits = (counts[at : at + step, :, None] > high for at in range(0, len(counts), step))
        maps = np.concatenate([np.packbits(x.reshape(len(x), -1), axis=1) for x in bits]).view(np.uint64)
        return cls(maps, sizes, sizes - counts.sum(1, dtype=np.int64), False)

    def _node(self, rows: np.ndarray) -> int:
        own = len(self.nodes)
        self.nodes.append(())
        inner = () if len(rows) <= LEAF else (self._node(rows[: len(rows) // 2]), self._node(rows[len(rows) // 2 :]))
        union = np.bitwise_or.reduce([self.nodes[i][1] for i in inner] if inner else self.maps[rows], axis=0)
        self.nodes[own] = (rows, union, int(self.sizes[rows].min()), int(self.sizes[rows].max()), int(self.spare[rows].max()), inner)
        return own

    def may_link(self, a: int, b: int, percent: int) -> bool:
        """Whether the largest overlap two nodes allow could link any of their pairs."""
        _, map_a, low_a, high_a, spare_a, _ = self.nodes[a]
        _, map_b, low_b, high_b, spare_b, _ = self.nodes[b]
        overlap = min(int(np.bitwise_count(map_a & map_b).sum()) + min(spare_a, spare_b), high_a, high_b)
        return 100 * overlap >= percent * (max(low_a, overlap) + max(low_b, overlap) - overlap)

    def overlaps(self, rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
        """The overlap of each pair: the true one if ``exact``, else no less than it."""
        out = np.empty((len(rows_a), len(rows_b)), np.int64)
        for i, row in enumerate(rows_a.tolist()):
            out[i] = np.bitwise_count(self.maps[rows_b] & self.maps[row]).sum(1, dtype=np.int64)
        return out + np.minimum(self.spare[rows_a][:, None], self.spare[rows_b][None, :])


def tree_links(
    tree: SignatureTree, percent: int, labels: np.ndarray, sides: np.ndarray | None = None, linked: Callable[[int, int], bool] | None = None
) -> list[tuple[int, int]]:
    """Links that join the members of a tree, as far as they join what labels and earlier links don't.

    ``labels`` are components known before. With ``sides``, which say from which of two
    blocks a member comes, only pairs of both blocks are looked at. Pairs that pass the bound
    are links if ``linked`` says so.
    """
    joined = np.unique(labels, return_inverse=True)[1]
    sizes, found = tree.sizes, []
    stack = [(tree.top, tree.top)] if len(sizes) else []
    while stack:
        a, b = stack.pop()
        rows_a, rows_b = tree.nodes[a][0], tree.nodes[b][0]
        ours, theirs = joined[rows_a], joined[rows_b]
        if (ours == theirs[0]).all() and (theirs == theirs[0]).all() or not tree.may_link(a, b, percent):
            continue
        inner_a, inner_b = tree.nodes[a][5], tree.nodes[b][5]
        if a == b and inner_a:
            stack += [inner_a, (inner_a[1], inner_a[1]), (inner_a[0], inner_a[0])]
            continue
        if inner_a and len(rows_a) >= len(rows_b):
            stack += [(inner_a[1], b), (inner_a[0], b)]
            continue
        if inner_b:
            stack += [(a, inner_b[1]), (a, inner_b[0])]
            continue
        overlap = np.minimum(tree.overlaps(rows_a, rows_b), np.minimum(sizes[rows_a][:, None], sizes[rows_b][None, :]))
        near = 100 * overlap >= percent * (sizes[rows_a][:, None] + sizes[rows_b][None, :] - overlap)
        if sides is not None:
            near &= sides[rows_a][:, None] != sides[rows_b][None, :]
        while True:
            open_pairs = np.flatnonzero(near & (joined[rows_a][:, None] != joined[rows_b][None, :]))
            if not len(open_pairs):
                break
            p, q = divmod(int(open_pairs[0]), len(rows_b))
            i, j = int(rows_a[p]), int(rows_b[q])
            near[p, q] = False
            if linked is None or linked(i, j):
                found.append((i, j))
                joined[joined == joined[j]] = joined[i]
    return found


def all_links(
    tree: SignatureTree, percent: int, sides: np.ndarray | None = None, linked: Callable[[int, int], bool] | None = None
) -> np.ndarray:
    """Every link between members of a tree, two columns; ``sides`` and ``linked`` as in ``tree_links``."""
    sizes, found = tree.sizes, [np.zeros((0, 2), np.int64)]
    stack = [(tree.top, tree.top)] if len(sizes) else []
    while stack:
        a, b = stack.pop()
        if not tree.may_link(a, b, percent):
            continue
        rows_a, rows_b = tree.nodes[a][0], tree.nodes[b][0]
        inner_a, inner_b = tree.nodes[a][5], tree.nodes[b][5]
        if a == b and inner_a:
            stack += [inner_a, (inner_a[1], inner_a[1]), (inner_a[0], inner_a[0])]
        elif inner_a and len(rows_a) >= len(rows_b):
            stack += [(inner_a[1], b), (inner_a[0], b)]
        elif inner_b:
            stack += [(a, inner_b[1]), (a, inner_b[0])]
        else:
            overlap = np.minimum(tree.overlaps(rows_a, rows_b), np.minimum(sizes[rows_a][:, None], sizes[rows_b][None, :]))
            near = 100 * overlap >= percent * (sizes[rows_a][:, None] + sizes[rows_b][None, :] - overlap)
            if sides is not None:
                near &= sides[rows_a][:, None] != sides[rows_b][None, :]
            p, q = np.nonzero(np.triu(near, 1) if a == b else near)
            pairs = np.stack([rows_a[p], rows_b[q]], axis=1)
            if linked is not None:
                pairs = pairs[np.array([linked(i, j) for i, j in pairs.tolist()], bool)]
            found.append(pairs)
    return np.concatenate(found)


def block_links(
    values: np.ndarray, first: np.ndarray, percent: int, labels: np.ndarray, sides: np.ndarray | None = None, every: bool = False
) -> list[tuple[int, int]] | np.ndarray:
    """``tree_links``, or ``all_links`` if ``every``, over the packed sets of a block, every link exact."""
    tree = SignatureTree.of_sets(values, first)

    def compared(i: int, j: int) -> bool:
        x, y = values[first[i] : first[i + 1]], values[first[j] : first[j + 1]]
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    if every:
        return all_links(tree, percent, sides, None if tree.exact else compared)
    return tree_links(tree, percent, labels, sides, None if tree.exact else compared)


def near_pairs(counts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) their signatures let pass."""
    spare = sizes - counts.sum(1, dtype=np.int64)
    out = np.zeros(len(i), bool)
    step = STEP_COUNTS // counts.shape[1] or 1
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        overlap = np.minimum(counts[a], counts[b]).sum(1, dtype=np.int64) + np.minimum(spare[a], spare[b])
        overlap = np.minimum(overlap, np.minimum(sizes[a], sizes[b]))
        out[at : at + step] = 100 * overlap >= percent * (sizes[a] + sizes[b] - overlap)
    return out


def _tie_rows(percent: int):
    """Rows (key, class, n, counts) sorted by key come in; classes that may be linked go out as pairs that connect them."""

    def tied(key: np.ndarray, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([begin, [len(key)]]))
        few = np.repeat(size <= FEW, size)
        pairs = []
        for apart in range(1, min(FEW, len(key))):
            i = np.flatnonzero(few[:-apart] & (key[:-apart] == key[apart:]))
            pairs.append(np.stack([ids[i], ids[i + apart]])[:, near_pairs(counts, sizes, i, i + apart, percent)])
        for a, n in zip(begin[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            own = ids[a : a + n]
            found = tree_links(SignatureTree.of_counts(counts[a : a + n], sizes[a : a + n]), percent, np.arange(n))
            pairs.append(own[np.array(found, np.int64).reshape(-1, 2)].T)
        return pairs

    def ties(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, ids, sizes = (rows.column(c).to_numpy() for c in ("key", "class", "n"))
        halves, places = packed(rows.column("counts"))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([begin, [len(key)]]))
        owner = np.repeat(np.arange(len(begin)), size)
        # The sets of a key are compared in the buckets of the smallest.
        buckets = np.minimum.reduceat(2 * np.diff(places), begin)
        while (wide := (buckets > LEAST_BUCKETS) & (buckets * size > KEY_COUNTS)).any():
            buckets[wide] //= 2
        pairs = [np.zeros((2, 0), np.int64)]
        for own in np.unique(buckets).tolist():
            keys = np.flatnonzero(buckets == own)
            step = np.cumsum(size[keys]) * own // STEP_COUNTS
            for some in np.split(keys, np.flatnonzero(step[1:] != step[:-1]) + 1):
                at = np.flatnonzero(np.isin(owner, some))
                pairs += tied(key[at], ids[at], sizes[at], folded(halves, places, at, own))
        both = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # All but the last key are complete.
            key = batch.column("key").to_numpy()
            cut = 0 if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
            if held and held[-1].column("key")[-1].as_py() != key[0]:
                yield ties(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            if cut:
                held.append(batch.slice(0, cut))
                yield ties(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield ties(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _link_rows(k: int, percent: int, every: bool):
    """Rows sorted by (unit, block) come in; a block is kept until its last row is read."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        parts = [text_sets(step.column("text"), k) for batch in rows.to_batches() for step in steps(batch, "text")]
        values = np.concatenate([v for v, _ in parts])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
        ids = np.array(class_ids(values, first), np.int64)
        # A row whose text is not the class's own shares its id with another document.
        own = ids == rows.column("class").to_numpy()
        labels = rows.column("label").to_numpy().copy()
        if not own.all():
            values = values[np.repeat(own, np.diff(first))]
            first = np.concatenate([[0], np.cumsum(np.diff(first)[own])])
            ids, labels = ids[own], labels[own]
        sides = rows.column("side").to_numpy(zero_copy_only=False)[own]
        # A block by itself has all its rows on one side.
        found = block_links(values, first, percent, labels, sides if sides.any() else None, every)
        ends = np.array(found, np.int64).reshape(-1, 2)
        if every:
            pairs = np.sort(ids[ends], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        # As stars: later joins then take few rounds.
        root: dict[int, int] = {}
        for i, j in ids[ends].tolist():
            while i in root:
                i = root[i]
            while j in root:
                j = root[j]
            if i != j:
                root[max(i, j)] = min(i, j)
        nodes, tops = list(root), []
        for node in nodes:
            while node in root:
                node = root[node]
            tops.append(node)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tops, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, block = batch.column("unit").to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                key = (unit[begin], block[begin])
                if key != last and kept:
                    yield links(pa.Table.from_batches(kept))
                    kept = []
                last = key
                kept.append(batch.slice(begin, end - begin))
        if kept:
            yield links(pa.Table.from_batches(kept))

    return run


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members of groups with their text; ``members`` name one document of each class."""
    return docs.select("id", F.coalesce("text", F.lit("")).alias("text")).join(small(members), "id")


def _block_pass(rows: DataFrame, k: int, percent: int, every: bool = False) -> DataFrame:
    width = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.select("unit", "block", "class", "label", "side", F.col("text").cast("binary").alias("text"))
    dealt = rows.repartition(int(width), "unit", "block").sortWithinPartitions("unit", "block")
    return dealt.mapInArrow(_link_rows(k, percent, every), "a long, b long")


def _linked(docs: DataFrame, k: int, percent: int, block_rows: int, block_bytes: int, all_pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, n, class, counts), classes (class, id) and links (a, b): all if ``all_pairs``, else such as give the components."""
    sized = stored(docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(_set_rows(k, percent), "id long, n long, class long, counts binary"))
    classes = sized.filter("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("id"))

    keys = docs.filter("id is not null").select(F.col("text").cast("binary").alias("text")).mapInArrow(_key_rows(k, percent), "key long, class long")
    # Keys of one class are most and go; of copies one stays.
    every, before = Window.partitionBy("key"), F.lag("class").over(Window.partitionBy("key").orderBy("class"))
    keys = keys.select("key", "class", before.alias("before"), F.min("class").over(every).alias("low"), F.max("class").over(every).alias("high"))
    keys = keys.filter("low <> high and (before is null or before <> class)").select("key", "class", "low")
    # Near copies share most of their parts: keys with the same classes become one, named by their number and two sums over them.
    mark = F.xxhash64("class", F.lit(3))
    marks = [F.count("*").over(every), F.bit_xor(mark).over(every), F.sum(F.shiftrightunsigned(mark, 32)).over(every)]
    keys = keys.select("class", "low", *[m.alias(f"m{n}") for n, m in enumerate(marks)])
    keys = stored(keys.select(F.xxhash64("m0", "m1", "m2").alias("key"), "class", "low", F.col("m0").alias("size")).distinct())
    signs = sized.filter("class is not null and id is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    signed = keys.filter(F.col("size") <= MOST).join(signs, "class").select("key", "class", "n", "counts")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = signed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_tie_rows(percent), "a long, b long")
    # Classes of a larger key are all tied to the least of them, by whom they are compared later all the same.
    ties = ties.unionAll(keys.filter((F.col("size") > MOST) & (F.col("class") != F.col("low"))).select("class", "low"))
    groups = components(ties).withColumnsRenamed({"node": "class", "root": "unit"})
    members = classes.join(groups, "class").join(sized.groupBy("class").agg(F.first("n").alias("n")), "class")
    members = stored(members)
    members = members.withColumn("grade", F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("long") if percent < 100 else F.col("n"))
    # A shingle takes about eight bytes of text.
    extent = [F.count("*").alias("rows"), (F.sum("n") * 8).alias("bytes")]
    blocks = F.ceil(F.greatest(F.col("rows") / block_rows, F.col("bytes") / block_bytes)).cast("long")
    large = small(stored(members.groupBy("unit").agg(*extent).filter(blocks > 1).select("unit")))
    split = stored(members.join(large, "unit", "left_semi").groupBy("unit", "grade").agg(*extent).select("unit", "grade", blocks.alias("blocks")))
    dealt = members.join(small(split), ["unit", "grade"], "left")
    # The blocks of a large group hold sets of one grade: linked sets lie in the same or in neighbouring grades.
    dealt = dealt.withColumn("block", F.coalesce(F.col("grade") * BLOCKS + F.pmod(F.xxhash64("class", F.lit(1)), "blocks"), F.lit(0)))
    first = dealt.select("id", "class", "unit", "block", F.col("class").alias("label"), F.lit(False).alias("side"))
    links = stored(_block_pass(_texts(docs, stored(first)), k, percent, all_pairs))
    if split.limit(1).count():
        links = stored(links.unionAll(_visits(docs, dealt.filter("blocks is not null"), links, k, percent, all_pairs)))
    return sized, classes, links


def shingle_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int = 5,
    percent: int = 80,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: ``id_column``, ``n_shingles`` and ``component_id``.

    Two rows link when 100 * shared >= percent * united over their distinct
    k-word shingles (a shorter text's whole sequence is one); ``component_id`` is
    the smallest id reachable. Null, empty and blank texts have size 0 and link
    with nothing. A row with a null id takes no part in links; its component is
    null. Equal rows each return. Other columns of ``docs`` are not looked at.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sized, classes, links = _linked(docs, k, percent, block_rows, block_bytes, False)
    roots = components(links).withColumnsRenamed({"node": "class"})
    owners = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = owners.groupBy("root").agg(F.min("id").alias("component_id"))
    owners = stored(owners.join(least, "root").select("class", "component_id"))
    some = sized.filter("class is not null and id is not null").join(small(owners), "class").select("id", "n", "component_id")
    none = sized.filter("class is null or id is null").select("id", "n", F.col("id").alias("component_id"))
    return some.unionAll(none).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def shingle_links(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int = 5,
    percent: int = 80,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets: (class_a, class_b), each pair once, class_a the smaller; and per input row ``id_column``, ``n_shingles`` and ``class``.

    Rows link as in ``shingle_components``; those of one class have equal sets and link with
    each other. The class is null for rows without id or words. The work and the result grow
    with the number of links, which is the square of a group of near copies.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sized, _, links = _linked(docs, k, percent, block_rows, block_bytes, True)
    # Equal rows give a link more than once, and one of a class with itself.
    links = links.filter("a <> b").distinct().select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))
    own = F.when(F.col("id").isNotNull(), F.col("class")).alias("class")
    return links, sized.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own)


def _visits(docs: DataFrame, dealt: DataFrame, links: DataFrame, k: int, percent: int, all_pairs: bool) -> DataFrame:
    """Links between the blocks of a group: with members outside the group's largest component, or ``all_pairs``."""
    roots = components(links).withColumnsRenamed({"node": "class", "root": "label"})
    dealt = stored(dealt.join(roots, "class", "left").withColumn("label", F.coalesce("label", "class")))
    counts = dealt.groupBy("unit", "label").agg(F.count("*").alias("n"))
    main = stored(counts.groupBy("unit").agg(F.max_by("label", F.struct("n", "label")).alias("main")))
    dealt = dealt.join(small(main), "unit").withColumn("outside", F.col("label") != F.col("main"))
    state = stored(dealt.groupBy("unit", "grade", "block").agg(F.max("outside").alias("open")))
    other = small(state.select("unit", F.col("grade").alias("near"), F.col("block").alias("other"), "open"))
    every = dealt.withColumn("near", F.explode(F.array(*[F.col("grade") + step for step in (-1, 0, 1)])))
    every = every.join(other, ["unit", "near"]).filter("other <> block")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    # A member of the largest component meets only blocks with others.
    met = (every if all_pairs else every.filter("outside or open")).select(
        "id", "class", "unit", F.xxhash64(low, high).alias("pair"), "label", (F.col("block") == high).alias("side")
    )
    return _block_pass(_texts(docs, stored(met.withColumnRenamed("pair", "block"))), k, percent, all_pairs)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose id is the smallest of its component; null ids stay, rows equal in id and text leave one."""
    found = shingle_components(docs, id_column, text_column, k, percent)
    kept = found.filter(F.col(id_column) == F.col("component_id")).groupBy(F.col(id_column).alias("__kept")).agg((F.count("*") > 1).alias("__again"))
    kept = stored(kept)
    keyed = docs.filter(F.col(id_column).isNotNull())
    once = keyed.join(small(kept.filter("not __again").select("__kept")), F.col(id_column) == F.col("__kept"), "left_semi")
    again = kept.filter("__again").select("__kept")
    if again.limit(1).count():
        some = keyed.join(again, F.col(id_column) == F.col("__kept"), "left_semi")
        once = once.unionAll(some.dropDuplicates([id_column, text_column]))
    return once.unionAll(docs.filter(F.col(id_column).isNull()))
