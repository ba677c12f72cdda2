"""The trie of conversation prefixes, with sums over subtrees taken from an Euler tour.

1. A turn is a mark, the md5 of its role and text, and its code points; texts don't move. A
   prefix is identified by 128 bits: the xor, over its turns, of two hashes of place and mark,
   which are running values over the pieces of a conversation. Prefixes that are equal are one
   node, named by its smallest conversation and its depth.
2. Each node gives two arcs, enter and exit. The arc after enter is the first child's enter, or the
   own exit; after exit comes the next sibling's enter, or the parent's exit.
3. The tour is ranked: arcs are dealt in ranges of conversations, each task replaces the runs that
   lie in its range by one arc each, and so on with the arcs that are left, until one task holds
   them. Where ranges don't shorten the list, the rest is ranked by doubling joins. Positions are then handed back.
4. Running sums over the positions give each subtree's sum: its value at the exit less that before the enter.

Children of one node are dealt by ranges of their names, so no node's children meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .scans import PIECE_ROWS, pieces, running, spread_join

#: Children of a node that are put in order at once: as many as there are names in a range.
SIBLINGS = 10_000
#: Arcs that one task holds.
ARCS = 250_000


@dataclass
class Trie:
    """``nodes`` (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, x1, x2) and ``ends``: the node (depth, x1, x2) at which each conv_id ends."""

    nodes: DataFrame
    ends: DataFrame


def turn_marks(rows: DataFrame) -> DataFrame:
    """``conv_id, place, mark, chars`` of rows ``conv_id, turn, role, text``: turns counted from 1 by turn, nulls first.

    Rows of one turn follow by role and text digest. Null roles and texts are empty; rows without conv_id have no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    narrow = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), mark.alias("mark"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["turn", "role", "mark", "tie"]
    cut = pieces(stored(narrow), ["conv_id"], order)
    return running(cut, ["conv_id"], order, {"place": F.lit(1)}, {}).select("conv_id", "place", "mark", "chars")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs of one range, in order, with the head of the run of arcs that each lies in and what runs before it; heads get the weight and the next arc of their run."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    conv, at, weight = (table.column(c).to_numpy() for c in ("conv", "at", "weight"))
    last = np.asarray(table.column("nat").is_null())
    nconv, nat = (np.asarray(table.column(c).fill_null(-1)) for c in ("nconv", "nat"))
    names, code = np.unique(conv, return_inverse=True)
    width = int(max(at.max(), nat.max())) + 2
    key = code * width + at
    place = np.minimum(np.searchsorted(names, nconv), len(names) - 1)
    wanted = np.where((names[place] == nconv) & ~last, place * width + nat, -1)
    found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    after = np.where(key[found] == wanted, found, -1)
    before = np.arange(len(key))
    inner = np.flatnonzero(after >= 0)
    before[after[inner]] = inner
    ahead = np.where(before == np.arange(len(key)), 0, weight[before])
    while True:
        further = before[before]
        if (further == before).all():
            break
        ahead, before = ahead + ahead[before], further
    is_head = before == np.arange(len(key))
    tails = np.flatnonzero(after < 0)
    total, out = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    total[before[tails]], out[before[tails]] = ahead[tails] + weight[tails], tails
    none = ~is_head | last[out]
    columns = [conv, at, conv[before], at[before], ahead, total]
    arrays = [pa.array(c) for c in columns] + [pa.array(nconv[out], mask=none), pa.array(nat[out], mask=none)]
    yield pa.RecordBatch.from_arrays(arrays, ["conv", "at", "hconv", "hat", "ahead", "weight", "nconv", "nat"])


def _contracted(arcs: DataFrame, tasks: int) -> DataFrame:
    dealt = arcs.repartitionByRange(tasks, "conv", "at") if tasks > 1 else arcs.coalesce(1)
    runs = dealt.sortWithinPartitions("conv", "at").mapInArrow(_runs, "conv long, at long, hconv long, hat long, ahead long, weight long, nconv long, nat long")
    return stored(runs)


def _doubled(arcs: DataFrame) -> DataFrame:
    """``conv, at, pos`` of a list by doubling: an arc's distance to the end, and then its next arc's as well."""
    state = stored(arcs.select("conv", "at", "nconv", "nat", "weight"))
    while state.filter("nat is not null").limit(1).count():
        further = state.select(F.col("conv").alias("nconv"), F.col("at").alias("nat"), F.col("nconv").alias("fconv"), F.col("nat").alias("fat"), F.col("weight").alias("more"))
        moved = state.filter("nat is not null").join(further, ["nconv", "nat"]).select("conv", "at", F.col("fconv").alias("nconv"), F.col("fat").alias("nat"), F.expr("weight + more").alias("weight"))
        state = stored(state.filter("nat is null").unionByName(moved))
    whole = state.agg(F.max("weight")).first()[0]
    return state.select("conv", "at", (F.lit(whole) - F.col("weight")).alias("pos"))


def list_positions(arcs: DataFrame, most: int | None = None) -> DataFrame:
    """``conv, at, pos`` of a linked list of arcs ``conv, at, nconv, nat, weight``: the weights before each arc. ``arcs`` should be stored.

    An arc is named by two numbers, of which ``at`` is not negative; the last one's next is null.
    """
    most = most or ARCS
    levels, left = [], arcs
    count = left.count()
    while True:
        tasks = max(1, -(-count // most))
        levels.append(_contracted(left, tasks))
        left = levels[-1].filter("conv = hconv and at = hat")
        if tasks == 1:
            positions = left.select("conv", "at", F.lit(0).cast("long").alias("pos"))
            break
        before, count = count, left.count()
        if 2 * count > before:
            positions = _doubled(left)
            break
    for level in reversed(levels):
        heads = positions.select(F.col("conv").alias("hconv"), F.col("at").alias("hat"), "pos")
        positions = level.join(heads, ["hconv", "hat"]).select("conv", "at", (F.col("pos") + F.col("ahead")).alias("pos"))
    return positions


def _nodes(marks: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    hashed = marks.select("conv_id", "place", "chars", *[F.xxhash64(F.lit(n), "place", "mark").alias(f"h{n}") for n in (1, 2)])
    cut = pieces(stored(hashed), ["conv_id"], ["place"])
    run = running(cut, ["conv_id"], ["place"], {}, {"x1": F.col("h1"), "x2": F.col("h2")})
    rows = run.select("conv_id", F.col("place").alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"), "chars")
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"), zero.alias("chars"))
    rows = stored(rows.unionByName(roots))
    found = rows.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"))
    ends = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x1", "x2"), "depth").alias("end"))
    return stored(found), ends.select("conv_id", "end.*")


def _family(found: DataFrame) -> DataFrame:
    """Nodes with the name of the parent, the number of children, the first of them and the next sibling."""
    below = found.filter("depth > 0")
    kids = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    kids = kids.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = stored(spread_join(below, parents, ["depth", "p1", "p2"]))
    within = F.floor(F.col("conv_id") / SIBLINGS)
    family = ["depth", "parent_conv_id"]
    ranged = named.withColumn("within", within)
    nearest = F.lead("conv_id").over(Window.partitionBy(*family, "within").orderBy("conv_id"))
    first = ranged.groupBy(*family, "within").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("conv_id"))
    beyond = first.select("conv_id", "depth", F.lead("first").over(Window.partitionBy(*family).orderBy("within")).alias("beyond"))
    ranged = ranged.withColumn("nearest", nearest).join(beyond, ["conv_id", "depth"], "left")
    ranged = ranged.withColumn("next_sibling", F.coalesce("nearest", "beyond")).drop("within", "nearest", "beyond")
    top = found.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "next_sibling": F.lit(None).cast("long")})
    return ranged.unionByName(top).join(kids, ["depth", "x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def _tour(nodes: DataFrame) -> DataFrame:
    """Arcs with their successor and the values that an enter carries."""
    depth, leaf = F.col("depth"), F.col("n_children") == 0

    def arc(at, nconv, nat, leaf, saved):
        return F.struct(at.alias("at"), nconv.alias("nconv"), nat.alias("nat"), leaf.cast("long").alias("leaf"), saved.cast("long").alias("saved"))

    enter = arc(2 * depth, F.when(leaf, F.col("conv_id")).otherwise(F.col("first_child")), 2 * depth + F.when(leaf, 1).otherwise(2), leaf, (F.col("n_convs") - 1) * F.col("chars"))
    sideways = F.col("next_sibling").isNotNull()
    leave = arc(
        2 * depth + 1,
        F.coalesce("next_sibling", "parent_conv_id"),
        F.when(sideways, 2 * depth).when(F.col("parent_conv_id").isNotNull(), 2 * depth - 1),
        F.lit(0),
        F.lit(0),
    )
    return nodes.select(F.col("conv_id").alias("conv"), F.inline(F.array(enter, leave))).withColumn("weight", F.lit(1).cast("long"))


def trie_of_marks(marks: DataFrame, conversations: DataFrame) -> Trie:
    """The trie of conversations given by ``turn_marks``, places 1, 2, ... in each; ``conversations`` lists every conv_id once, also those without turns."""
    found, ends = _nodes(marks, conversations)
    nodes = stored(_family(found))
    tour = stored(_tour(nodes))
    placed = tour.join(list_positions(tour.select("conv", "at", "nconv", "nat", "weight")), ["conv", "at"])
    cut = stored(placed.select("conv", "at", "pos", "leaf", "saved", F.floor(F.col("pos") / PIECE_ROWS).cast("long").alias("piece")))
    sums = running(cut, [], ["pos"], {"leaves": F.col("leaf"), "kept": F.col("saved")}, {})
    leaving = F.col("at") % 2 == 1
    signed = {n: F.when(leaving, F.col(n)).otherwise(F.col(own) - F.col(n)) for n, own in (("leaves", "leaf"), ("kept", "saved"))}
    totals = sums.groupBy(F.col("conv").alias("conv_id"), F.floor(F.col("at") / 2).cast("long").alias("depth")).agg(F.sum(signed["leaves"]).alias("n_leaves"), F.sum(signed["kept"]).alias("saved_tokens"))
    whole = nodes.join(totals, ["conv_id", "depth"])
    return Trie(whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "x1", "x2"), ends)


def prefix_trie(rows: DataFrame) -> Trie:
    """The trie of the conversations in rows ``conv_id, turn, role, text``.

    Nodes are distinct sequences of first turns, each named by its smallest conv_id and its depth; the root
    has depth 0 and no parent. ``n_convs`` counts the conversations that begin with it, ``n_leaves`` the
    childless nodes of its subtree, itself included, and ``saved_tokens`` sums (n_convs - 1) times the code points of the last text over the
    subtree. Order, nulls and ties as in ``turn_marks``; repeated rows are turns of their own. No rows give no nodes.
    """
    conversations = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long")).distinct()
    return trie_of_marks(turn_marks(rows), conversations)


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    node, digest = None, None
    for batch in batches:
        for depth, x1, x2, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "x1", "x2", "conv_id"))):
            if (depth, x1, x2) == node:
                digest.update(f",{conv}".encode())
                continue
            if node is not None:
                held.append((*node, digest.hexdigest()))
            node, digest = (depth, x1, x2), hashlib.sha256(str(conv).encode())
        if len(held) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["depth", "x1", "x2", "sha256"])
            held = []
    if node is not None:
        held.append((*node, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["depth", "x1", "x2", "sha256"])


def ends_digests(trie: Trie) -> DataFrame:
    """``depth, x1, x2`` of each node at which conversations end, and the ``sha256`` of their ids, ascending, joined by commas.

    The ids of a node are read in order by one task, which holds none.
    """
    dealt = trie.ends.repartition("depth", "x1", "x2").sortWithinPartitions("depth", "x1", "x2", "conv_id")
    return dealt.mapInArrow(_id_digests, "depth long, x1 long, x2 long, sha256 string")
