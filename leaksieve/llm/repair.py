"""Conversations brought into the order ``(s?(ua)+)?`` with the cheapest edits, by dynamic programming over a grammar.

1. Each row of a conversation becomes one letter: the initial of its role and its first fault.
2. A row's letter is a matrix over the states of an automaton for the wanted order: for each
   pair of states, what the cheapest edits cost that lead from one to the other over this row, and
   these edits, the first in ASCII order among the cheapest. Sums of costs and joined edits make the product,
   the lesser of two the sum (min-plus).
3. The sequences of a batch of conversations are compressed together by Re-Pair: the pair of
   neighbours that occurs most becomes a rule, until no pair occurs twice. Each rule's
   matrix is the product of two others, made once, bottom-up, and used wherever the rule
   occurs in any conversation; its edits are a rope, two ropes joined.
4. A conversation's matrix row is then the product over the few symbols that are left of it.

Letters are made natively. A long conversation is many pieces of a bounded number of rows; only
its letters, a byte a row like the edits it gets, are put together. Its texts are read in order once, with the edits,
and none is held.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .scans import pieces

#: Letters of a batch that one grammar is made of, and rules that a task keeps before it begins anew.
GRAMMAR_LETTERS, MOST_RULES = 200_000, 20_000
#: Letters of a sequence that are one stretch of it: its products begin anew, so ropes stay shallow.
STRETCH = 4096
#: Edits up to which a rope is one string.
LEAF_EDITS = 256

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States: nothing yet, after the system row, after a user row, after an assistant row.
STATES, ENDS = range(4), (0, 3)
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}

#: Row letters: role initial s, u, a or other, upper case if the row is truncated; a row that must go is x.
ROLES = "suao"
BLANK, DUPLICATE = "1234", "5678"

Rope = str | tuple
#: 16 entries (cost, edits), None where a state can't be reached.
Matrix = list


def rope_length(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[0]


def joined(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    n = rope_length(a) + rope_length(b)
    return a + b if n <= LEAF_EDITS and isinstance(a, str) and isinstance(b, str) else (n, a, b)


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += [top[2], top[1]]


def comes_before(a: Rope, b: Rope) -> bool:
    """Whether ``a`` is the lesser in ASCII order. Ropes that both begin with are passed over unread."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    ours, theirs = [a], [b]
    x = y = ""
    while True:
        while not x and not y and ours and theirs and not (isinstance(ours[-1], str) and isinstance(theirs[-1], str)):
            p, q = ours[-1], theirs[-1]
            if p is q:
                ours.pop()
                theirs.pop()
                continue
            longer = ours if rope_length(p) >= rope_length(q) and not isinstance(p, str) or isinstance(q, str) else theirs
            top = longer.pop()
            longer += [top[2], top[1]]
        x, y = x or _next_leaf(ours), y or _next_leaf(theirs)
        if not x or not y:
            return bool(y) and not x
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def _next_leaf(stack: list[Rope]) -> str:
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            return top
        stack += [top[2], top[1]]
    return ""


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if comes_before(b[1], a[1]) else a


def times(a: Matrix, b: Matrix, rows: int = 4) -> Matrix:
    out: Matrix = [None] * (4 * rows)
    for i in range(rows):
        for k in STATES:
            first = a[4 * i + k]
            if first is None:
                continue
            cost, edits = first
            for j in STATES:
                second = b[4 * k + j]
                if second is None:
                    continue
                best, total = out[4 * i + j], cost + second[0]
                if best is None or total < best[0]:
                    out[4 * i + j] = (total, joined(edits, second[1]))
                elif total == best[0]:
                    out[4 * i + j] = better(best, (total, joined(edits, second[1])))
    return out


def _inserted() -> Matrix:
    out: Matrix = [(0, "") if i == j else None for i in STATES for j in STATES]
    one: Matrix = [None] * 16
    for role in "ua":
        for i, j in _NEXT[role].items():
            one[4 * i + j] = (INSERT, "I")
    # Two rows lead from any state to any that rows lead to at all; more would go round.
    step = out
    for _ in range(2):
        step = times(step, one)
        out = [better(a, b) for a, b in zip(out, step)]
    return out


INSERTS = _inserted()


def letter_matrix(letter: str) -> Matrix:
    """Rows put in before a row of this letter, then what becomes of it."""
    own: Matrix = [(DELETE, "D") if i == j else None for i in STATES for j in STATES]
    if letter != "x":
        extra = TRUNCATED if letter.isupper() else 0
        ways = [(_NEXT[letter.lower()], (extra, "K")), (_NEXT["u"], (REROLE + extra, "R")), (_NEXT["a"], (REROLE + extra, "R"))]
        for moves, way in ways:
            for i, j in moves.items():
                own[4 * i + j] = better(own[4 * i + j], way)
    return times(INSERTS, own)


def re_pair(sequences: list[list[int]], rule: Callable[[int, int], int]) -> list[list[int]]:
    """The sequences with the most frequent pair of neighbours replaced by its rule, again and again, until no pair occurs twice.

    ``rule`` gives the symbol of a pair. Pairs are counted over all sequences together and don't cross from one to another.
    """
    symbols: list[int] = []
    for sequence in sequences:
        symbols += sequence
        symbols.append(-1)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for at, pair in enumerate(zip(symbols, symbols[1:])):
        if -1 not in pair:
            places.setdefault(pair, set()).add(at)
    queue = [(-len(found), pair) for pair, found in places.items() if len(found) > 1]
    heapq.heapify(queue)

    def forget(pair: tuple[int, int], at: int) -> None:
        if pair in places:
            places[pair].discard(at)

    while queue:
        count, pair = heapq.heappop(queue)
        found = places.get(pair, ())
        if len(found) != -count:
            if len(found) > 1:
                heapq.heappush(queue, (-len(found), pair))
            continue
        made, touched = rule(*pair), set()
        for at in sorted(places.pop(pair)):
            right = after[at]
            if right >= n or (symbols[at], symbols[right]) != pair:
                continue
            left, beyond = before[at], after[right]
            if left >= 0 and symbols[left] != -1:
                forget((symbols[left], pair[0]), left)
            if symbols[beyond] != -1:
                forget((pair[1], symbols[beyond]), right)
            symbols[at], symbols[right] = made, -2
            after[at], before[beyond] = beyond, at
            if left >= 0 and symbols[left] != -1:
                places.setdefault((symbols[left], made), set()).add(left)
                touched.add((symbols[left], made))
            if symbols[beyond] != -1:
                places.setdefault((made, symbols[beyond]), set()).add(at)
                touched.add((made, symbols[beyond]))
        for new in touched:
            if len(places.get(new, ())) > 1:
                heapq.heappush(queue, (-len(places[new]), new))
    out, at = [], 0
    for sequence in sequences:
        kept, end = [], at + len(sequence)
        while at < end:
            kept.append(symbols[at])
            at = after[at]
        out.append(kept)
        at = end + 1
    return out


class Rules:
    """Symbols with their matrices: the letters, and the rules that any batch of a task has made."""

    def __init__(self) -> None:
        letters = [r.upper() if cut else r for r in ROLES for cut in (False, True)] + ["x"]
        self.letters = {letter: n for n, letter in enumerate(letters)}
        self.matrices = [letter_matrix(letter) for letter in letters]
        self.pairs: dict[tuple[int, int], int] = {}

    def rule(self, left: int, right: int) -> int:
        number = self.pairs.get((left, right))
        if number is None:
            number = self.pairs[left, right] = len(self.matrices)
            self.matrices.append(times(self.matrices[left], self.matrices[right]))
        return number

    def edits(self, sequences: list[str]) -> list[tuple[int, str]]:
        """The cheapest edits of each sequence of letters: their cost and initials."""
        distinct = {s: n for n, s in enumerate(dict.fromkeys(sequences))}
        states: list[Matrix] = [[(0, ""), None, None, None] for _ in distinct]
        held: list[tuple[int, str]] = []
        room = GRAMMAR_LETTERS
        for sequence, n in distinct.items():
            for at in range(0, len(sequence), STRETCH):
                held.append((n, sequence[at : at + STRETCH]))
                room -= len(held[-1][1])
                if room <= 0:
                    self._advance(states, held)
                    held, room = [], GRAMMAR_LETTERS
        self._advance(states, held)
        results = []
        for state in states:
            ends = times(state, INSERTS, 1)
            cost, rope = better(*(ends[end] for end in ENDS))
            results.append((cost, "".join(leaves(rope))))
        return [results[distinct[s]] for s in sequences]

    def _advance(self, states: list[Matrix], stretches: list[tuple[int, str]]) -> None:
        """Takes the states of sequences over the next stretches of them, which are compressed together."""
        if len(self.matrices) > MOST_RULES:
            self.__init__()
        compressed = re_pair([[self.letters[letter] for letter in part] for _, part in stretches], self.rule)
        for (n, part), symbols in zip(stretches, compressed):
            if len(part) < STRETCH:
                for symbol in symbols:
                    states[n] = times(states[n], self.matrices[symbol], 1)
                continue
            product = self.matrices[symbols[0]]
            for symbol in symbols[1:]:
                product = times(product, self.matrices[symbol])
            states[n] = times(states[n], product, 1)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = Rules()
    for batch in batches:
        found = rules.edits(batch.column("letters").to_pylist())
        columns = [batch.column("conv_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([e for _, e in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "cost", "audit"])


def plain_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with nulls in role and text as one space."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *told)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


_ORDER = ["turn", "role", "digest", "tie"]


def letters_of(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """``conv_id, piece, letters``: a letter per row, in order, with 1 to 4 for blank and 5 to 8 for duplicate rows.

    ``gone`` names a boolean column: such rows only name their conversation, which then has an empty piece.
    """
    text, role = F.col("text"), F.col("role")
    # The last letter that is no white space; null if there is none.
    last = F.nullif(F.substring(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), -1, 1), F.lit(""))
    first = F.substring(role, 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    narrow = rows.select(
        "conv_id", "turn", "role", _digest(text).alias("digest"), last.isNull().alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
        kind.alias("kind"), (F.col(gone) if gone else F.lit(False)).alias("gone"), F.monotonically_increasing_id().alias("tie"),
    )
    narrow = stored(narrow)
    # Of the rows with one role and text in a conversation, the first by turn; nulls come first in structs.
    firsts = narrow.filter("not gone").groupBy("conv_id", "role", "digest").agg(F.min_by("tie", F.struct("turn", "tie")).alias("tie"))
    marked = narrow.join(firsts.select("tie", F.lit(True).alias("first")), "tie", "left")
    place = F.instr(F.lit(ROLES), F.col("kind"))
    letter = (
        F.when(F.col("gone"), "")
        .when(F.col("blank"), place.cast("string"))
        .when(F.col("first").isNull(), (place + len(ROLES)).cast("string"))
        .when(F.col("cut"), F.upper("kind"))
        .otherwise(F.col("kind"))
    )
    cut = pieces(stored(marked.select("conv_id", *_ORDER, letter.alias("letter"))), ["conv_id"], _ORDER)
    ordered = F.sort_array(F.collect_list(F.struct(*_ORDER, "letter")))
    return cut.groupBy("conv_id", "piece").agg(F.array_join(F.transform(ordered, lambda r: r.letter), "").alias("letters"))


def repair_plans(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost`` (longs) and ``audit``.

    ``rows`` hold ``conv_id, turn, role, text``; null roles and texts count as one space. Rows are taken by
    turn, nulls first, rows of one turn by role and md5 of the text. A null conv_id is a
    conversation of its own. ``gone`` as in ``letters_of``: a conversation without rows has zeros and no edits. No rows give none.
    """
    live = ~F.col(gone) if gone else F.lit(True)
    turns = rows.groupBy("conv_id", "turn").agg(F.max(live).alias("live"))
    turn = F.when(F.col("live"), F.col("turn"))
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).cast("long").alias("gaps"))

    listed = letters_of(rows, gone).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "letters"))).alias("parts"))
    whole = stored(listed.select("conv_id", F.array_join(F.transform("parts", lambda p: p.letters), "").alias("letters")))
    letters = F.col("letters")
    counted = {
        "blank": F.length(F.regexp_replace(letters, f"[^{BLANK}]", "")),
        "duplicate": F.length(F.regexp_replace(letters, f"[^{DUPLICATE}]", "")),
        "truncated": F.length(F.regexp_replace(letters, "[^SUAO]", "")),
    }
    roles = F.translate(F.lower(letters), BLANK + DUPLICATE, ROLES + ROLES)
    # Neighbours that are none of su, ua, au: all pairs less the legal ones, which look-ahead finds overlapping.
    legal = F.length(F.regexp_replace(roles, "s(?!u)|u(?!a)|a(?!u)|o", ""))
    illegal = F.greatest(F.length(letters) - 1, F.lit(0)) - legal
    told = whole.select("conv_id", *[c.cast("long").alias(n) for n, c in counted.items()], illegal.cast("long").alias("illegal"))
    asked = whole.select("conv_id", F.translate(letters, BLANK + DUPLICATE, "x" * 8).alias("letters"))
    edits = asked.mapInArrow(_edit_rows, "conv_id long, cost long, audit string")

    def keyed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("__none", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))

    both = keyed(gaps).join(keyed(told), ["conv_id", "__none"]).join(keyed(edits), ["conv_id", "__none"])
    own = F.when(~F.col("__none"), F.col("conv_id")).alias("conv_id")
    return both.select(own, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (conv_id, place, role, text, edit) of conversations that come one after the other, a row with the edits before its rows.

    A conversation begins with a row of place 0 and no role.
    """
    state, place, edits, at, conv = 0, 0, "", 0, None

    def put(edit: str, role: str, text: str) -> tuple:
        nonlocal state, place
        state = _NEXT[role[:1]][state]
        place += 1
        return conv, place, role, text, edit

    def inserts() -> Iterator[tuple]:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            at += 1
            yield put("I", "assistant" if state == 2 else "user", "")

    for batch in batches:
        for conv_id, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                yield from inserts()
                conv, edits, at, state, place = conv_id, audit, 0, 0, 0
                yield conv, 0, None, None, None
                continue
            yield from inserts()
            edit, at = edits[at], at + 1
            if edit == "K":
                yield put("K", role, text)
            elif edit == "R":
                yield put("R", "assistant" if state == 2 else "user", text)
    yield from inserts()


_REPAIRED = "conv_id long, place long, role string, text string, edit string"


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in _edited(batches):
        if row[1]:
            held.append(row)
            size += len(row[3])
        if size > 4 << 20 or len(held) >= 10_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    conv, running = None, None
    for conv_id, place, role, text, _ in _edited(batches):
        if place == 0:
            if running is not None:
                done.append((conv, running.hexdigest()))
            conv, running = conv_id, hashlib.sha256()
        else:
            running.update((("\n" if place > 1 else "") + f"{role}:{text}").encode())
    if running is not None:
        done.append((conv, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv_id", "sha256"])


def _with_edits(rows: DataFrame, plans: DataFrame, gone: str | None) -> DataFrame:
    """Rows and edits by conversation, the edits first, then the rows in order."""
    rows = rows.filter(~F.col(gone)) if gone else rows
    texts = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", _digest(F.col("text")).alias("digest"), "text")
    heads = plans.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))])
    dealt = heads.unionByName(texts).repartition(F.col("conv_id"))
    return dealt.sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest").select("conv_id", "audit", "role", "text")


def repaired_rows(rows: DataFrame, plans: DataFrame, gone: str | None = None) -> DataFrame:
    """The repaired conversations, a row each: ``conv_id``, ``place`` from 1, ``role``, ``text`` and ``edit`` (K, R or I).

    ``plans`` are those of ``repair_plans`` for the same rows. Reroled rows are user or assistant, inserted ones have
    an empty text. A conversation is read in order by one task, which holds its edits and no text.
    """
    return _with_edits(rows, plans, gone).mapInArrow(_repaired_rows, _REPAIRED)


def repaired_digests(rows: DataFrame, plans: DataFrame, gone: str | None = None) -> DataFrame:
    """``conv_id`` and ``sha256``, lowercase hex of the repaired rows as ``role:text`` joined by line feeds, for every plan."""
    return _with_edits(rows, plans, gone).mapInArrow(_digest_rows, "conv_id long, sha256 string")
