"""Chat formatting with a template that is known by its output alone.

For each turn the template renders the conversation up to it. If that output
continues the one before, the addition is the turn's span; if not, the template
rewrites history, which is reported. Two more renderings, with probe texts in
the turn's place, show where in the span the text lies: they differ there and nowhere else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_prefix
from .words import Memory

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_END = "</turn>\n"
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.DOTALL)
_PROBES = ("p", "q")


def escape(text: str) -> str:
    """No ``#`` and no ``</`` is left that a backslash doesn't mark."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


_known = Memory(1 << 12)


def _shown(turn: Turn) -> str:
    shown = _known.get(turn)
    if shown is None:
        role, text = turn
        shown = _known[turn] = f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}{_END}"
    return shown


def turn_template(turns: list[Turn]) -> str:
    """``### role: text</turn>`` and a line feed for each turn."""
    return "".join([_shown(turn) for turn in turns])


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a conversation that ``turn_template`` made."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The rendered conversation, each turn's start, end, text start and text end, and whether history was rewritten.

    A turn whose output doesn't continue the one before starts where the two part.
    """
    before, spans, rewrites = "", [], False
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        start = len(before)
        if not now.startswith(before):
            start, rewrites = shared_prefix(now, before), True
        one, two = (template([*turns[:i], (role, probe)]) for probe in _PROBES)
        begin = shared_prefix(one, two)
        tail = len(one) - begin - 1
        spans.append((start, len(now), min(begin, len(now)), max(min(begin, len(now)), len(now) - tail)))
        before = now
    return before, spans, rewrites


SPAN = "array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint>>"
_SPAN = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())]))


def _format_rows(template: Template):
    """Rows sorted by conversation come in; one conversation is held at a time."""

    def made(key, turns: list[Turn]) -> pa.RecordBatch:
        text, spans, rewrites = locate(turns, template)
        named = [dict(zip(("role", "start", "end", "text_start", "text_end"), (turn[0], *span), strict=True)) for turn, span in zip(turns, spans, strict=True)]
        values = [pa.array([key], pa.int64()), pa.array([text], pa.string()), pa.array([named], _SPAN), pa.array([rewrites])]
        return pa.RecordBatch.from_arrays(values, ["conv", "formatted", "spans", "rewrites_history"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: list[Turn] = []
        key, out = None, []
        for batch in batches:
            keys = batch.column("conv").to_pylist()
            for now, role, text in zip(keys, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if turns and now != key:
                    out.append(made(key, turns))
                    turns = []
                    if sum(b.nbytes for b in out[-1:]) > 1 << 20 or len(out) >= 256:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out = []
                key = now
                turns.append((role, text))
        if turns:
            out.append(made(key, turns))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def format_conversations(
    turns: DataFrame,
    template: Template = turn_template,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Per conversation: id, the formatted text, the span of each turn and of its text in code points, and ``rewrites_history``.

    Turns are taken by number, equal numbers by role and text; equal rows are turns
    each. Null roles and texts are empty, a null number comes first, and rows
    without an id are one conversation. An empty table gives no rows. A conversation is
    one task's work, its rows held alone; no others are gathered with it.
    """
    rows = turns.select(
        F.col(id_column).cast("long").alias("conv"),
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    out = dealt.mapInArrow(_format_rows(template), f"conv long, formatted string, spans {SPAN}, rewrites_history boolean")
    return out.withColumnRenamed("conv", id_column)


DIGEST = "struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string>"


def digests(formatted: Column, spans: Column, role: str = "assistant") -> Column:
    """What a reader gets back: turns parsed from the text, and the texts under the mask of one role."""

    @F.arrow_udf(DIGEST)
    def read(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), marks.to_pylist(), strict=True):
            turns = read_turns(text)
            loss = "".join([unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == role])
            every = hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in turns]).encode()).hexdigest()
            out.append({"n_turns": len(turns), "turns_sha256": every, "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest()})
        kind = pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())])
        return pa.array(out, kind)

    return read.asNondeterministic()(formatted, spans)
