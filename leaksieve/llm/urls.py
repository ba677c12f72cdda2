"""URL verdicts: rules first, then the ratio of two character language models.

The models are Markov chains over bytes. The chance of a byte blends all orders
up to ``ORDER``: an order counts for more the more often its context was seen. One
chain is counted over URLs that a rule allows, one over URLs that a rule blocks. A
URL's score is the difference of its log-likelihoods per byte; the cut is set
where chains over half of the rule-labelled URLs part the other half best, and
the scores are those of chains over all of them.

A byte and the ``ORDER - 1`` before it, which decide its chance, are one number, its
gram. Grams are counted exactly, in a table that grows with the URLs; shorter n-grams and
contexts are sums over it. Each distinct gram gets its log ratio once, and
URLs join that table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .words import mixed, packed, steps

ORDER = 5
#: Bits of a gram's symbol: a byte, the end of a URL, or the place before its first byte.
WIDTH = 9
#: Counters for each order and class of the sketch ``UrlModel``, which n-grams share by hash. No query uses it.
CELLS = 1 << 16
#: Sightings of a context at which it counts for as much as all shorter ones together.
BLEND = 4.0
#: Steps of the score, within -LIMIT to LIMIT, between which a cut is sought.
BINS = 800
LIMIT = 4.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls; rules are (verdict, host and path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


@dataclass
class UrlModel:
    """A sketch of one size for any corpus: ``counts[class][order]`` of n-grams and of their contexts (the n-gram without its last byte)."""

    counts: np.ndarray
    contexts: np.ndarray
    cut: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        full, before, owner = _with_contexts(column)
        logs = []
        for kind in (0, 1):
            chance = np.full(len(owner), 1 / 257)
            for order in range(ORDER):
                seen = self.contexts[kind][order][before[order]]
                chance = (self.counts[kind][order][full[order]] + BLEND * chance) / (seen + BLEND)
            logs.append(np.bincount(owner, np.log(chance), len(column)))
        return (logs[1] - logs[0]) / np.maximum(1, np.bincount(owner, minlength=len(column)))


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all URLs, ``ORDER`` zeros before each and a one behind it; the places of bytes and ends, and the URL of each."""
    data, ends = packed(column)
    count = np.diff(ends)
    start = ends[:-1] + np.arange(len(count)) * (ORDER + 1)
    owner = np.repeat(np.arange(len(count)), count)
    wide = np.zeros(len(data) + len(count) * (ORDER + 1), np.uint64)
    wide[start[owner] + ORDER + np.arange(len(data)) - ends[:-1][owner]] = data.astype(np.uint64) + np.uint64(2)
    wide[start + ORDER + count] = 1
    owner = np.repeat(np.arange(len(count)), count + 1)
    at = start[owner] + ORDER + np.arange(len(owner)) - (ends[:-1] + np.arange(len(count)))[owner]
    return wide, at, owner


def _with_contexts(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Cells of n-grams and of their contexts; order 0's context is everything."""
    wide, at, owner = _symbols(column)
    full, before, context = [], [], np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for order in range(ORDER):
            if order:
                context = mixed(context * np.uint64(257) + wide[at - order] + np.uint64(order))
            before.append((context % np.uint64(CELLS)).astype(np.int64))
            full.append((mixed(context * np.uint64(31) + wide[at] + np.uint64(order * 1009)) % np.uint64(CELLS)).astype(np.int64))
    return full, before, owner


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a task's URLs: kind, which table, order, cell and count."""
    tables = np.zeros((2, 2, ORDER, CELLS), np.int64)
    for whole in batches:
        for batch in steps(whole, "url"):
            full, before, owner = _with_contexts(batch.column("url"))
            kind = batch.column("kind").to_numpy()[owner]
            for k in (0, 1):
                for order in range(ORDER):
                    tables[k, 0, order] += np.bincount(full[order][kind == k], minlength=CELLS)
                    tables[k, 1, order] += np.bincount(before[order][kind == k], minlength=CELLS)
    places = np.flatnonzero(tables)
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(tables.reshape(-1)[places])], ["cell", "n"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, label, url) come in; the distinct grams of each URL go out with how often it holds them."""
    for whole in batches:
        for batch in steps(whole, "url"):
            wide, at, owner = _symbols(batch.column("url"))
            gram = np.zeros(len(at), np.uint64)
            for back in range(ORDER):
                gram |= wide[at - back] << np.uint64(WIDTH * back)
            order = np.lexsort((gram, owner))
            gram, owner = gram[order], owner[order]
            begin = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]))
            n, url = np.diff(np.append(begin, len(gram))), pa.array(owner[begin])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(url), batch.column("label").take(url), pa.array(gram[begin].view(np.int64)), pa.array(n)],
                ["row", "label", "gram", "n"],
            )


#: Counts of a gram in blocked and allowed URLs: in those learned before the cut is set, and in all.
_COUNTS = ("half0", "half1", "all0", "all1")


def _keys() -> list[Column]:
    """A gram's n-gram of each order, then its context of each order, numbered in the bits above the symbols."""
    grams = [F.col("gram").bitwiseAND(F.lit((1 << WIDTH * (order + 1)) - 1)) for order in range(ORDER)]
    slots = [*grams, *[F.shiftright(g, WIDTH) for g in grams]]
    return [key.bitwiseOR(F.lit(slot << WIDTH * ORDER)) for slot, key in enumerate(slots)]


def _chance(count: str) -> Column:
    """The blended chance of a gram's last symbol; ``seen`` has the counts of its keys in their order."""
    chance = F.lit(1 / 257)
    for order in range(ORDER):
        n, context = (F.coalesce(F.col("seen")[slot][count], F.lit(0)) for slot in (order, ORDER + order))
        chance = (n + BLEND * chance) / (context + BLEND)
    return chance


def gram_ratios(counted: DataFrame) -> DataFrame:
    """(gram, half, whole): the log ratio of the gram's chances in either pair of chains.

    ``counted`` has each distinct gram with its ``_COUNTS``. N-grams of two symbols
    and contexts of two are bounded by the alphabet and hot, so they are broadcast;
    at most 2^18 grams share any longer one.
    """
    seen = counted.filter("all0 + all1 > 0").select(F.explode(F.array(*_keys())).alias("key"), *_COUNTS)
    seen = stored(seen.groupBy("key").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    wanted = counted.select("gram", F.explode(F.array(*_keys())).alias("key"))
    slot = F.shiftright("key", WIDTH * ORDER)
    bounded = slot.isin(0, 1, ORDER, ORDER + 1, ORDER + 2)
    found = wanted.filter(bounded).join(F.broadcast(seen.filter(bounded)), "key", "left")
    found = found.unionAll(wanted.filter(~bounded).join(small(seen.filter(~bounded)), "key", "left"))
    found = found.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("key", *_COUNTS))).alias("seen"))
    return found.select("gram", *[(F.log(_chance(f"{c}1")) - F.log(_chance(f"{c}0"))).alias(name) for c, name in (("half", "half"), ("all", "whole"))])


def best_cut(scored: DataFrame) -> float:
    """The cut between steps of (kind, score) that parts the kinds best; 0 unless there are both."""
    step = F.least(F.greatest(F.floor((F.col("score") + LIMIT) * (BINS / (2 * LIMIT))), F.lit(0)), F.lit(BINS - 1))
    bins = scored.select("kind", step.cast("int").alias("bin")).groupBy("kind", "bin").count().toPandas()
    shares = np.zeros((2, BINS))
    for kind, place, n in bins.itertuples(index=False):
        shares[kind, place] = n
    if not shares.any(1).all():
        return 0.0
    shares = np.cumsum(shares / shares.sum(1, keepdims=True), axis=1)
    # A cut after bin i blocks what lies in it or before.
    gain = shares[0] - shares[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[len(best) // 2] + 1) * (2 * LIMIT / BINS) - LIMIT)


def url_scores(rows: DataFrame) -> tuple[DataFrame, float]:
    """(row, score) for rows of (row, url, kind), kind 1 allowed, 0 blocked or null, and the cut.

    ``rows`` are stored. Half of the distinct URLs with a kind, by hash, are learned before the
    cut is set and all thereafter. Without URLs of both kinds every score and the cut
    are 0, which allows; without both kinds in each half the cut is 0.
    """
    learn = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(2)) == 0
    url = F.coalesce("url", F.lit("")).cast("binary")
    label = F.coalesce(F.col("kind") + F.when(learn, 2).otherwise(0), F.lit(-1)).cast("int")
    grams = rows.select("row", label.alias("label"), url.alias("url")).mapInArrow(_gram_rows, "row long, label int, gram long, n long")
    # Label and count: half0, half1, all0, all1.
    labels = ((2,), (3,), (0, 2), (1, 3))
    counts = [F.sum(F.when(F.col("label").isin(*of), F.col("n")).otherwise(0)).alias(c) for c, of in zip(_COUNTS, labels, strict=True)]
    counted = stored(grams.groupBy("gram").agg(*counts))
    half0, half1, all0, all1 = counted.agg(*[F.sum(c) for c in _COUNTS]).first()
    if not all0 or not all1:
        return rows.select("row", F.lit(0.0).alias("score")), 0.0
    ratios = stored(gram_ratios(counted))
    # Decimals, so that the order of the terms doesn't show.
    sums = [F.sum((F.col("n") * F.col(c)).cast("decimal(30,18)")).cast("double") / F.sum("n") for c in ("half", "whole")]
    scored = grams.join(small(ratios), "gram").groupBy("row", "label").agg(sums[0].alias("half"), sums[1].alias("score"))
    scored = stored(scored)
    unseen = scored.filter("label in (0, 1)").select(F.col("label").alias("kind"), F.col("half").alias("score"))
    return scored.select("row", "score"), best_cut(unseen) if half0 and half1 else 0.0


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict and score.

    A rule ``host/path`` fits its host and all subdomains where the URL's path starts
    with ``/path``; the longest decides. Otherwise the verdict is ``allow``
    where the score reaches the cut, else ``block``. Null URLs and those without
    ``://`` have an empty host and path and are scored like others. Equal rows each return.
    """
    url = F.col(url_column).cast("string")
    host, path = host_and_path(url)
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_column), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("decided", decided)
    # Once stored, a row keeps its number.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    scores, cut = url_scores(rows.select("row", "url", (F.col("decided") == "allow").cast("int").alias("kind")))
    verdict = F.coalesce("decided", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return rows.join(scores, "row").select(id_column, "host", "path", "rule", verdict.alias("verdict"), "score")
