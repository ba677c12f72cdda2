"""Mixing sources to target weights by Poisson replication, in native expressions.

A source of target share w and measured bytes b is to appear w * total / b
times over. Every document is repeated by a Poisson variate with that mean: a
uniform number from a hash of its id is inverted through the distribution. So
the choice depends on the id and the seed alone, not on partitions or retries.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored, unit

#: A mean beyond this is the sum of several variates, each with a hash of its own.
LARGEST_MEAN = 16
#: Values of the distribution that are inverted; beyond them a mean of 16 has less than 1e-27.
TERMS = 80
#: Sources up to which their rates are broadcast; beyond, rows meet them by a salted join.
MAX_SOURCES = 100_000
SALTS = 64


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k below ``TERMS``, by the recurrence of its terms."""
    start = F.exp(-mean)
    begin = F.struct(start.alias("p"), F.array(start).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), begin, step)["sums"]


def source_rates(docs: DataFrame, source: Column, size: Column, weights: Mapping[str, float] | None, alpha: float, total: float | None) -> DataFrame:
    """Per source: its bytes, target share and rate; shares are the given weights or bytes to the power ``alpha``."""
    stats = docs.groupBy(source.alias("__source")).agg(F.sum(size).cast("double").alias("bytes"))
    if weights is None:
        weight = F.pow("bytes", F.lit(float(alpha)))
    else:
        pairs = [F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("__source")], F.lit(0.0)) if pairs else F.lit(0.0)
    stats = stats.withColumn("weight", F.when(F.col("bytes") > 0, weight).otherwise(0.0))
    sums = stats.agg(F.sum("weight").alias("weights"), F.sum("bytes").alias("all"))
    stats = stats.join(F.broadcast(sums))  # one row
    wanted = F.col("all") if total is None else F.lit(float(total))
    rate = F.when(F.col("bytes") > 0, F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * wanted / F.col("bytes")).otherwise(0.0))
    stats = stats.select("__source", F.coalesce(rate, F.lit(1.0)).alias("__rate"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("__rate") / LARGEST_MEAN)).cast("int")
    return stats.select("__source", pieces.alias("__pieces"), poisson_table(F.col("__rate") / pieces).alias("__table"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.5,
    total: float | None = None,
    seed: int = 2,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    copy_column: str | None = "copy",
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """All columns of ``docs``, each row as often as drawn, in an order that hashes decide; ``copy_column`` counts from 0.

    ``total`` is the bytes to aim at (default: as many as there are). A source
    without a weight gets 0; a null source is a source of its own (with
    ``weights`` it gets 0). A source without any bytes keeps a mean of 1. Rows
    that share an id share their draw; rows without one are drawn by their text. An empty table
    gives no rows. A copy column of a name that exists replaces it.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    size = F.octet_length(text)
    name = F.coalesce(F.col(id_column).cast("string"), F.md5(text.cast("binary")))
    rates = stored(source_rates(docs, F.col(source_column), size, weights, alpha, total))
    few = rates.limit(max_sources + 1).count() <= max_sources
    rows, on = docs, docs[source_column].eqNullSafe(rates["__source"])
    if few:
        joined = rows.join(small(rates, max_sources), on)
    else:
        rows = docs.withColumn("__salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
        salted = rates.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, rows[source_column].eqNullSafe(salted["__source"]) & (F.col("__salt") == F.col("__to")))
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col("__pieces")),
        F.lit(0),
        lambda n, i: n + F.size(F.filter("__table", lambda p: p < unit(name, i, F.lit(seed)))),
    )
    drawn = joined.withColumn("__n", draws).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    placed = drawn.withColumn("__at", F.xxhash64(name, "__copy", F.lit(seed)))
    kept = [F.col(c) for c in docs.columns if c != copy_column] + ([F.col("__copy").alias(copy_column)] if copy_column else [])
    return placed.repartition("__at").sortWithinPartitions("__at").select(*kept)
