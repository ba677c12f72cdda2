"""The operators applied to whole tables with production parameters, under the names the driver knows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digests, format_conversations
from .common import read, stored
from .decontaminate import contaminated
from .html_blocks import extract_main_text
from .jaccard import shingle_components
from .mixing import mix_sources
from .oracle import oracle_sql
from .quality import score_quality
from .repair import plain_rows, repair_plans, repaired_digests
from .repeats import remove_repeats
from .scans import spread_join
from .sharding import shard_plan
from .tokens import count_tokens
from .topk import top_inner_products
from .trie import ends_digests, trie_of_marks, turn_marks
from .urls import judge_urls

URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op1_recurrent_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(read(spark, folder, "pages"))


def op2_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(read(spark, folder, "documents"))


def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(read(spark, folder, "documents"), result=lambda kept: F.sha2(kept, 256))
    return left.withColumnRenamed("kept", "kept_sha256")


def op4_ball_tree_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_inner_products(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_plan(read(spark, folder, "documents"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_components(read(spark, folder, "documents"), k=4, percent=85)


def op7_url_language_models(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(read(spark, folder, "pages"), URL_RULES)


def op8_simhash_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op9_chat_rendering(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    made = format_conversations(read(spark, folder, "conversations").select(*columns).unionByName(extra))
    read_back = made.select("conv_id", digests(F.col("formatted"), F.col("spans")).alias("d"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read_back.select("conv_id", "d.*", "formatted_chars")


def op10_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op11_whole_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents under the vocabulary with word ends."""
    return count_tokens(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows damaged by a hash of conversation and turn; ``gone`` marks the dropped ones."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    plain = plain_rows(rows.select("conv_id", "turn", "role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    made = plain.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return made.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "__copy")


def op12_grammar_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged by rule, with their faults, the cheapest repair and a digest of what it leaves."""
    rows = damaged(read(spark, folder, "conversations"))
    plans = stored(repair_plans(rows, "gone"))
    digests = repaired_digests(rows, plans, "gone").withColumnRenamed("sha256", "repaired_sha256")
    return plans.join(digests, plans.conv_id.eqNullSafe(digests.conv_id)).drop(digests.conv_id)


#: Conversations rebuilt on the same beginning, and turns of it that they take at most.
SHARED, MOST_TURNS = 100, 5


def rebuilt(marks: DataFrame, conversations: DataFrame) -> DataFrame:
    """Turn marks of conversations that begin with the first turns of the first conversation of their hundred."""

    def taken(conv_id):
        return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_TURNS + 1)).cast("long")

    conv = F.col("conv_id")
    wanted = conversations.select("conv_id", (conv - conv % SHARED).alias("first"), taken(conv).alias("h"))
    begin = stored(marks.filter(F.col("place") <= MOST_TURNS).withColumnRenamed("conv_id", "first"))
    copied = begin.join(wanted, "first").filter("place <= h").select("conv_id", "place", "mark", "chars")
    there = wanted.join(begin.groupBy("first").agg(F.max("place").alias("there")), "first", "left")
    short = there.select("conv_id", (F.col("h") - F.least("h", F.coalesce("there", F.lit(0)))).alias("lacking")).filter("lacking > 0")
    own = spread_join(marks.filter(F.col("place") > taken(conv)), stored(short), ["conv_id"], "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("lacking", F.lit(0))).alias("place"), "mark", "chars")
    return copied.unionByName(own)


def op13_euler_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on shared beginnings, with its subtree sums."""
    rows = read(spark, folder, "conversations")
    ids = stored(rows.filter("conv_id is not null").select(F.col("conv_id").cast("long")).distinct())
    trie = trie_of_marks(rebuilt(stored(turn_marks(rows)), ids), ids)
    none = F.sha2(F.lit("").cast("binary"), 256)
    ended = trie.nodes.join(ends_digests(trie), ["depth", "x1", "x2"], "left")
    return ended.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", none).alias("ends_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query in globals().items() if name.startswith("op") and callable(query)}
