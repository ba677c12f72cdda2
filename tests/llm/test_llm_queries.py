"""The registered queries: their SQL, their results' shapes, and brute force where there is no SQL."""

import duckdb
import public_tokenizers
import pytest
from cases import SMALL, words
from check_oracle import TABLES, rows
from test_decontaminate import brute as items_of
from test_jaccard import brute as components_of
from test_repeats import brute as repeats_of
from tokenizers import Tokenizer

import __spark_entry__ as entry
from leaksieve.llm import queries

SHAPES = {
    "op1_recurrent_blocks": "page_id:bigint url:string text:string n_chars:bigint",
    "op3_suffix_repeats": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op4_ball_tree_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op5_rendezvous_shards": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op6_jaccard_join": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op7_url_language_models": "page_id:bigint host:string path:string rule:string verdict:string score:double",
    "op9_chat_rendering": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op10_compression_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op11_whole_tokens": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op12_grammar_repair": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
    "op13_euler_trie": "conv_id:bigint depth:bigint parent_conv_id:bigint n_convs:bigint n_children:bigint n_leaves:bigint saved_tokens:bigint ends_sha256:string",
}


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_one_query_for_each_operator():
    names = [name for name in entry.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", SHAPES)
def test_shape(spark, name):
    frame = queries.queries()[name](spark, SMALL)
    assert " ".join(f"{n}:{t}" for n, t in frame.dtypes) == SHAPES[name]
    whole = {"op1": "pages", "op7": "pages", "op4": None, "op9": None, "op12": None, "op13": None}.get(name.split("_")[0], "documents")
    if whole:
        assert frame.count() == table(spark, whole).count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for each in TABLES:
        connection.execute(f"CREATE VIEW {each} AS SELECT * FROM '{SMALL}/{each}.parquet'")
    got = queries.queries()[name](spark, SMALL).toPandas()
    want = connection.execute(queries.oracle_sql()[name]).df()
    assert rows(got.astype(object)) == rows(want.astype(object))


def test_op3_equals_brute_force(spark):
    texts = [(r["doc_id"], r["text"].encode()) for r in table(spark, "documents").collect()]
    want = [row[:4] for row in repeats_of(texts, 200)]
    got = queries.op3_suffix_repeats(spark, SMALL).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)


def test_op6_equals_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    got = queries.op6_jaccard_join(spark, SMALL).collect()
    assert sorted(map(tuple, got), key=repr) == components_of(texts, 4, 85)


def test_op8_equals_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect() if len(words(r["text"])) < 600]
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    known = {d for d, _ in texts}
    got = [tuple(r) for r in queries.op8_simhash_decontamination(spark, SMALL).collect() if r["doc_id"] in known]
    assert sorted(got, key=repr) == items_of(texts, items)
    assert got


def test_op11_equals_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in queries.op11_whole_tokens(spark, SMALL).collect()}
    assert got == {d: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts.items()}


def test_op9_has_the_added_conversation(spark):
    rows_of = {r["conv_id"]: r for r in queries.op9_chat_rendering(spark, SMALL).collect()}
    assert rows_of[-7]["n_turns"] == 2
    assert rows_of[-7]["loss_chars"] == len("\\### Assistant: </turn> ok")
    assert set(rows_of) == {r["conv_id"] for r in table(spark, "conversations").select("conv_id").distinct().collect()} | {-7}
