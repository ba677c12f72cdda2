import random

import public_tokenizers
import pytest
from cases import DOCS, documents
from tokenizers import Tokenizer

from leaksieve.llm import tokens
from leaksieve.llm.tokens import WholeTokens, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcdeéüßÄΣςσ漢字🙂é̀ \n\t'sdltrevm0123456789.,!-<|endoftext|>  ͅİ½²Ⅳ‍\x00\x85가각ᄀ\x1c"
PARTS = ["<|endoftext|>", "<|startoftext|>", " the ", "é", "<|endoftext", "'Ll", "İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return WholeTokens(PATH)


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_proved_words_encode_alone(library, counter):
    words = random.Random(1).sample(sorted(counter.whole), 3000)
    assert all(size(library, word) == 1 for word in words)


def test_some_vocabulary_strings_are_not_proved(library, counter):
    ends = [v[: -len("</w>")] for v in library.get_vocab() if v.endswith("</w>")]
    others = [w for w in ends if w.isascii() and w.isalpha() and w not in counter.whole]
    assert all(size(library, word) != 1 for word in others)


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_equals_the_library(library, counter, monkeypatch, piece):
    monkeypatch.setattr(tokens, "PIECE_CHARS", piece)
    rng = random.Random(piece)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS if rng.random() < 0.1 else LETTERS) for _ in range(rng.randint(0, 60)))
        assert counter.count(text) == size(library, text), repr(text)


@pytest.mark.parametrize("long", [1, 1000])
def test_both_ways_of_merging(counter, monkeypatch, long):
    monkeypatch.setattr(tokens, "LONG_WORD", long)
    rng = random.Random(4)
    words = ["".join(rng.choice("aethinors") for _ in range(rng.randint(1, 40))).encode() for _ in range(500)]
    made = [counter.merges.encode(w) for w in words]
    monkeypatch.setattr(tokens, "LONG_WORD", 48)
    assert made == [counter.merges.encode(w) for w in words]


def test_long_words_take_linear_time(library, counter):
    text = "ab" * 150_000 + "é" * 30_000
    assert counter.count(text) == size(library, text)


def test_awkward_rows(spark, library):
    texts = [(1, None), (2, ""), (3, "The end.<|endoftext|>The end."), (3, "The end.<|endoftext|>The end."), (None, "ÀB 12"), (5, "word " * 60_000)]
    got = count_tokens(documents(spark, texts), PATH, limit=10).collect()
    want = [(i, len((t or "").encode()), size(library, t), size(library, t) > 10) for i, t in texts]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert count_tokens(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        WholeTokens(public_tokenizers.path("byte_bpe_50k.json"))
